"""Packing of bulletins into sequences of bounded length by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import random
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.session import checkpoint

LIMIT = 4096
SHARD = 4096
ISLANDS, POPULATION, GENERATIONS, ROUNDS = 2, 4, 6, 2
CACHE = 400_000
# The split pattern of the public vocabulary, for lower-case ASCII and the lower-case letters of Latin-1, and the
# chunks it holds for: those neither normalised nor lowered otherwise than by ``str.lower``.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# The vocabulary writes each byte as one character; bytes of Latin-1 letters from 0xA1 on stand for themselves, lower ones are moved up.
_MOVED = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
_AS_BYTES = {c: "".join(_MOVED.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Kept(dict):
    """Values made on first use. When ``size`` are held they become the older half, from which those still in use return."""

    def __init__(self, make: Callable[[str], bytes], size: int = CACHE):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        v = self.older.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = v
        return v


class Encoder:
    """Token ids of whole texts; pieces between blanks are independent in this vocabulary, so they are looked up in bounded caches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.pieces, self.chunks = Kept(self._piece), Kept(self._chunk)

    def _piece(self, p: str) -> bytes:
        ids = [k.id for k in self.t.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, c: str) -> bytes:
        if "<|" in c:
            return np.array(self.t.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        if c.isascii() and c.isprintable() or _PLAIN.fullmatch(c):
            low = c.lower()
            if low.isalpha():
                parts = [low]
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":
                parts = [low[:-1], low[-1]]
            else:
                parts = _SPLIT.findall(low)
            if not c.isascii():
                parts = [p.translate(_AS_BYTES) for p in parts]
            return self.pieces[parts[0]] if len(parts) == 1 else b"".join([self.pieces[p] for p in parts])
        return b"".join([self.pieces[p] for p, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(c))])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(bulletins: DataFrame, tokenizer: str, key: str = "incident_id", text: str = "message", limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """Token pieces of at most ``limit`` ids: key, piece, start, length, ids_crc32. ``tokenizer`` is a file in the public set."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if tokenizer not in _ENCODERS:
            import public_tokenizers

            _ENCODERS[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
        enc = _ENCODERS[tokenizer]
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.ids(t or "") + end)
                for i in range(0, len(ids) // 4, limit):
                    part = ids[4 * i:4 * (i + limit)]
                    rows.append((k, i // limit, i, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(("key", "piece", "start", "length", "ids_crc32"))},
                                             schema=pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return bulletins.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "key long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins under construction, found by best fit: the fullest bin with room."""

    def __init__(self, sizes, limit):
        self.sizes, self.limit, self.bins, self.rest = sizes, limit, {}, []

    def put(self, b: int, items: list[int]) -> None:
        self.bins[b] = items
        bisect.insort(self.rest, (self.limit - sum(self.sizes[i] for i in items), b))

    def fit(self, i: int) -> None:
        k = bisect.bisect_left(self.rest, (self.sizes[i], -1))
        if k < len(self.rest):
            room, b = self.rest.pop(k)
            self.bins[b].append(i)
        else:
            room, b = self.limit, len(self.bins)
            while b in self.bins:
                b += 1
            self.bins[b] = [i]
        bisect.insort(self.rest, (room - self.sizes[i], b))


def best_fit(sizes, items, limit, kept=()) -> list[list[int]]:
    x = Bins(sizes, limit)
    for b, group in enumerate(kept):
        x.put(b, list(group))
    for i in items:
        x.fit(i)
    return list(x.bins.values())


def crossover(sizes, a: list[list[int]], b: list[list[int]], limit: int, rng: random.Random) -> list[list[int]]:
    """Child of two packings: well-filled bins of ``b`` enter whole, bins of ``a`` that hold any of their documents are
    broken up, and the documents displaced are placed again by best fit, largest first."""
    full = sorted(b, key=lambda g: -sum(sizes[i] for i in g))
    inject = [g for g in full[:max(1, len(full) // 2)] if rng.random() < 0.5] or full[:1]
    taken = {i for g in inject for i in g}
    keep = [g for g in a if not any(i in taken for i in g)]
    loose = [i for g in a if any(i in taken for i in g) for i in g if i not in taken]
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), limit, [*inject, *keep])


def fitness(sizes, p: list[list[int]], limit: int) -> tuple[int, float]:
    return -len(p), sum((sum(sizes[i] for i in g) / limit) ** 2 for g in p) / max(1, len(p))


def evolve(sizes: list[int], limit: int, seed: int, elites: list[list[list[int]]], generations: int, population: int) -> list[list[int]]:
    """Best packing of one island. It stops early once no packing can have fewer bins."""
    rng, least, n = random.Random(seed), -(-sum(sizes) // limit), range(len(sizes))
    pool = [*elites]
    down = sorted(n, key=lambda i: -sizes[i])
    while len(pool) < population:
        pool.append(best_fit(sizes, down if not pool else sorted(n, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2)), limit))
        if len(pool[-1]) <= least:
            return pool[-1]
    for _ in range(generations):
        pool.sort(key=lambda p: fitness(sizes, p, limit), reverse=True)
        if len(pool[0]) <= least:
            break
        child = crossover(sizes, pool[0], pool[rng.randrange(1, len(pool))], limit, rng)
        pool[-1] = child
    return max(pool, key=lambda p: fitness(sizes, p, limit))


def _islands(items: DataFrame, limit: int, islands: int, rounds: int) -> DataFrame:
    """Evolves every shard on its islands; after each round an island's best packing moves to the next island."""
    spread = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("x")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "x.row", "x.length", F.lit(None).cast("array<array<int>>").alias("elite"))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = spread
    for r in range(rounds):
        def work(batches, r=r):
            for pdf in batches:
                best = []
                for s, k, sizes, elite in zip(pdf["shard"], pdf["island"], pdf["length"], pdf["elite"], strict=True):
                    sizes = [int(x) for x in sizes]
                    own = [[[int(i) for i in g] for g in elite]] if elite is not None else []
                    best.append(evolve(sizes, limit, hash((int(s), int(k), r)), own, GENERATIONS, POPULATION))
                yield pdf.assign(elite=best)

        state = checkpoint(state.repartition(n, "shard", "island").mapInPandas(work, "shard long, island int, row array<long>, length array<long>, elite array<array<int>>"))
        if r + 1 < rounds:
            moved = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), "elite")
            state = state.drop("elite").join(moved, ["shard", "island"])
    return state


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length long and any columns).

    Pieces of full length are sequences of their own. The rest are dealt to shards of bounded size, packed there, and
    the poorly filled sequences of all shards are pooled and packed again, until one shard holds the pool. Repeated
    rows are packed as often as they stand; empty input gives empty output.
    """
    d = checkpoint(pieces.withColumn("row", F.monotonically_increasing_id()))
    full = d.filter(F.col("length") >= limit).select("row", (F.col("row") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, level, done = checkpoint(d.filter(F.col("length") < limit).select("row", "length")), 0, full
    while True:
        n = left.count()
        if not n:
            break
        shards = max(1, -(-n // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        best = _islands(dealt, limit, islands, rounds)

        def lay(batches, level=level):
            for pdf in batches:
                out = []
                for s, rows, sizes, p in zip(pdf["shard"], pdf["row"], pdf["length"], pdf["elite"], strict=True):
                    for b, g in enumerate(p):
                        at, fill = 0, sum(int(sizes[i]) for i in g)
                        for i in g:
                            out.append((int(rows[i]), int(sizes[i]), (level << 56) + (int(s) << 20) + b, at, fill))
                            at += int(sizes[i])
                yield pd.DataFrame(out, columns=["row", "length", "sequence_id", "offset", "fill"])

        top = best.withColumn("_k", F.size("elite")).withColumn("_r", F.expr("row_number() over (partition by shard order by _k, island)")).filter("_r = 1")
        laid = checkpoint(top.select("shard", "row", "length", "elite").mapInPandas(lay, "row long, length long, sequence_id long, offset long, fill long"))
        last = shards == 1 or level >= 6
        loose = F.lit(False) if last else F.col("fill") < int(limit * 0.98)
        done = done.unionByName(laid.filter(~loose).select("row", "sequence_id", "offset"))
        if last:
            break
        left, level = laid.filter(loose).select("row", "length"), level + 1
    return d.join(done, "row").drop("row")


def pack_bulletins(bulletins: DataFrame, tokenizer: str = "word_bpe_49k.json", key: str = "incident_id", text: str = "message", limit: int = LIMIT) -> DataFrame:
    """Bulletins as token pieces in sequences: key, piece, start, length, ids_crc32, sequence_id, offset.

    A text is its ids and an end id; only texts beyond the limit are cut. Null and empty texts are the end id alone,
    null keys stay null, repeated rows are packed each; an empty table gives no rows; other columns are left out.
    """
    p = pack_pieces(token_pieces(bulletins, tokenizer, key, text, limit), limit)
    return p.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
