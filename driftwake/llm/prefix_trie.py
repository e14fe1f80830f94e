"""Prefix trie of incident logs: balanced parentheses per shard, subtrees by findclose, shared spines merged."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.llm import tables
from driftwake.session import checkpoint

#: Bytes of an entry's digest; nodes or logs after which a shard closes; least paths of a shard of spines.
DIGEST, SHARD, LEAST_PATHS = 16, 200_000, 64
#: Positions of a block of the range min-max tree; paths that one task takes at the top.
BLOCK, TOP_PATHS = 64, 1024
SEQ_BUCKET = 256
NONE = np.iinfo(np.int64).max
NODE = "kind byte, log long, depth int, parent long, parent_id binary, n long, children long, leaves long, saved long, ends binary, id binary, seq binary, vals binary"
KIND_NODE, KIND_SPINE, KIND_ENDS = 0, 1, 2


def numbered_entries(entries: DataFrame, log: str = "log_id", seq: str = "seq", who: str = "name", body: str = "body") -> DataFrame:
    """Entries as (log, pos, digest hex, chars), pos from 0 in the order of ``seq``, nulls first, equal ones by digest.

    Positions are counted in (log, range of seq) and shifted by the ranges before, so a long log is not one task.
    """
    w, b = F.coalesce(F.col(who), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w, b).cast("binary"), 256), 1, 2 * DIGEST)
    d = entries.filter(F.col(log).isNotNull()).select(F.col(log).cast("long").alias("log"), F.col(seq).alias("seq"), digest.alias("digest"), F.length(b).alias("chars"))
    d = d.withColumn("range", F.floor(F.col("seq") / SEQ_BUCKET))
    inside = Window.partitionBy("log", "range").orderBy(F.col("seq").asc_nulls_first(), "digest")
    before = Window.partitionBy("log").orderBy(F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.row_number().over(inside) - 1)
    start = d.groupBy("log", "range").agg(F.count(F.lit(1)).alias("rows")).select(F.col("log").alias("l"), F.col("range").alias("r"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return d.join(start, (F.col("log") == F.col("l")) & F.col("range").eqNullSafe(F.col("r"))).select("log", (F.col("start") + F.col("at")).alias("pos"), "digest", "chars")


def branched_logs(numbered: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Every log begins with the first ``shared`` entries of its ``base`` log (all if fewer, none if it is absent) and goes on with its
    own from that position. ``base`` and ``shared`` are expressions over ``log``. Returns (log, seq binary, chars array<int>), logs left without entries too."""
    numbered = checkpoint(numbered)
    logs = checkpoint(numbered.select("log").distinct().withColumns({"base": base, "shared": shared}))
    own = numbered.withColumn("shared", shared).filter(F.col("pos") >= F.col("shared")).drop("shared")
    most = logs.agg(F.max("shared")).first()[0] or 0
    heads = numbered.filter(F.col("pos") < most).select(F.col("log").alias("base"), "pos", "digest", "chars")
    lent = logs.join(heads, "base").filter(F.col("pos") < F.col("shared")).select("log", "pos", "digest", "chars")
    turns = own.union(lent).groupBy("log").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    d = logs.select("log").join(turns, "log", "left")
    joined = F.unhex(F.array_join(F.col("t.digest"), ""))
    return d.select("log", F.coalesce(joined, F.lit(b"")).alias("seq"), F.coalesce(F.col("t.chars"), F.array().cast("array<int>")).alias("chars"))


def find_close(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, open, close) of nodes in preorder: the parentheses (+1, -1), and where each node opens and closes.

    The closing one is the first later position whose excess is below the excess before the opening one. Blocks of
    ``BLOCK`` positions carry their least excess, a tree of pairwise minima stands over the blocks: a node looks in its own block, climbs to
    the first subtree that goes low enough, descends to its block and looks there.
    """
    m = len(depth)
    start = 2 * np.arange(m) - depth
    bits = np.full(-(-2 * m // BLOCK) * BLOCK, -1, np.int8)
    bits[start] = 1
    excess = np.cumsum(bits, dtype=np.int64)
    want = excess[start] - 1
    rows = excess.reshape(-1, BLOCK)
    levels = [rows.min(1)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.append(x, NONE) if len(x) % 2 else x
        levels[-1] = x
        levels.append(x.reshape(-1, 2).min(1))
    close = np.full(m, -1, np.int64)
    column = np.arange(BLOCK)
    for lo in range(0, m, 1 << 15):
        at = np.arange(lo, min(lo + (1 << 15), m))
        block = start[at] // BLOCK
        low = (rows[block] <= want[at, None]) & (column > (start[at] % BLOCK)[:, None])
        first, found = low.argmax(1), low.any(1)
        close[at[found]] = block[found] * BLOCK + first[found]
        at, node, level = at[~found], block[~found], np.zeros((~found).sum(), np.int64)
        going = np.ones(len(at), bool)
        while going.any():  # up: to a right sibling whose subtree goes low enough
            for k in np.unique(level[going]):
                on = np.flatnonzero(going & (level == k))
                nxt = node[on] + 1
                fits = (node[on] % 2 == 0) & (levels[k][np.minimum(nxt, len(levels[k]) - 1)] <= want[at[on]])
                node[on[fits]] += 1
                going[on[fits]] = False
                node[on[~fits]] //= 2
                level[on[~fits]] += 1
        while (level > 0).any():  # down: to the leftmost child that does
            for k in np.unique(level[level > 0]):
                on = np.flatnonzero(level == k)
                left = 2 * node[on]
                node[on] = np.where(levels[k - 1][left] <= want[at[on]], left, left + 1)
                level[on] -= 1
        if len(at):
            close[at] = node * BLOCK + (rows[node] <= want[at, None]).argmax(1)
    return bits[:2 * m], start, close


def _least(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least value of every range [i, i + size[i]), from tables of doubling width."""
    out, width, table = values.copy(), 1, values
    power = np.floor(np.log2(size)).astype(np.int64)
    for k in range(int(power.max()) + 1):
        on = np.flatnonzero(power == k)
        out[on] = np.minimum(table[on], table[on + size[on] - width])
        if 2 * width > len(values):
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class Shard:
    """Trie of one shard in preorder: depth, chars of the last entry, and what ends or hangs at each node (logs, least log, leaves, children, savings)."""

    def __init__(self, depth, chars, ends, least, leaves, children, saved):
        self.depth, self.own = depth, (ends, least, leaves, children, saved)
        m = len(depth)
        bits, start, close = find_close(depth)
        self.size = (close - start + 1) // 2
        order = np.lexsort((np.arange(m), depth))
        span = m + 1
        keys = depth[order] * span + order
        self.parent = np.where(depth > depth[0], keys[np.maximum(np.searchsorted(keys, (depth - 1) * span + np.arange(m)) - 1, 0)] - (depth - 1) * span, -1)
        within = lambda x: (lambda c: c[np.arange(m) + self.size] - c[:-1])(np.concatenate([[0], np.cumsum(x)]))  # noqa: E731  sums over subtrees
        self.n, self.log = within(ends), _least(least, self.size)
        pair = np.zeros(2 * m, np.int64)  # "()" of a node that nothing hangs at is a leaf
        pair[start] = (bits[start + 1] < 0) & (children == 0)
        rank = np.concatenate([[0], np.cumsum(pair)])
        self.leaves = rank[close] - rank[start] + within(leaves)
        self.children = children + np.bincount(self.parent[self.parent >= 0], minlength=m)
        self.saved = within(saved + (self.n - 1) * chars)

    def spine(self, first_depth: int) -> tuple[np.ndarray, list[int], list[int]]:
        """Open nodes (on the first or the last path, which other shards may share), and the nodes of both paths."""
        last, v = [], len(self.depth) - 1
        while v >= 0:
            last.append(v)
            v = int(self.parent[v])
        first = list(range(first_depth + 1))
        is_open = np.zeros(len(self.depth), bool)
        is_open[first] = is_open[last] = True
        return is_open, first, last[::-1]

    def folded(self, is_open: np.ndarray) -> np.ndarray:
        """Values of the open nodes with the closed subtrees below folded in: rows (ends, least, leaves, children, saved)."""
        at = np.flatnonzero(~is_open & (self.parent >= 0))
        at = at[is_open[self.parent[at]]]
        up = self.parent[at]
        out = np.stack([x.astype(np.int64) for x in self.own])
        np.add.at(out[0], up, self.n[at])
        np.minimum.at(out[1], up, self.log[at])
        np.add.at(out[2], up, self.leaves[at])
        np.add.at(out[3], up, 1)
        np.add.at(out[4], up, self.saved[at])
        return out


def _ids(seq: bytes, depths: int) -> list[bytes]:
    """Node ids along a path, from the root: digests of its prefixes."""
    h, out = hashlib.md5(), []
    for d in range(depths + 1):
        out.append(h.digest())
        h.update(seq[d * DIGEST:(d + 1) * DIGEST])
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Entries that two paths share from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    k = 0
    while a[k * DIGEST:(k + 1) * DIGEST] == b[k * DIGEST:(k + 1) * DIGEST]:
        k += 1
    return k


def _batch(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, NODE.split(", "))])
    made = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([made(columns[f.name], f.type) if columns.get(f.name) is not None else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _closed(t: Shard, is_open: np.ndarray, ends: list, path_ids: dict, ids: list | None = None):
    """Batches of the closed nodes. A node below an open one names it by id; ``path_ids`` has those."""
    at = np.flatnonzero(~is_open)
    up = t.parent[at]
    known = (up >= 0) & ~is_open[up]
    for lo in range(0, len(at), 20_000):
        a, u, k = at[lo:lo + 20_000], up[lo:lo + 20_000], known[lo:lo + 20_000]
        yield _batch(len(a), kind=np.zeros(len(a), np.int8), log=t.log[a], depth=t.depth[a].astype(np.int32), parent=pa.array(t.log[u], mask=~k),
                     parent_id=[None if x or p < 0 else path_ids[p] for p, x in zip(u.tolist(), k.tolist(), strict=True)], n=t.n[a], children=t.children[a], leaves=t.leaves[a],
                     saved=t.saved[a], ends=[ends[i] for i in a.tolist()], id=None if ids is None else [ids[i] for i in a.tolist()])


def _spines(t: Shard, chars: np.ndarray, paths: list[tuple[bytes, list[int]]], is_open: np.ndarray):
    """The first and last path with their folded values; nodes of both carry them on the first only."""
    vals = np.vstack([chars[None].astype(np.int64), t.folded(is_open)])
    zero, done = np.array([0, 0, NONE, 0, 0, 0])[:, None], set()
    for seq, nodes in paths[:1] if paths[0] == paths[1] else paths:
        v = vals[:, nodes].copy()
        again = [i for i, x in enumerate(nodes) if x in done]
        v[1:, again] = zero[1:]
        done.update(nodes)
        yield _batch(1, kind=np.array([KIND_SPINE], np.int8), seq=[seq], vals=[tables.raw(v)])


def _log_shards(batches):
    """First level: sorted logs (seq, log, chars) to closed nodes, spines, and the ids that end at open nodes."""
    def close(seqs, logs, chars):
        deep = np.array([len(s) // DIGEST for s in seqs])
        shared = np.array([-1] + [_shared(a, b) for a, b in zip(seqs, seqs[1:], strict=False)])
        new = deep - shared
        last = np.cumsum(new)
        m = int(last[-1])
        depth = np.arange(m) - np.repeat(last - new - shared - 1, new)
        flat, at = np.concatenate([*chars, np.zeros(1, np.int64)]), np.concatenate([[0], np.cumsum(deep)[:-1]])
        length = np.where(depth > 0, flat[np.repeat(at, new) + depth - 1], 0)
        end, who = last - 1, np.array(logs, np.int64)
        ends = np.bincount(end, minlength=m)
        least = np.full(m, NONE)
        np.minimum.at(least, end, who)
        zero = np.zeros(m, np.int64)
        t = Shard(depth, length, ends, least, zero, zero, zero)
        is_open, first, path = t.spine(int(deep[0]))
        ids = dict(zip(first, _ids(seqs[0], len(first) - 1), strict=True)) | dict(zip(path, _ids(seqs[-1], len(path) - 1), strict=True))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1, [len(end)]])
        digest: list = [None] * m
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            text, v = ",".join(map(str, logs[a:b])).encode(), int(end[a])
            if is_open[v]:
                yield _batch(1, kind=np.array([KIND_ENDS], np.int8), log=[logs[a]], id=[ids[v]], ends=[text])
            else:
                digest[v] = hashlib.sha256(text).digest()
        yield from _closed(t, is_open, digest, ids)
        yield from _spines(t, length, [(seqs[0], first), (seqs[-1], path)], is_open)

    seqs, logs, chars, size = [], [], [], 0
    for b in batches:
        offsets, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, (s, g) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            seqs.append(s)
            logs.append(g)
            chars.append(values[offsets[i]:offsets[i + 1]])
            size += len(s) // DIGEST + 1
            if size >= 4 * SHARD or len(seqs) >= SHARD:
                yield from close(seqs, logs, chars)
                seqs, logs, chars, size = [], [], [], 0
    if seqs:
        yield from close(seqs, logs, chars)


def _spine_shards(top: bool):
    """Later levels: sorted spines to closed nodes (at the top all of them) and the spines of the shard."""
    def close(seqs, vals):
        stack: list[int] = []
        where, depth, used = [], [], 0
        for i, s in enumerate(seqs):
            d = len(s) // DIGEST
            k = _shared(seqs[i - 1], s) if i else -1
            stack = stack[:k + 1] + list(range(used, used + d - k))
            depth.append(np.arange(k + 1, d + 1))
            used += d - k
            where.append(np.array(stack))
        at, v = np.concatenate(where), np.concatenate(vals, axis=1)
        chars, ends, leaves, children, saved = (np.zeros(used, np.int64) for _ in range(5))
        least = np.full(used, NONE)
        chars[at] = v[0]
        np.minimum.at(least, at, v[2])
        for out, x in zip((ends, leaves, children, saved), v[[1, 3, 4, 5]], strict=True):
            np.add.at(out, at, x)
        t = Shard(np.concatenate(depth), chars, ends, least, leaves, children, saved)
        is_open, first, path = t.spine(len(seqs[0]) // DIGEST)
        if top:
            is_open[:] = False
        ids: list = [None] * used
        for s, nodes in zip(seqs, where, strict=True):
            for x, i in zip(nodes.tolist(), _ids(s, len(nodes) - 1), strict=True):
                ids[x] = i
        yield from _closed(t, is_open, [None] * used, ids, ids)
        if not top:
            yield from _spines(t, chars, [(seqs[0], first), (seqs[-1], path)], is_open)

    def run(batches):
        seqs, vals, size = [], [], 0
        for b in batches:
            for s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seqs.append(s)
                vals.append(tables.array(v, np.int64).reshape(6, -1))
                size += len(s) // DIGEST + 1
                if not top and size >= SHARD and len(seqs) >= LEAST_PATHS:
                    yield from close(seqs, vals)
                    seqs, vals, size = [], [], 0
        if seqs:
            yield from close(seqs, vals)

    return run


def _joined_ends(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node shared by shards: its pieces are hashed in order, one after the other."""
    def run(batches):
        now, h = None, None
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i == now:
                    h.update(b"," + text)
                else:
                    if now is not None:
                        out.append((now, h.digest()))
                    now, h = i, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["id", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.digest()], pa.binary())], ["id", "ends"])

    d = pieces.repartition("id").sortWithinPartitions("id", "log").select("id", "ends")
    return d.mapInArrow(run, "id binary, ends binary")


def log_trie(logs: DataFrame) -> DataFrame:
    """Trie of the distinct beginnings of logs (log, seq binary, chars array<int>; see ``branched_logs``): a row for each node.

    log_id (least member), depth, parent_log_id (null at the root), n_logs (logs that begin so), n_children, n_leaves
    (childless nodes in the subtree), saved_chars (over the subtree, (n_logs - 1) times the characters of the node's last entry)
    and ends_sha256 (of the ids of logs that end here, in decimal, ascending, comma-joined).

    Logs are sorted by their entries' digests; a shard is a run of them, so a beginning shared by a third of all logs
    spans many shards. In a shard the trie is a sequence of balanced parentheses; findclose delimits each subtree, and ranks
    and cumulative arrays give its figures. Only the first and the last path of a shard can go on in another one. These
    spines, with the closed subtrees folded in, are the next level's logs, until one task holds the rest: at most
    ``TOP_PATHS`` paths. Digests have 128 bits. A log is one row of 20 bytes an entry. An empty table gives no rows.
    """
    spark = logs.sparkSession
    sort = ("seq", "log")
    level = checkpoint(logs.select("seq", "log", "chars").repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_log_shards, NODE))
    ends = _joined_ends(level.filter(F.col("kind") == KIND_ENDS).select("id", "log", "ends"))
    done, upper = level.filter(F.col("kind") == KIND_NODE), None
    while True:
        spines = level.filter(F.col("kind") == KIND_SPINE).select("seq", "vals")
        n = spines.count()
        if n == 0:
            break
        top = n <= TOP_PATHS
        parts = min(max(n // TOP_PATHS, 1), int(spark.conf.get("spark.sql.shuffle.partitions")))  # each leaves two paths and two more for LEAST_PATHS, so n falls
        dealt = spines.coalesce(1) if top else spines.repartitionByRange(parts, "seq", "vals")
        level = checkpoint(dealt.sortWithinPartitions("seq", "vals").mapInArrow(_spine_shards(top), NODE))
        closed = level.filter(F.col("kind") == KIND_NODE)
        upper = closed if upper is None else upper.union(closed)
        if top:
            break
    columns = ("log", "depth", "parent", "parent_id", "n", "children", "leaves", "saved", "ends")
    if upper is None:
        nodes = done.select(*columns)
    else:
        upper = checkpoint(upper.drop("ends").join(ends, "id", "left"))
        parents = upper.select(F.col("id").alias("parent_id"), F.col("log").alias("above"))
        both = done.select(*columns).unionByName(upper.select(*columns))
        if upper.count() * 64 <= tables.BROADCAST_LIMIT:
            nodes = both.join(F.broadcast(parents), "parent_id", "left")
        else:  # most children of open nodes may be the root's: dealt over salts
            salts = F.explode(F.sequence(F.lit(0), F.lit(31)))
            nodes = both.withColumn("salt", F.pmod(F.xxhash64("log", "depth"), F.lit(32)).cast("int")).join(parents.withColumn("salt", salts), ["parent_id", "salt"], "left")
        nodes = nodes.withColumn("parent", F.coalesce("parent", "above"))
    return nodes.select(F.col("log").alias("log_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_log_id"), F.col("n").alias("n_logs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_chars"),
                        F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
