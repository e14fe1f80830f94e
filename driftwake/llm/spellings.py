"""Spelling variants of names: PartEnum signatures over letter multisets, joined by equality and verified."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm.words import mix
from driftwake.session import checkpoint

#: Letters and their repeats are dealt into so many parts. A replaced letter changes two places at most: any two parts are left out.
PARTS = 7
#: A letter more or less changes one place: one of these groups of parts is left out.
GROUPS = ((0, 1), (2, 3), (4, 5), (6,))
REPLACED = tuple(combinations(range(PARTS), PARTS - 2))
#: First signature that two names share when these two parts differ.
SHARED = {(p, q): next(i for i, c in enumerate(REPLACED) if p not in c and q not in c) for p in range(PARTS) for q in range(PARTS)}
GROUP_OF = {p: len(REPLACED) + g for g, parts in enumerate(GROUPS) for p in parts}
#: A variant is so many times rarer than its form.
RATIO = 10
#: Names of one signature that a task holds; more go on by their one-letter deletions, which few names share.
HOT = 50_000
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def part_of(letter: int, k):
    """Part of the k-th occurrence of a letter; frequent letters and their repeats fall into different parts."""
    return (letter + 3 * k) % PARTS


def signatures(names: list[str]) -> np.ndarray:
    """Signatures of names: (names, columns) of 64-bit hashes, equal only within a column. The columns are REPLACED (with the length), then for
    each of GROUPS one as the shorter name of a pair and one as the longer.

    The letter multiset is a binary vector with a place for every (letter, how many-th). A part is told by the sum of its
    places' hashes; sums that meet by chance only cost a check.
    """
    n = len(names)
    cp = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, names), np.int64, n)
    who = np.repeat(np.arange(n), length)
    order = np.lexsort((cp, who))
    cp, who, at = cp[order], who[order], np.arange(len(cp))
    fresh = np.ones(len(cp), bool)
    fresh[1:] = (cp[1:] != cp[:-1]) | (who[1:] != who[:-1])
    k = at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1
    sums = np.zeros(n * PARTS, np.uint64)
    np.add.at(sums, who * PARTS + part_of(cp, k), mix((cp * (1 << 24) + k).astype(np.uint64)))
    sums = sums.reshape(n, PARTS)

    def told(column: int, parts, size: np.ndarray) -> np.ndarray:
        h = mix((size * 1024 + column).astype(np.uint64))
        for p in parts:
            h = mix(h ^ sums[:, p])
        return h

    out = [told(i, c, length) for i, c in enumerate(REPLACED)]
    for g, left_out in enumerate(GROUPS):
        rest = [p for p in range(PARTS) if p not in left_out]
        out += [told(len(REPLACED) + g, rest, length), told(len(REPLACED) + g, rest, length - 1)]
    return np.stack(out, axis=1)


COLUMNS = (*range(len(REPLACED)), *(len(REPLACED) + g for g in range(len(GROUPS)) for _ in (0, 1)))


def _deletions(w: str) -> list[str]:
    return [w[:i] + w[i + 1:] for i in range(len(w))]


def _once(a: str, b: str, column: int) -> bool:
    """Whether this column is the first that the two near names share, so that each pair comes out once."""
    if len(a) != len(b):
        longer, shorter = (a, b) if len(a) > len(b) else (b, a)
        x = next((x for x, y in zip(longer, shorter, strict=False) if x != y), longer[-1])
        # the extra letter: the first that differs in number
        x = x if longer.count(x) != shorter.count(x) else next(c for c in longer if longer.count(c) != shorter.count(c))
        return GROUP_OF[int(part_of(ord(x), longer.count(x)))] == column
    x, y = next((x, y) for x, y in zip(a, b, strict=True) if x != y)
    return SHARED[int(part_of(ord(x), a.count(x))), int(part_of(ord(y), b.count(y)))] == column


def _near_in_group(group: list[tuple[str, int]], column: int):
    """Near pairs of one signature: replacements among names of one length, or a name and its deletions."""
    if column >= len(REPLACED):
        short = min(len(w) for w, _ in group)
        known = {w: n for w, n in group if len(w) == short}
        for w, n in group:
            if len(w) > short:
                for v in set(_deletions(w)):
                    if v in known:
                        yield w, n, v, known[v]
    elif len(group) <= 12:
        for i, (a, n) in enumerate(group):
            for b, m in group[:i]:
                if sum(map(ne, a, b)) == 1:
                    yield a, n, b, m
    else:
        rest = defaultdict(list)
        for w, n in group:
            for i, v in enumerate(_deletions(w)):
                rest[i, v].append((w, n))
        for same in rest.values():
            for i, (a, n) in enumerate(same):
                for b, m in same[:i]:
                    yield a, n, b, m


PAIR = "a string, b string, n_a long, n_b long, v string, c int"


def _pairs(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "b", "n_a", "n_b", "v", "c"])


def near_names(names: DataFrame, name: str = "vessel_name", n: str = "n_reports", hot: int = HOT) -> DataFrame:
    """Pairs of names exactly one inserted, deleted or replaced code point apart: a, b, n_a, n_b with a < b, each once.

    Names must be distinct. Names meet by signature, sorted, so a task holds one signature's names at a time. Within a signature they meet by
    their deletions, not each with each. A signature with over ``hot`` names is not held: its names go on to a second
    exchange by deletion, which at most a few names for each letter of the alphabet share; no pair is lost.
    """
    def tell(batches):
        for b in batches:
            w, k = b.column(0), b.column(1)
            for lo in range(0, len(w), 4096):
                part = w.slice(lo, 4096)
                s = signatures(part.to_pylist())
                who = pa.array(np.repeat(np.arange(len(part)), s.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(s.ravel().view(np.int64)), pa.array(np.tile(np.array(COLUMNS, np.int8), len(part))), part.take(who), k.slice(lo, 4096).take(who)],
                                                 ["s", "c", "w", "n"])

    def meet(batches):
        out: list = []
        key, held, crowded = None, [], False

        def settle():
            if crowded:
                pass
            elif len(held) > 1:
                for a, x, b, y in _near_in_group(held, key[1]):
                    if _once(a, b, key[1]):
                        out.append((a, b, x, y, None, None) if a < b else (b, a, y, x, None, None))

        def send(w, x, c):
            if c < len(REPLACED):
                out.extend((w, None, x, None, f"{i}:{v}", c) for i, v in enumerate(_deletions(w)))
            else:
                out.extend((w, None, x, None, v, c) for v in {w, *_deletions(w)})

        for b in batches:
            s, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])
            edge = (starts == 0) | (ends == len(s))
            for lo, hi in zip(*(v[edge | (ends - starts > 1)].tolist() for v in (starts, ends)), strict=True):
                now = (int(s[lo]), int(c[lo]))
                if now != key:
                    settle()
                    key, held, crowded = now, [], False
                rows = zip(b.column(2).slice(lo, hi - lo).to_pylist(), b.column(3).slice(lo, hi - lo).to_pylist(), strict=True)
                if not crowded:
                    held.extend(rows)
                    rows = ()
                    if len(held) > hot:
                        rows, held, crowded = held, [], True
                for w, x in rows if crowded else ():
                    send(w, x, key[1])
                    if len(out) > 20_000:
                        yield _pairs(out)
                        out.clear()
                if len(out) > 20_000:
                    yield _pairs(out)
                    out.clear()
        settle()
        if out:
            yield _pairs(out)

    def split(batches):
        out: list = []
        key, held = None, []

        def settle():
            if key is None:
                return
            if key[1] < len(REPLACED):
                found = ((a, x, b, y) for i, (a, x) in enumerate(held) for b, y in held[:i] if a != b)
            else:
                found = ((a, x, b, y) for b, y in held if b == key[0] for a, x in held if len(a) > len(b))
            out.extend((a, b, x, y, None, None) if a < b else (b, a, y, x, None, None) for a, x, b, y in found if _once(a, b, key[1]))

        for b in batches:
            for w, x, v, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (v, c) != key:
                    settle()
                    key, held = (v, c), []
                    if len(out) > 20_000:
                        yield _pairs(out)
                        out.clear()
                held.append((w, x))
        settle()
        if out:
            yield _pairs(out)

    d = names.select(F.col(name).alias("w"), F.col(n).cast("long").alias("n"))
    told = d.mapInArrow(tell, "s long, c byte, w string, n long").repartition("s").sortWithinPartitions("s")
    met = checkpoint(told.mapInArrow(meet, PAIR))
    crowded = met.filter("v is not null").select(F.col("a").alias("w"), F.col("n_a").alias("n"), "v", "c").distinct()
    more = crowded.repartition("v", "c").sortWithinPartitions("v", "c").mapInArrow(split, PAIR)
    return met.filter("v is null").unionByName(more.distinct()).select("a", "b", "n_a", "n_b")


def spelling_forms(names: DataFrame, name: str = "vessel_name", n: str = "n_reports", ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """For every name its usual form: name, form, root, n, n_near, form_n.

    ``form`` is the near name (one code point inserted, deleted or replaced) with the most reports, ties by code points,
    if it has at least ``ratio`` times the reports of the name, else null; ``root`` follows the forms to the last.
    Rows of one name are added up; null names, null counts and names without any report are left out; an empty table
    gives no rows; the empty name is a name; other columns are ignored.
    """
    d = names.select(F.col(name).alias("w"), F.col(n).cast("long").alias("n")).filter("w is not null and n is not null")
    d = checkpoint(d.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 0"))
    p = near_names(d, "w", "n", hot)
    both = p.select(F.col("a").alias("w"), F.col("n_a").alias("n"), F.col("b").alias("o"), F.col("n_b").alias("m"))
    both = both.union(p.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("w", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("best"))
    good = -F.col("best.m") >= F.col("n") * ratio
    best = checkpoint(best.select("w", "n_near", F.when(good, F.col("best.o")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    # forms grow by the ratio at each step, so a chain has at most log(most reports) steps; its length doubles each round
    root = best.filter("form is not null").select("w", F.col("form").alias("root"))
    steps = math.log(max(d.agg(F.max("n")).first()[0] or 1, 2)) / math.log(max(ratio, 1.0001))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        root = checkpoint(root.join(root.select(F.col("w").alias("root"), F.col("root").alias("further")), "root", "left").select("w", F.coalesce("further", "root").alias("root")))
    return d.join(best, "w", "left").join(root, "w", "left").select(
        F.col("w").alias(name), "form", F.coalesce("root", "w").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def count_words(bulletins: DataFrame, key: str = "incident_id", text: str = "message", slip: int = 31, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """Words of messages with their counts (vessel_name, n_reports): runs of Latin letters, A-Z lower-cased.

    Where ``slip`` divides the crc32 of ``<key>:<run>``, the run has lost the letter at that crc32 modulo its length, as a
    sender's slip would. Words under ``least_length`` code points or ``least_count`` occurrences are left out. Null text
    has no words; a null key counts as empty text.
    """
    long = F.filter(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0)), lambda r: F.length(r) >= least_length)
    d = bulletins.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(long).alias("r"))
    d = d.select("k", F.translate("r", UPPER, LOWER).alias("r"))
    d = d.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "r").cast("binary")))
    at = (F.col("h") % F.length("r")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("r", F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))).otherwise(F.col("r"))
    d = d.select(word.alias("vessel_name")).filter(F.length("vessel_name") >= least_length)
    return d.groupBy("vessel_name").agg(F.count(F.lit(1)).alias("n_reports")).filter(F.col("n_reports") >= least_count)
