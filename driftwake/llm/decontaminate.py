"""Removal of exercise texts from training bulletins: suffix arrays over training shards, searched by every test suffix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwake.llm import tables
from driftwake.llm.words import ALNUM, Words, batches_of_words, text_bytes, split_words

WINDOW = 10
#: Test words that one broadcast holds (8 bytes each); more are searched in further passes over the bulletins.
TEST_WORDS = 1 << 21


class TestSuffixes:
    """Word hashes of the test items laid end to end, with the item and the words left from each position."""

    __test__ = False

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.names = [n for n, _ in items]
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        size = np.array([len(w) for _, w in items], np.int64)
        self.item = np.repeat(np.arange(len(items)), size)
        end = np.repeat(np.cumsum(size), size)
        self.left = end - np.arange(len(self.words))
        self.need = np.minimum(window, np.repeat(size, size))
        self.starts = np.flatnonzero(self.left >= self.need)
        self.heads = np.unique(self.words[self.starts])


def shard_matches(w: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, test suffix) of every occurrence of a test window in one shard of training words.

    The shard's suffix array holds the suffixes that begin with the first word of some test window; others cannot match.
    It is sorted to the depth a window needs, and each test suffix is found by a binary search that narrows the range
    word by word, all test suffixes at once.
    """
    none = np.zeros(0, np.int64)
    if not len(tests.starts) or not len(w.hashes):
        return none, none, none
    depth = int(tests.need.max())
    end = np.repeat(w.offsets[1:], np.diff(w.offsets))
    pos = np.flatnonzero(np.isin(w.hashes, tests.heads))
    vocab = np.unique(tests.words)
    rank = np.searchsorted(vocab, w.hashes)
    rank[rank == len(vocab)] = 0
    rank = np.where(vocab[rank] == w.hashes, rank + 2, 1)  # 1: a word that no test has; 0: after the text's end
    test_rank = np.searchsorted(vocab, tests.words) + 2

    def at(p: np.ndarray, k: int) -> np.ndarray:
        inside = p + k < end[p]
        return np.where(inside, rank[np.minimum(p + k, len(rank) - 1)], 0)

    second = at(pos, 1)
    pos = pos[(second > 1) | (tests.need.min() == 1)]
    columns = [at(pos, k) for k in range(depth)]
    order = np.lexsort(columns[::-1])  # the suffix array, as deep as a window
    array, columns = pos[order], [c[order] for c in columns]
    starts, need = tests.starts, tests.need[tests.starts]
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    for k in range(depth):
        live = np.flatnonzero((need > k) & (lo < hi))
        if not len(live):
            break
        want, col = test_rank[starts[live] + k], columns[k]
        for side, bound in (("left", lo), ("right", hi)):
            a, b = lo[live].copy() if side == "left" else lo_before[live].copy(), hi[live].copy() if side == "left" else hi_before[live].copy()
            if side == "left":
                lo_before, hi_before = lo.copy(), hi.copy()
            while (a < b).any():
                m = (a + b) // 2
                v = col[np.minimum(m, len(col) - 1)]
                right = (v < want) if side == "left" else (v <= want)
                go = a < b
                a = np.where(go & right, m + 1, a)
                b = np.where(go & ~right, m, b)
            bound[live] = a
    size = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(starts)), size)
    if not len(which):
        return none, none, none
    place = array[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    length = need[which].copy()
    grow = np.arange(len(which))
    while len(grow):  # longest verbatim match from there on
        p, q = place[grow] + length[grow], starts[which[grow]] + length[grow]
        ok = (p < end[place[grow]]) & (length[grow] < tests.left[starts[which[grow]]])
        ok[ok] = w.hashes[p[ok]] == tests.words[q[ok]]
        grow = grow[ok]
        length[grow] += 1
    return place, length, starts[which]


MATCH = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest", T.LongType()),
                      T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hits", T.BinaryType())])


def _loaded(exercises: DataFrame, item: str, text: str, window: int) -> list[TestSuffixes]:
    """Test items in blocks that fit a broadcast; the driver sees one block's rows at a time."""
    blocks, current, size = [], [], 0
    for r in exercises.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator(prefetchPartitions=True):
        data, off = text_bytes(pa.array([r.t]))
        h, _, _ = split_words(data, off, ALNUM)
        if len(h):
            current.append((r.i if r.i is not None else "", h))
            size += len(h)
        if size > TEST_WORDS:
            blocks, current, size = [*blocks, TestSuffixes(current, window)], [], 0
    return [*blocks, TestSuffixes(current, window)]


def exercise_overlap(bulletins: DataFrame, exercises: DataFrame, text: str = "message", item: str = "exercise_id", item_text: str = "message",
                     window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, longest (words) and item_ids (sorted) to bulletins; all their columns pass through.

    Null and empty texts have no words and no hits; repeated rows repeat the answer; a null item id counts as empty.
    Columns of the result's names are replaced. A shard is a run of whole texts inside a task, so no text leaves its
    task. Tests beyond one broadcast's size are searched block by block, from the same broadcast list of blocks.
    """
    shared = [tables.Shared(bulletins, b) for b in _loaded(exercises, item, item_text, window)]
    new = ["n_words", "n_hit", "longest", "item_ids"]
    d = bulletins.drop(*new)
    schema = T.StructType([*d.schema.fields, *[f for f in MATCH.fields if f.name != "hits"]])

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.names.index(text))
            out = {n: [] for n in new}
            for w in batches_of_words(col, ALNUM, 1 << 21):
                n = w.hi - w.lo
                hit, longest, found = np.zeros(len(w.hashes) + 1, np.int64), np.zeros(n, np.int64), [set() for _ in range(n)]
                for b in shared:
                    tests = b.value
                    place, length, suffix = shard_matches(w, tests)
                    np.add.at(hit, place, 1)
                    np.add.at(hit, place + length, -1)
                    doc = np.searchsorted(w.offsets, place, "right") - 1
                    np.maximum.at(longest, doc, length)
                    for i, k in set(zip(doc.tolist(), tests.item[suffix].tolist(), strict=True)):
                        found[i].add(tests.names[k])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                out["n_words"] += np.diff(w.offsets).tolist()
                out["n_hit"] += (covered[w.offsets[1:]] - covered[w.offsets[:-1]]).tolist()
                out["longest"] += longest.tolist()
                out["item_ids"] += [sorted(x) for x in found]
            cols = [*batch.columns, pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["longest"], pa.int64()),
                    pa.array(out["item_ids"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *new])

    return d.mapInArrow(run, schema)
