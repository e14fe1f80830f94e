"""Removal of long word spans that stand elsewhere too: suffix automata over reference shards, matched by streamed spans."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm import tables
from driftwake.llm.words import EXACT, batches_of_words, mix, window_hashes
from driftwake.session import checkpoint

WINDOW, ANCHOR = 35, 8
SHARD_WORDS = 40_000
U = np.uint64


def owners(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash and anchor place of every window of one text: the window's least k-gram (its leftmost least place).

    It depends on the window's words alone, so equal windows have equal anchors wherever they stand.
    """
    if len(h) < window:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = mix(window_hashes(h, k))
    view = np.lib.stride_tricks.sliding_window_view(g, window - k + 1)
    at = view.argmin(1)
    place = at + np.arange(len(at))
    return g[place], place


class Automaton:
    """Suffix automaton of a word sequence, with how often each state's words occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.cnt, self.last = [-1], [0], [0], 0

    def extend(self, c, weight: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.cnt.append(weight)
        p = self.last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.cnt.append(0)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def close(self) -> Automaton:
        for v in np.argsort(np.array(self.len), kind="stable")[::-1].tolist():
            if self.link[v] >= 0:
                self.cnt[self.link[v]] += self.cnt[v]
        return self

    def repeated_ends(self, words: list, window: int, least: int) -> list[int]:
        """Ends of the windows that occur at least ``least`` times here, from the matching statistics of the words."""
        v, n, out = 0, 0, []
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            while self.link[v] >= 0 and self.len[self.link[v]] >= window:
                v = self.link[v]
                n = self.len[v]
            if n >= window and self.cnt[v] >= least:
                out.append(i)
        return out


def shard_repeats(segments: list[tuple[tuple, int]], window: int) -> list[list[int]]:
    """For each distinct segment (words, copies): starts of its windows that occur elsewhere. Reference shards are bounded;
    every segment is streamed past every shard of its bucket that holds its anchor."""
    hits: list[set] = [set() for _ in segments]
    lo = 0
    while lo < len(segments):
        hi, size, a = lo, 0, Automaton()
        while hi < len(segments) and (size < SHARD_WORDS or hi == lo):
            words, copies = segments[hi]
            for c in words:
                a.extend(c, min(copies, 2))
            a.extend(("|", hi), 0)
            size += len(words)
            hi += 1
        a.close()
        for i, (words, _) in enumerate(segments):
            for e in a.repeated_ends(words, window, 2 if lo <= i < hi else 1):
                hits[i].add(e - window + 1)
        lo = hi
    return [sorted(x) for x in hits]


def repeated_spans(bulletins: DataFrame, text: str = "message", window: int = WINDOW) -> DataFrame:
    """Repeated windows by text: text_key and the starts (array<int>) of its windows that stand anywhere else.

    First every window's anchor is counted over all texts; only windows around anchors that occur twice go on, as
    segments, to the bucket of their anchor, where automata over bounded reference shards decide. Equal segments of a
    task travel once with their number, so a passage that stands everywhere is one row per task.
    """
    d = bulletins.select(tables.text_key(text).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = tables.buckets_for(tables.text_volume(bulletins, text), 8 << 20)

    def ask(batches):
        for b in batches:
            keys, grams, seen = b.column(0).to_pylist(), [], []
            for w in batches_of_words(b.column(1), EXACT):
                for i in range(w.lo, w.hi):
                    g, place = owners(w.hashes[w.of(i)], window, ANCHOR)
                    u = np.unique(place, return_index=True)[1]
                    grams.append(g[u])
                    seen.append(np.full(len(u), i))
            del keys
            a = np.concatenate(grams) if grams else np.zeros(0, U)
            u, c = np.unique(a, return_counts=True)
            c = np.minimum(c, 2).astype(np.uint8)
            for bucket, at in tables.in_buckets(u, n):
                yield (bucket, tables.raw(u[at]), tables.raw(c[at])), 9 * len(at)

    asked = tables.by_arrow(d, ask, "bucket int, g binary, c binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        g, c = np.concatenate([tables.array(x, U) for x in pdf["g"]]), np.concatenate([tables.array(x, np.uint8) for x in pdf["c"]])
        u, inv = np.unique(g, return_inverse=True)
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "g": [tables.raw(u[np.bincount(inv, c) >= 2])]})

    known = checkpoint(asked.groupBy("bucket").applyInPandas(answer, "bucket int, g binary"))
    size = known.agg(F.sum(F.octet_length("g"))).first()[0] or 0
    # The repeated anchors as a filter: whole while they fit, else a bitmap of fixed size (it only lets more segments through).
    bits = None
    if size <= tables.BROADCAST_LIMIT:
        parts = [tables.array(r.g, U) for r in known.select("g").toLocalIterator()]
        repeated = np.sort(np.concatenate(parts)) if parts else np.zeros(0, U)
    else:
        bits = np.zeros(tables.BROADCAST_LIMIT, np.uint8)
        for r in known.select("g").toLocalIterator():
            x = tables.array(r.g, U) % U(len(bits) * 8)
            np.bitwise_or.at(bits, (x >> U(3)).astype(np.int64), (1 << (x & U(7)).astype(np.uint8)).astype(np.uint8))
        repeated = bits
    shared = bulletins.sparkSession.sparkContext.broadcast((bits is not None, repeated))

    def is_repeated(g: np.ndarray) -> np.ndarray:
        bitmap, r = shared.value
        if bitmap:
            x = g % U(len(r) * 8)
            return (r[(x >> U(3)).astype(np.int64)] >> (x & U(7)).astype(np.uint8)) & 1 == 1
        if not len(r):
            return np.zeros(len(g), bool)
        return r[np.minimum(np.searchsorted(r, g), len(r) - 1)] == g

    def segments(batches):
        for b in batches:
            keys, found = b.column(0).to_pylist(), defaultdict(list)
            for w in batches_of_words(b.column(1), EXACT):
                for i in range(w.lo, w.hi):
                    h = w.hashes[w.of(i)]
                    g, place = owners(h, window, ANCHOR)
                    if not len(g):
                        continue
                    cut = np.flatnonzero(np.diff(place)) + 1
                    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
                    for s in np.flatnonzero(is_repeated(g[lo])):
                        a, z = int(lo[s]), int(hi[s])
                        found[(int(g[a]), h[a:z + window - 1].tobytes())].append((keys[i], a))
            for (g, words), who in found.items():
                yield (g % n, g - (1 << 63), words, [k for k, _ in who], [a for _, a in who]), len(words) + 12 * len(who)

    sent = tables.by_arrow(d, segments, "bucket int, g long, words binary, ks array<long>, starts array<int>")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        group: dict = {}
        for g, words, ks, starts in zip(pdf["g"], pdf["words"], pdf["ks"], pdf["starts"], strict=True):
            group.setdefault((g, words), []).extend(zip(ks, starts, strict=True))
        names = sorted(group)
        out = defaultdict(list)
        chunks, at = [], 0
        while at < len(names):  # whole anchors only: windows of one anchor meet in one call
            end = min(at + 800, len(names))
            while end < len(names) and names[end][0] == names[end - 1][0]:
                end += 1
            chunks.append(names[at:end])
            at = end
        for chunk in chunks:
            hits = shard_repeats([(tables.array(w, U).tolist(), len(group[(g, w)])) for g, w in chunk], window)
            for name, starts in zip(chunk, hits, strict=True):
                for k, a in group[name] if starts else ():
                    out[k] += [a + s for s in starts]
        return pd.DataFrame({"text_key": pd.Series(list(out), dtype="int64"), "starts": pd.Series([sorted(set(v)) for v in out.values()], dtype=object)})

    return sent.groupBy("bucket").applyInPandas(decide, "text_key long, starts array<int>")


def strip_repeated_spans(bulletins: DataFrame, key: str = "incident_id", text: str = "message", window: int = WINDOW) -> DataFrame:
    """Bulletins without words covered by a window that starts anywhere else: key, n_words, n_removed, text (words joined by a blank).

    Every copy goes, the first too. Null texts have no words; texts shorter than the window keep theirs; repeated rows
    are each other's copies; null keys stay; an empty table gives no rows; other columns are left out.
    """
    spans = checkpoint(repeated_spans(bulletins, text, window))
    spans = spans.groupBy("text_key").agg(F.flatten(F.collect_set("starts")).alias("starts"))
    d = bulletins.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"), tables.text_key(text).alias("text_key"))
    d = tables.join_small(d, checkpoint(spans), "text_key", "left", 400).select("key", "t", "starts")

    def cut(batches):
        for b in batches:
            keys, starts = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, t in enumerate(b.column(1).to_pylist()):
                words = t.encode().split()
                kept = words
                if starts[i]:
                    gone = np.zeros(len(words) + window + 1, np.int64)
                    s = np.unique(np.array(starts[i]))
                    gone[s] += 1
                    gone[s + window] -= 1
                    gone = np.cumsum(gone)
                    kept = [w for w, x in zip(words, gone, strict=False) if not x]
                yield (keys[i], len(words), len(words) - len(kept), b" ".join(kept).decode()), len(t) + 40

    kind = dict(d.dtypes)["key"]
    out = tables.by_arrow(d, cut, f"key {kind}, n_words long, n_removed long, kept string")
    return out.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept").alias(text))
