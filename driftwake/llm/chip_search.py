"""Exact top-k inner products of chip vectors: dual-tree search over cover trees of query and data blocks."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.session import checkpoint, spread

#: Rows of a leaf; rows of a data and of a query block; greedy covers tried before a node without structure stays a leaf.
LEAF, DATA_BLOCK, QUERY_BLOCK, COVERS = 64, 8192, 256, 24


class CoverTree:
    """Cover tree over the rows of x. Nodes are runs of ``order`` with a centre (one of their rows) and a covering radius; the children of a
    node cover it at half its radius. A node that half-radius balls hardly gather has no structure to search and is a leaf, whatever its size."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.radius, self.centre, self.children = [], [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            self._grow(x, 0, len(x))
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1)) if len(x) else np.zeros(0)

    def _grow(self, x: np.ndarray, lo: int, hi: int) -> int:
        rows = self.order[lo:hi]
        dist = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1))
        node, radius = len(self.lo), float(dist.max())
        for a, v in ((self.lo, lo), (self.hi, hi), (self.radius, radius), (self.centre, int(rows[0])), (self.children, [])):
            a.append(v)
        if hi - lo <= LEAF or not 0 < radius < np.inf:
            return node
        left, groups = rows, []
        while len(left):
            near = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1)) <= radius / 2
            groups.append(left[near])
            left = left[~near]
            if len(groups) == COVERS and len(left) > len(rows) // 2:
                return node
        self.order[lo:hi] = np.concatenate(groups)
        for g in groups:
            self.children[node].append(self._grow(x, lo, lo + len(g)))
            lo += len(g)
        return node


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exactly: in doubles, 64-bit or unbounded integers, by how large they can get."""
    with np.errstate(over="ignore"):
        most = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object)
    return whole(q) @ whole(x).T


class Nearest:
    """The k best of each query so far, over any number of data blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.tree = ids, q, k, CoverTree(q)
        self.best: list[tuple | None] = [None] * len(ids)
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = ids != self.ids[i]
        if self.best[i] is not None and len(self.best[i][0]) == self.k:
            ok &= scores >= self.best[i][0][-1]
        if not ok.any():
            return
        scores, ids = scores[ok], ids[ok]
        if len(scores) > 4 * self.k and scores.dtype != object:
            top = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[top], ids[top]
        if self.best[i] is not None:
            scores, ids = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids])
        first = np.lexsort((ids, -scores))[:self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:self.k])
        self.best[i] = scores[first], ids[first]
        if len(first) == self.k:
            kth = scores[first[-1]]
            self.worst[i] = -np.inf if kth < -10**308 else float(min(kth, 10**308))  # a lower bound where a double cannot hold it

    def search(self, x: np.ndarray, ids: np.ndarray, t: CoverTree) -> None:
        """Meets a data block: node pairs are left out when no inner product between them can reach any query's worst kth score."""
        a = self.tree
        todo = [(0, 0)] if len(self.ids) and len(ids) else []
        while todo:
            u, v = todo.pop()
            rows = a.order[a.lo[u]:a.hi[u]]
            with np.errstate(over="ignore", invalid="ignore"):
                centre, reach = float(self.q[a.centre[u]] @ x[t.centre[v]]), a.norm[u] * t.norm[v]
                most = centre + a.radius[u] * t.norm[v] + t.radius[v] * a.norm[u] + a.radius[u] * t.radius[v]
                if most < self.worst[rows].min() - 1e-9 * (1 + reach + abs(most)):
                    continue
            if not a.children[u] and not t.children[v]:
                at = t.order[t.lo[v]:t.hi[v]]
                for i, s in zip(rows.tolist(), exact_scores(self.q[rows], x[at]), strict=True):
                    self.offer(i, s, ids[at])
            elif a.children[u] and (not t.children[v] or a.radius[u] >= t.radius[v]):
                todo += [(c, v) for c in a.children[u]]
            else:  # the nearest child is popped first
                todo += [(u, c) for c in sorted(t.children[v], key=lambda c: float(self.q[a.centre[u]] @ x[t.centre[c]]))]


def sortable(s: int) -> str:
    """Text that sorts as the integer does, however large."""
    digits = str(abs(s))
    return f"1{len(digits):06}{digits}" if s >= 0 else f"0{999_999 - len(digits):06}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _packed(m: np.ndarray) -> bytes:
    """A matrix of whole doubles in the smallest type that holds it."""
    most = np.abs(m).max(initial=0.0)
    kind = next((k for k, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= top), "f8")
    return pickle.dumps(m.astype(kind))


def nearest_chips(chips: DataFrame, queries: DataFrame, k: int = 20, key: str = "chip_id", vector: str = "vector", scale: int = 64) -> DataFrame:
    """The k best chips of every query chip by integer inner product: query_id, rank, <key>, score.

    Both tables hold key (any orderable type) and vector; components become floor(scale * x). Rows with a null key, or a vector that is
    null, empty or holds a null or non-finite component, take no part; every finite one does, and order is exact at any size (scores
    beyond 64 bits are reported as the nearest 64-bit value). Only vectors of equal length meet. Rows that
    repeat a key stand for themselves in the data; as queries they count once, with their least vector. Ties go to the smaller key.

    Each block's tree is built once. A task takes one block of queries past a run of data blocks, one after the other, and carries every
    query's kth score along, so later blocks meet tight bounds; its memory is two blocks.
    """
    kind = dict(chips.dtypes)[key]

    def usable(d: DataFrame) -> DataFrame:
        d = d.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        return d.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite).withColumn("dim", F.size("v"))

    def blocks(d: DataFrame, size: int, row) -> tuple[DataFrame, int]:
        n = max(1, -(-d.count() // size))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.floor(np.stack(pdf["v"].to_list()) * scale)
            return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_list()], "m": [_packed(m)], "tree": [pickle.dumps(CoverTree(m).__dict__)]})

        dealt = d.withColumn("block", F.pmod(F.xxhash64(row), F.lit(n)))
        return checkpoint(dealt.groupBy("dim", "block").applyInPandas(build, f"dim int, block long, ids array<{kind}>, m binary, tree binary")), n

    data, n_data = blocks(usable(chips), DATA_BLOCK, F.monotonically_increasing_id())
    asked, n_asked = blocks(usable(queries).groupBy("id", "dim").agg(F.min("v").alias("v")), QUERY_BLOCK, F.col("id"))
    tasks = int(chips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = min(n_data, max(1, -(-tasks // n_asked)))  # few query blocks: the data is cut into runs, so that all tasks have work
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    to = data.withColumn("run", (F.col("block") % runs).cast("int")).withColumn("to", every(n_asked)).select("dim", "to", "run", F.lit(1).alias("side"), "block", "ids", "m", "tree")
    by = asked.withColumn("to", F.col("block").cast("int")).withColumn("run", every(runs)).select("dim", "to", "run", F.lit(0).alias("side"), "block", "ids", "m", F.lit(None).cast("binary").alias("tree"))
    met = spread(to.union(by), "dim", "to", "run").sortWithinPartitions("dim", "to", "run", "side", "block")

    def search(batches):
        now, asked_by = None, None

        def told() -> pd.DataFrame:
            rows = [] if now is None else [(q, v, max(-2**63, min(2**63 - 1, int(s))), sortable(int(s))) for q, b in zip(now.ids.tolist(), now.best, strict=True) if b is not None for s, v in zip(b[0].tolist(), b[1].tolist(), strict=True)]
            return pd.DataFrame(rows, columns=["query_id", key, "score", "_order"])

        for pdf in batches:
            for *group, side, ids, m, tree in zip(*(pdf[c] for c in ("dim", "to", "run", "side", "ids", "m", "tree")), strict=True):
                x, ids = pickle.loads(m).astype(float), np.array(list(ids))
                if side == 0:
                    yield told()
                    now, asked_by = Nearest(ids, x, k), group
                elif group == asked_by:
                    t = CoverTree.__new__(CoverTree)
                    t.__dict__ = pickle.loads(tree)
                    now.search(x, ids, t)
        yield told()

    found = met.mapInPandas(search, f"query_id {kind}, `{key}` {kind}, score long, _order string")
    ranked = found.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by _order desc, `{key}`)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
