"""Small Spark helpers of the corpus operators: bucketed binary shuffles, checked broadcasts, components, text keys."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.session import checkpoint

#: Most bytes that any broadcast of these operators may hold; larger tables are joined by a shuffle.
BROADCAST_LIMIT = 48 << 20
U = np.uint64


def raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def array(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, kind)


def text_key(name: str):
    """Two hashes of a text; equal texts share it, whatever row or copy they stand in."""
    c = F.coalesce(F.col(name), F.lit(""))
    return F.xxhash64(c, F.octet_length(c))


def text_volume(df: DataFrame, name: str) -> int:
    """UTF-8 bytes of a text column over the whole table."""
    return df.agg(F.sum(F.octet_length(name))).first()[0] or 0


def buckets_for(volume: int, each: int, least: int = 12) -> int:
    """Number of buckets so that one holds about ``each`` units; it follows the volume, so buckets stay bounded."""
    return max(least, -(-volume // each))


def join_small(big: DataFrame, small: DataFrame, on, how: str, width: int) -> DataFrame:
    """Join with a stored table: broadcast while its rows times ``width`` bytes stay under the limit, else shuffled."""
    fits = small.count() * width <= BROADCAST_LIMIT
    return big.join(F.broadcast(small) if fits else small, on, how)


class Shared:
    """A broadcast of any object of this package. Spark pickles broadcasts by reference, so workers without the package could not
    read one; the bytes are made by value here and opened once in each worker process."""

    def __init__(self, df: DataFrame, value):
        self.sent, self._value = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"sent": self.sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self.sent.value)
        return self._value


def by_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, flush: int = 4 << 20) -> DataFrame:
    """mapInArrow over row dictionaries: ``f`` yields (columns, bytes) pieces, put out in batches of bounded size."""
    kinds = [(c.name, c.dataType) for c in _parsed(df, schema)]
    from pyspark.sql.pandas.types import to_arrow_type

    target = pa.schema([(n, to_arrow_type(t)) for n, t in kinds])

    def run(batches):
        rows, size = [], 0
        for row, weight in f(batches):
            rows.append(row)
            size += weight
            if size > flush or len(rows) >= 20_000:
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(target.names)}, schema=target)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(target.names)}, schema=target)

    return df.mapInArrow(run, schema)


def _parsed(df: DataFrame, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def in_buckets(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Positions of the keys by bucket."""
    b = (keys % U(n)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(n + 1))
    return [(k, order[cuts[k]:cuts[k + 1]]) for k in range(n) if cuts[k] < cuts[k + 1]]


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of an edge table (a long, b long): node, root.

    Each round every node moves to its least neighbour and the edges are contracted to those, so hubs collapse at
    once and the number of edges falls at least by a constant factor for ids that are hashes. Only (node, parent)
    pairs are stored per round; the chains are then composed from the last round backwards.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))  # noqa: E731  hashed order: no long descending chains
    e = checkpoint(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    moves = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parent = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(order("node"), F.min(order("b"))).alias("t")).select("node", F.col("t.v").alias("root")))
        moves.append(parent)
        left, right = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(left, "a").join(right, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        e = checkpoint(e.distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    label = moves[-1]
    for m in reversed(moves[:-1]):
        nxt = label.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        label = checkpoint(m.join(nxt, "root", "left").select("node", F.coalesce("_top", "root").alias("root")))
    return label
