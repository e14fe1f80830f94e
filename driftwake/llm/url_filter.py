"""Block and allow rules over product and provider URLs by a cascade of Bloom filters, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 5
BITS_PER_KEY = 12
#: Largest bitmap in 64-bit words that is sent as a literal; more listed keys are looked up by a join instead.
MAX_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _bitmap(keys: DataFrame, level: int, n: int) -> list[int]:
    """Words of the level's filter over a key column; its size follows the number of listed keys and is checked."""
    words = max(1, -(-n * BITS_PER_KEY // 64))
    if words > MAX_WORDS:
        raise OverflowError("filter too large for a literal")
    bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, words * 64) for i in range(HASHES)])).alias("b")).distinct()
    rows = bits.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
    out = [0] * words
    for r in rows:
        out[r.w] = r.v
    return out


def _holds(key: Column, level: int, words: list[int]) -> Column:
    table, n = F.array(*[F.lit(w).cast("long") for w in words]), len(words) * 64
    tests = [F.expr("true")]
    for i in range(HASHES):
        b = _bit(key, level, i, n)
        tests.append(F.getbit(F.element_at(table, (F.floor(b / 64) + 1).cast("int")), (b % 64).cast("int")) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 32) -> list[list[int]]:
    """Filters by level: listed keys, then the universe's false positives, then listed keys those let through, and so on.

    ``listed`` and ``universe`` hold one column ``key``. The last level has no false positive left in the universe, so
    walking the levels answers membership exactly for every key of the universe.
    """
    inside, outside = listed.select("key").distinct(), universe.select("key").distinct().join(listed.select("key"), "key", "left_anti")
    levels: list[list[int]] = []
    current, other = inside, outside
    for level in range(max_levels):
        n = current.count()
        if not n:
            return levels
        levels.append(_bitmap(current, level, n))
        current, other = other.filter(_holds(F.col("key"), level, levels[-1])), current
    raise RuntimeError("the cascade did not end")


def in_cascade(key: Column, levels: list[list[int]]) -> Column:
    """A key is listed when the first level that does not hold it is an even-numbered false-positive level."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        answer = F.when(_holds(key, level, levels[level]), answer).otherwise(F.lit(level % 2 == 1))
    return answer


def judge_urls(links: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to links (url string). The longest fitting rule decides, else ``default``.

    A rule fits its host and every subdomain when the path starts with the rule's path. Null urls and urls without
    ``://`` have empty host and path and get the default. Repeated rows repeat the answer; an empty table stays empty.
    """
    kept = [c for c in links.columns if c not in ("host", "path", "rule", "verdict")]
    spark = links.sparkSession
    h, p = host_path(F.col("_url"))
    d = links.select(*kept, F.col(url).alias("_url")).select(*kept, h.alias("host"), p.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(r.path) for r in rules})
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.array(*[F.concat(s, F.substring("path", 1, n)) for n in lengths]))))
    listed = spark.createDataFrame([(r.name,) for r in rules], "key string")
    levels = build_cascade(listed, d.select(F.explode(keys).alias("key")))
    hits = F.filter(keys, lambda k: in_cascade(k, levels))
    best = F.element_at(F.sort_array(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False), 1).k
    first = F.get(F.sort_array(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False), F.lit(0)).k
    del best
    d = d.withColumn("rule", first)
    verdict = F.lit(default)
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, r.verdict).otherwise(verdict)
    return d.withColumn("verdict", verdict)
