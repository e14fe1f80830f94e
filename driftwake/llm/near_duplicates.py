"""Near-duplicate bulletins by exact Jaccard join of word shingles over a token-group matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm import tables
from driftwake.llm.words import FOLDED, batches_of_words, grams, mix
from driftwake.session import checkpoint, release

SHINGLE = 5
GROUP = 32
#: From how many bulletins on a token counts as frequent; a larger number is taken where the list would be too large to broadcast.
FREQUENT = (24, 96, 384, 1536, 6144, 24576)
U = np.uint64
#: Hashes below which tokens are counted. A link needs the least quarter of a set's hashes, of small sets up to two fifths.
COUNTED = U(1 << 63)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, U)
    if len(h) < k:
        return np.array([mix(np.bitwise_xor.reduce(h * np.arange(3, 3 + 2 * len(h), 2, dtype=U))[None] + U(len(h)))[0]], U)
    return np.unique(grams(h, k))


def fingerprint(m: np.ndarray) -> int:
    """Name of a set, given its mixed hashes: equal sets share it."""
    return int(mix(np.array([np.bitwise_xor.reduce(m) + U(len(m))], U)).view(np.int64)[0]) if len(m) else 0


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of one group as (token number, set number) pairs over their union."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return *np.unique(np.concatenate(sets), return_inverse=True), which


def links_within(sets: list[np.ndarray], names: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join a group's sets; pairs that are joined already are not looked at again."""
    union, token, which = overlaps(sets)
    size, root, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    ends = np.cumsum(size)
    for i in range(1, len(sets)):
        flag = np.zeros(len(union), bool)
        flag[token[ends[i] - size[i]:ends[i]]] = True
        common = np.bincount(which[:ends[i - 1]], flag[token[:ends[i - 1]]], minlength=i)[:i].astype(np.int64)
        for j in np.flatnonzero(100 * common >= percent * (size[i] + size[:i] - common)):
            if root[i] != root[j]:
                out.append((names[i], names[j]))
                root[root == root[i]] = root[j]
    return out


def links_between(xs: list[tuple[int, np.ndarray]], ys: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links from the sets of a query group to those of a data group; a query too far from the group's union is not opened."""
    union, token, which = overlaps([o for _, o in ys])
    size, out = np.array([len(o) for _, o in ys]), []
    for q, s in xs:
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if 100 * len(at) < percent * len(s):
            continue
        flag = np.zeros(len(union), bool)
        flag[at] = True
        common = np.bincount(which, flag[token], minlength=len(ys)).astype(np.int64)
        out += [(q, ys[j][0]) for j in np.flatnonzero(100 * common >= percent * (len(s) + size - common)) if ys[j][0] != q]
    return out


def _sets(d: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            keys, seen = b.column(0).to_pylist(), set()
            for w in batches_of_words(b.column(1), FOLDED):
                for i in range(w.lo, w.hi):
                    yield from f(keys[i], shingles(w.hashes[w.of(i)]), seen)

    return tables.by_arrow(d, run, schema)


def near_duplicates(bulletins: DataFrame, key: str = "incident_id", text: str = "message", percent: int = 75) -> DataFrame:
    """Every bulletin with n_shingles and component_id, the least key reachable by links: key, n_shingles, component_id.

    Two bulletins link when 100 * intersection >= percent * union. Equal sets are one node. Similar nodes (a common
    least hash) are linked first in bounded chunks. Groups are parts of about ``GROUP`` nodes of a component; nodes that
    are not linked yet are grouped by a common least hash and a like size. The token-group matrix then holds, by token,
    the groups whose union has it among the tokens that a link needs (the least |s| - ceil(percent |s|) + 1 hashes of a
    set); a query group's overlap with each group is counted, groups below the bound are not opened, groups of one
    component are never compared, and groups of unlinked nodes are opened against themselves. Null and blank texts have
    no shingles and stand alone; rows with equal keys link by their texts only; null keys link, but never name a component
    that has another key.
    """
    spark = bulletins.sparkSession
    d = bulletins.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def describe(k, s, seen):
        m = mix(s)
        least = [int((m * U(c)).min().view(np.int64)) if len(s) else 0 for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        yield (k, len(s), fingerprint(m), *least), 48

    rows = checkpoint(_sets(d, describe, "id long, n_shingles long, node long, m1 long, m2 long"))
    nodes = checkpoint(rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("m1").alias("m1"), F.first("m2").alias("m2")))

    def with_sets(wanted: DataFrame) -> DataFrame:
        """node and set of the wanted nodes, each once; texts are fetched by the key of one bulletin."""
        ids = wanted.select("id", "node").distinct()
        texts = tables.join_small(d.withColumnRenamed("id", "_id"), checkpoint(ids.select("id").distinct()), F.col("_id").eqNullSafe(F.col("id")), "left_semi", 40)

        def put(k, s, seen):
            n = fingerprint(mix(s))
            if len(s) and n not in seen:
                seen.add(n)
                yield (n, tables.raw(s)), 8 * len(s)

        got = _sets(texts, put, "node long, s binary")
        return got.groupBy("node").agg(F.first("s").alias("s")).join(ids.select("node"), "node", "left_semi")

    # Groups of similar nodes: chunks of a common least hash, linked exactly.
    keyed = nodes.select("node", "id", F.explode(F.array(F.struct(F.lit(1).alias("f"), F.col("m1").alias("m")), F.struct(F.lit(2).alias("f"), F.col("m2").alias("m")))).alias("x")).select("node", "id", "x.*")
    many = keyed.groupBy("f", "m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    chunked = checkpoint(keyed.join(many, ["f", "m"]).withColumn("chunk", F.pmod(F.xxhash64("node", "f"), F.ceil(F.col("c") / 128))))

    def members(b) -> list[tuple[int, np.ndarray]]:
        return [(x["node"], tables.array(x["s"], U)) for x in b.as_py()]

    def link(batches):
        for b in batches:
            for chunk in map(members, b.column(0)):
                yield from ((x, 16) for x in links_within([s for _, s in chunk], [n for n, _ in chunk], percent))

    # Chunks and groups are bounded by construction, so they are gathered as arrays.
    gathered = F.collect_list(F.struct("node", "s")).alias("group")
    sets = with_sets(chunked)
    linking = chunked.join(sets, "node").groupBy("f", "m", "chunk").agg(gathered).filter(F.size("group") > 1).select("group")
    edges = checkpoint(tables.by_arrow(linking, link, "a long, b long"))
    del sets, linking
    release(spark)
    first = tables.components(edges)
    sized = first.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    parts = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(c / GROUP)).cast("int")
    linked = first.join(sized, "root").select("node", F.col("root").bitwiseOR(F.lit(1)).alias("comp"), parts(F.col("c")).alias("part"))
    # Unlinked nodes: the first least hash that another one of like size shares. Names of components are odd, of classes even.
    single = checkpoint(nodes.join(linked, "node", "left_anti").select("node", "id", F.floor(F.log("n") / np.log(1.15)).alias("band"), "m1", "m2"))
    c1, c2 = (single.groupBy("band", f"m{f}").agg(F.count(F.lit(1)).alias(f"c{f}")).filter(f"c{f} > 1") for f in (1, 2))
    alike = single.join(c1, ["band", "m1"], "left").join(c2, ["band", "m2"], "left")
    named = F.when(F.col("c1") > 1, F.xxhash64(F.lit(1), "band", "m1")).when(F.col("c2") > 1, F.xxhash64(F.lit(2), "band", "m2")).otherwise(F.col("node"))
    loose = alike.select("node", "id", named.bitwiseAND(F.lit(-2)).alias("comp"), parts(F.coalesce("c1", "c2", F.lit(1))).alias("part"))
    member = checkpoint(nodes.join(linked, "node").select("node", "id", "comp", "part").union(loose))
    del first, sized, linked, c1, c2, alike, loose
    release(spark)

    # Frequent tokens go last in the order of tokens, so that few groups meet over them. Any order gives the same links;
    # tokens above COUNTED hardly ever are among the least and are not counted.
    tallies = tables.buckets_for(tables.text_volume(bulletins, text), 16 << 20)

    def tally(batches):
        for b in batches:
            found, seen = [np.zeros(0, U)], set()
            for w in batches_of_words(b.column(1), FOLDED):
                for i in range(w.lo, w.hi):
                    m = mix(shingles(w.hashes[w.of(i)]))
                    name = (len(m), int(m[0]) if len(m) else 0, int(m[-1]) if len(m) else 0)
                    if name not in seen:
                        seen.add(name)
                        found.append(m[m < COUNTED])
            u, c = np.unique(np.concatenate(found), return_counts=True)
            for k, at in tables.in_buckets(u, tallies):
                yield (k, tables.raw(u[at]), tables.raw(c[at].astype(np.uint32))), 12 * len(at)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        u, inv = np.unique(np.concatenate([tables.array(x, U) for x in pdf["t"]]), return_inverse=True)
        c = np.bincount(inv, np.concatenate([tables.array(x, np.uint32) for x in pdf["c"]]))
        return pd.DataFrame({"least": list(FREQUENT), "t": [tables.raw(u[c >= f]) for f in FREQUENT]})

    often = checkpoint(tables.by_arrow(d, tally, "bucket int, t binary, c binary").groupBy("bucket").applyInPandas(total, "least int, t binary"))
    sizes = {r.least: r.n for r in often.groupBy("least").agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    fit = next((f for f in FREQUENT if sizes.get(f, 0) <= tables.BROADCAST_LIMIT // 4), None)
    parts = [tables.array(r.t, U) for r in often.filter(F.col("least") == fit).select("t").toLocalIterator()] if fit and sizes else []
    frequent = spark.sparkContext.broadcast(np.sort(np.concatenate(parts)) if parts else np.zeros(0, U))
    del often, sizes, parts
    release(spark)

    def ordered(m: np.ndarray) -> np.ndarray:
        f = frequent.value
        late = f[np.minimum(np.searchsorted(f, m), len(f) - 1)] == m if len(f) else np.zeros(len(m), bool)
        return np.sort((m >> U(1)) | (late.astype(U) << U(63)))

    # Token-group matrix over the tokens a link needs.
    def prefix(k, s, seen):
        m = mix(s)
        n = fingerprint(m)
        if len(s) and n not in seen:
            seen.add(n)
            p = len(s) - -(-percent * len(s) // 100) + 1
            yield (n, len(s), tables.raw(ordered(m)[:p])), 8 * p + 16

    heads = _sets(d, prefix, "node long, n int, p binary").groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    matrix_rows = checkpoint(heads.join(member, "node").select("comp", "part", "n", "p"))
    del heads
    release(spark)
    volume = matrix_rows.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    n = tables.buckets_for(volume, 16 << 20)

    def deal(batches):
        for b in batches:
            comp, part = np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), np.int32)
            heads = [tables.array(x, U) for x in b.column(3).to_pylist()]
            if not heads:
                continue
            which, token = np.repeat(np.arange(len(heads)), [len(x) for x in heads]), np.concatenate(heads)
            for k, at in tables.in_buckets(mix(token), n):
                yield (k, tables.raw(token[at]), tables.raw(comp[which[at]]), tables.raw(part[which[at]])), 20 * len(at)

    dealt = tables.by_arrow(matrix_rows, deal, "bucket int, token binary, comp binary, part binary")

    def overlap(pdf: pd.DataFrame) -> pd.DataFrame:
        t, c, p = (np.concatenate([tables.array(x, k) for x in pdf[f]]) for f, k in (("token", U), ("comp", np.int64), ("part", np.int32)))
        order = np.lexsort((p, c, t))
        t, c, p = t[order], c[order], p[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
        t, c, p = t[new], c[new], p[new]
        cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        lo, hi = cut[:-1], cut[1:]
        a, b = [], []
        for x, y in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist(), strict=True):
            if c[x] == c[y - 1] and c[x] & 1:
                continue
            for i in range(x, y - 1):
                j = np.flatnonzero(c[i + 1:y] != c[i]) + i + 1 if c[i] & 1 else np.arange(i + 1, y)
                a.append(np.full(len(j), i))
                b.append(j)
        if not a:
            return pd.DataFrame({"ca": [], "pa": [], "cb": [], "pb": [], "c": []}).astype("int64")
        a, b = np.concatenate(a), np.concatenate(b)
        got = pd.DataFrame({"ca": c[a], "pa": p[a].astype(np.int64), "cb": c[b], "pb": p[b].astype(np.int64)})
        return got.groupby(["ca", "pa", "cb", "pb"]).size().reset_index(name="c")

    counted = dealt.groupBy("bucket").applyInPandas(overlap, "ca long, pa long, cb long, pb long, c long").groupBy("ca", "pa", "cb", "pb").agg(F.sum("c").alias("c"))
    span = matrix_rows.groupBy("comp", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("w"))
    sa, sb = (span.select(F.col("comp").alias(f"c{x}"), F.col("part").cast("long").alias(f"p{x}"), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    t = percent / 100.0
    # Least number of common least-hash tokens of a linked pair x, y: overlap needed less what may lie past the prefixes.
    need = F.least(*[t / (1 + t) * (F.col(f"lo{x}") + F.col(f"lo{y}")) - t * F.col(f"hi{x}") for x, y in ("ab", "ba")]) - 1
    fits = (100 * F.col("hia") >= percent * F.col("lob")) & (100 * F.col("hib") >= percent * F.col("loa")) & (F.col("c") >= need)
    # The lighter block of a pair travels to the heavier one.
    lighter = [F.when(F.col("wa") <= F.col("wb"), F.col(f"{k}{x}")).otherwise(F.col(f"{k}{y}")).alias(f"{k}{x}") for x, y in ("ab", "ba") for k in "cp"]
    m2 = member.withColumn("part", F.col("part").cast("long"))
    own = m2.filter(F.col("comp").bitwiseAND(F.lit(1)) == 0).groupBy("comp", "part").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    own = own.select(F.col("comp").alias("ca"), F.col("part").alias("pa"), F.col("comp").alias("cb"), F.col("part").alias("pb"))
    open_pairs = checkpoint(counted.join(sa, ["ca", "pa"]).join(sb, ["cb", "pb"]).filter(fits).select(*lighter).union(own))
    both = open_pairs.select(F.col("ca").alias("comp"), F.col("pa").alias("part")).union(open_pairs.select(F.col("cb").alias("comp"), F.col("pb").alias("part"))).distinct()
    chosen = checkpoint(m2.join(both, ["comp", "part"]))
    del dealt, counted, span, sa, sb, both
    release(spark)

    blocks = checkpoint(chosen.join(with_sets(chosen), "node").groupBy("comp", "part").agg(gathered))
    release(spark)
    ba, bb = (blocks.select(F.col("comp").alias(f"c{x}"), F.col("part").alias(f"p{x}"), F.col("group").alias(f"m{x}")) for x in "ab")

    def opened(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                for link in links_between(members(x), members(y), percent):
                    yield link, 16

    more = open_pairs.join(ba, ["ca", "pa"]).join(bb, ["cb", "pb"]).select("ma", "mb")
    more = tables.by_arrow(more, opened, "a long, b long")
    found = checkpoint(edges.union(more))
    del more, ba, bb, blocks
    release(spark)
    final = tables.components(found)
    rooted = nodes.select("node", "id").join(final, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = checkpoint(rooted.join(least, "root").select("node", "component_id"))
    out = tables.join_small(rows, named, "node", "left", 40)
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
