"""Corpus operators on bulletins (incident_id, message): brute force, planted cases, nulls, ties, empty tables, clashing columns."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwake.llm import chip_search, decontaminate, line_dedup, near_duplicates, packing, page_text, quality, queries, sharding, span_dedup, url_filter
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
BULLETIN = "incident_id long, message string"


def messages(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    words = ["slick", "wind", "vessel", "Port", "drift", "é", "knots", "tanker", "shore", "radar", "oil", "crew", "night", "log", "flag"]
    base = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words, int(rng.integers(0, 90))))
        rows.append((i, base + " " + t if i % 5 == 0 else t))
    rows += [(n, base), (n + 1, base), (n + 2, base.replace("radar", "lidar", 1)), (n + 3, None), (n + 4, ""), (n + 5, "two words"), (n + 6, "Two  words"), (3, rows[3][1])]
    return spark.createDataFrame(rows, BULLETIN), rows


def test_near_duplicates_equal_brute_force(spark):
    df, rows = messages(spark)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    want = Counter((rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))
    assert Counter(map(tuple, near_duplicates.near_duplicates(df).collect())) == want


def test_spans_equal_brute_force(spark):
    df, rows = messages(spark, seed=4)
    c = Counter(tuple(w[i:i + 35]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 34))
    want = Counter()
    for k, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 34) if c[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        want[(k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter(map(tuple, span_dedup.strip_repeated_spans(df).collect())) == want


def test_exercise_overlap_equals_brute_force(spark):
    df, rows = messages(spark)
    items = [("7", rows[60][1]), ("a", "Two words"), ("none", None), ("b", "crew crew crew")]
    got = decontaminate.exercise_overlap(df.selectExpr("*", "1 n_hit", "'x' item"), spark.createDataFrame(items, "exercise_id string, message string"))
    pat, win = re.compile(r"[0-9a-z\x80-\U0010ffff]+"), defaultdict(set)
    for n, t in items:
        w = pat.findall((t or "").lower())
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            win[tuple(w[i:i + min(10, len(w))])].add(n)
    want = Counter()
    for k, t in rows:
        w, hit, found = pat.findall((t or "").lower()), set(), set()
        for i in range(len(w)):
            for n in (2, 3, 10):
                if found_here := win.get(tuple(w[i:i + n])) if i + n <= len(w) else None:
                    hit |= set(range(i, i + n))
                    found |= found_here
        want[(k, len(w), len(hit), tuple(sorted(found)))] += 1
    assert Counter((r.incident_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()) == want


def test_shards_move_only_to_the_new_one(spark):
    df = spark.range(5000).selectExpr("cast(id % 4000 as long) mmsi", "1 shard").union(spark.createDataFrame([(None, 1)], "mmsi long, shard int"))
    rows = sharding.shard_records(df, shards=24).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in rows) and 100 < sum(r.grown_shard == 24 for r in rows) < 320
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_url_rules(spark):
    urls = ["https://a.example.net/en/x", "http://example.net/fr", "http://Net/", "x.example.com/de/", "http://example.com/de/?q#f", "ftp://w.org/fr/1", None, "http://org", "http://notexample.com/de/"]
    got = url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), queries.RULES).collect()
    assert [r.rule for r in got] == ["example.net/en/", "net/", "net/", None, "example.com/de/", "org/fr/", None, None, None]
    assert [r.verdict for r in got] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_lines(spark):
    rows = [(1, "a\nb\nc", 9), (2, "x\na\nb\nz", 9), (2, "x\na\nb\nz", 9), (3, None, 9), (4, "", 9), (5, "a\na\na\na", 9)]
    got = sorted((r.incident_id, r.message, r.n_removed) for r in line_dedup.strip_repeated_lines(spark.createDataFrame(rows, BULLETIN + ", n_lines int")).filter("message is not null").collect())
    assert got == [(1, "a\nb\nc", 0), (2, "", 4), (2, "x\nz", 2), (4, "", 0), (5, "a", 3)]


def test_long_single_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(35)), " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}\ne"), (3, long), (4, f"b\n{short}"), (None, long), (5, f"x\n{long}\n{long}")]
    df = spark.createDataFrame(rows, BULLETIN)
    got = {r.incident_id: (r.message, r.n_removed) for r in line_dedup.strip_repeated_lines(df, min_words=35).collect()}
    assert got == {None: (long, 0), 1: (f"a\nb\n{short}", 1), 2: (f"c\nd\n{short}\ne", 1), 3: ("", 1), 4: ("", 2), 5: ("x", 2)}


def test_chips_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8)).astype("float32").tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(400, None), (401, [1.0] * 7 + [float("nan")]), (402, [None] * 8), (None, v[0]), (403, v[5])]
    df = spark.createDataFrame(rows, "chip_id long, vector array<float>")
    got = {(r.query_id, r.rank): (r.chip_id, r.score) for r in chip_search.nearest_chips(df, df.filter("chip_id % 20 = 0"), k=5).collect()}
    x = np.floor(64 * np.array([*v, v[5]], float)).astype(int)
    ids = [*range(400), 403]
    for q in range(0, 400, 20):
        best = sorted((-int(x[q] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]


def test_encoder_equals_the_vocabulary_while_its_caches_turn_over():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng, signs = np.random.default_rng(3), [chr(c) for c in [*range(33, 127), *range(0xA0, 0x100)]] + ["'s", "'LL", "œ", "Σ", "ς", "́", "İ", "漢", "\t", "."]
    words = ["".join(rng.choice(signs, int(rng.integers(0, 9)))) for _ in range(3000)] + ["Año,", "garçon", "GROßE", "don't", "tail."] * 20
    rng.shuffle(words)
    enc, plain = packing.Encoder(path), Tokenizer.from_file(path)
    enc.chunks.size = enc.pieces.size = 40
    for i in range(0, len(words), 10):
        text = " ".join(words[i:i + 10])
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(enc.chunks) <= 40 and len(enc.chunks.older) <= 40


def test_values_in_use_are_kept_when_the_cache_turns_over():
    made = []
    kept = packing.Kept(lambda k: made.append(k) or k.encode(), 2)
    for k in ["hot", "a", "hot", "b", "hot", "c", "hot", "d", "hot", "e", "hot"]:
        assert kept[k] == k.encode()
    assert made.count("hot") == 1 and len(kept) + len(kept.older) <= 4


def test_packing_is_gapless_and_tight(spark):
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 100, 500)] + [100, 100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "incident_id long, length long")
    p = packing.pack_pieces(df, limit=100, shard=128).toPandas().sort_values("offset")
    assert len(p) == len(sizes)
    for _, g in p.groupby("sequence_id"):
        assert g["length"].sum() <= 100 and g["offset"].tolist() == np.concatenate([[0], np.cumsum(g["length"])[:-1]]).tolist()
    assert p["sequence_id"].nunique() <= -(-sum(sizes) // 100) * 1.05


def test_pieces_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Slick it's 12nm\tE of Ångström's É. <|endoftext|> x", None, "", "wind " * 5000, "a b c Σας \x1f\x85"]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), BULLETIN), "word_bpe_49k.json").collect()
    import zlib
    want = []
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(map(tuple, rows)) == want


def test_page_text(spark):
    page = ("<body><div class='cookie-banner'>We use cookies.</div><nav><a>A</a></nav><article><h1>T &amp; U</h1><p>One <b>bold</b>\n word.<p>Two.</article>"
            "<script>var x = '<p>no</p>'</script><footer>&copy; x</footer></body>")
    rows = [(1, "u", page), (2, None, None), (3, "", "")]
    got = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [("T & U One bold word. Two.", 25), ("", 0), ("", 0)]


def test_empty_tables(spark):
    e, items = spark.createDataFrame([], BULLETIN), spark.createDataFrame([], "exercise_id string, message string")
    model = quality.fit_quality(e, spark.createDataFrame([], "incident_id long, usable int"))
    assert near_duplicates.near_duplicates(e).count() == span_dedup.strip_repeated_spans(e).count() == line_dedup.strip_repeated_lines(e).count() == 0
    assert decontaminate.exercise_overlap(e, items).count() == quality.score_bulletins(e, model).count() == packing.pack_bulletins(e).count() == 0
    assert sharding.shard_records(e, "incident_id").count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")
def test_quality_on_held_out_labels(spark):
    import pandas as pd

    got = queries.op5_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.93


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_rows_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 40))
    a, b, c, d, e, leak = (text() for _ in range(6))
    near = a.replace(" ", " new ", 1)
    rows = [(None, a), (None, b), (7, c), (7, d), (5, near), (None, e), (9, e + "\n" + text()), (4, e), (3, leak), (2, None), (None, ""), (8, c + " end")]
    rows += [(None, text()) for _ in range(20)] + [(20, text()) for _ in range(20)]
    spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "n long, doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("i", " ".join(leak.split()[5:20]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in")
    order = docs.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").collect()

    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for r in order for w in [(r.text or "").split()]]
    root = list(range(len(order)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = {min((r.doc_id is None, r.doc_id or 0, r._row, r.n) for r, g in zip(order, root, strict=True) if g == k)[-1] for k in set(root)}
    got = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    assert sorted(r.n for r in got) == sorted(want)
    assert Counter((r.doc_id, r.text) for r in got)[(7, c)] == Counter((r.doc_id, r.text) for r in got)[(7, d)] == 1
    # The stages after the classifier, each stored and read again, against the rules by hand.
    full = docs.withColumn("n_chars", F.length("text").cast("long"))
    for i, stage in enumerate((corpus_pipeline.drop_lines, corpus_pipeline.one_of_each, corpus_pipeline.without_benchmark)):
        stage(spark, full, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{i}")
        full = spark.read.parquet(f"{tmp_path}/stage-{i}")
    seen, kept = set(), []
    for r in sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._row)):
        lines = [x for x in (r.text or "").split("\n") if len(x.split()) < 35 or not (x in seen or seen.add(x))]
        if r.text is not None and (lines or not r.text):
            kept.append((r.doc_id, "\n".join(lines)))
        elif r.text is None:
            kept.append((None if r.doc_id is None else r.doc_id, None))
    groups = []
    for k, t in kept:
        w = (t or "").split()
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        meets = [g for g in groups if any(s and x and 100 * len(s & x) >= 75 * len(s | x) for _, _, x in g)]
        groups = [g for g in groups if g not in meets] + [[(k, t, s), *(m for g in meets for m in g)]]
    best = [min(g, key=lambda x: (x[0] is None, x[0] or 0))[:2] for g in groups]
    assert Counter((r.doc_id, r.text) for r in full.collect()) == Counter(x for x in best if x[1] != leak)
    packed = corpus_pipeline.pack(spark, full, str(tmp_path)).toPandas()
    assert packed["length"].gt(0).all() and len(packed) == len(best) - 1


def test_links_between_groups_equal_brute_force():
    from driftwake.llm.near_duplicates import links_between

    rng = np.random.default_rng(5)
    base = np.arange(1, 41, dtype=np.uint64)
    near = [(i, np.sort(np.where(rng.random(40) < 0.07, base + np.uint64(1000 * i), base))) for i in range(1, 13)]
    far = [(i, np.sort(rng.choice(np.arange(5000, 9000, dtype=np.uint64), 30, replace=False))) for i in range(13, 16)]
    xs, ys = near[:6] + far[:2], near[4:] + far[1:]
    sets = dict(xs + ys)
    want = {(a, b) for a, _ in xs for b, _ in ys if a != b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    assert 5 < len(want) < 40 and set(links_between(xs, ys, 75)) == want
    assert links_between(far[:1], near, 75) == []
