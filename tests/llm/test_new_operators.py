"""Prefix trie, spelling variants and exact copies against brute force; nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwake.llm import chip_search, equal_texts, page_text, prefix_trie, queries, spellings
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
ENTRY = "log_id long, seq long, name string, body string"
BULLETIN = "incident_id long, message string"


def random_depths(m, rng, deep=False):
    depth = [0]
    for _ in range(m - 1):
        depth.append(depth[-1] + 1 if deep and rng.random() < 0.9 else int(rng.integers(1, depth[-1] + 2)))
    return np.array(depth)


@pytest.mark.parametrize("m,deep", [(1, False), (2, False), (31, False), (32, True), (33, False), (3000, False), (3000, True), (40_000, False)])
def test_find_close_equals_a_stack(m, deep):
    depth = random_depths(m, np.random.default_rng(m), deep)
    bits, start, close = prefix_trie.find_close(depth)
    want, stack = {}, []
    for i, b in enumerate(bits.tolist()):
        if b > 0:
            stack.append(i)
        else:
            want[stack.pop()] = i
    assert not stack and close.tolist() == [want[s] for s in start.tolist()]


def trie_by_hand(logs):
    """logs: {id: [(name, body)]} -> the operator's rows."""
    nodes = defaultdict(list)
    for k, turns in logs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(k)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in kids[p]) or 1
        saved[p] = sum(saved[c] for c in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: ",".join(map(str, sorted(k for k in who if len(logs[k]) == len(p)))) for p, who in nodes.items()}
    return Counter((min(w), len(p), min(nodes[p[:-1]]) if p else None, len(w), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, w in nodes.items())


def branched(logs, shared):
    out = {}
    for c, turns in logs.items():
        h = shared(c)
        out[c] = logs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def log_rows(rng, n=150):
    """Audit logs of amended incidents: many begin alike, a third are equal, one is long; seq has nulls and gaps."""
    logs = {}
    for c in rng.choice(700, n, replace=False).tolist():
        size = int(rng.integers(0, 9))
        logs[c] = [("manifest", "radar.json")] * 2 if c % 3 == 0 else [(str(rng.choice(["manifest", "alert", ""])), str(rng.choice(["", "é", "radar.json", "alert sent"]))) for _ in range(size)]
    logs[5] = [("manifest", f"file {i % 3}") for i in range(700)]
    logs[6] = logs[5][:690] + [("alert", "sent")] * 3
    rows = []
    for c, turns in logs.items():
        for i, (a, b) in enumerate(turns):
            rows.append((c, None if i == 0 and c % 2 else 3 * i, None if a == "" and c % 2 else a, None if b == "" and c % 5 else b))
    return {c: t for c, t in logs.items() if t}, rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    if small:  # many shards, three levels of spines, salted parents
        for name, value in (("SHARD", 9), ("LEAST_PATHS", 8), ("TOP_PATHS", 8)):
            monkeypatch.setattr(prefix_trie, name, value)
        monkeypatch.setattr(prefix_trie.tables, "BROADCAST_LIMIT", 0)
    logs, rows = log_rows(np.random.default_rng(7))
    e = spark.createDataFrame(rows, ENTRY).selectExpr("*", "'x' pos", "1 digest", "2 range", "3 log").repartition(5)
    shared = lambda c: zlib.crc32(str(c).encode()) % 6
    log = F.col("log")
    got = prefix_trie.log_trie(prefix_trie.branched_logs(prefix_trie.numbered_entries(e), log - log % 100, (F.crc32(log.cast("string").cast("binary")) % 6).cast("int")))
    assert Counter(map(tuple, got.collect())) == trie_by_hand(branched(logs, shared))


def test_trie_of_nothing_and_of_repeated_rows(spark):
    whole = lambda rows: prefix_trie.log_trie(prefix_trie.branched_logs(prefix_trie.numbered_entries(spark.createDataFrame(rows, ENTRY)), F.col("log"), F.lit(0)))
    assert whole([]).collect() == []
    assert whole([(None, 1, "a", "b")]).collect() == []
    got = Counter(map(tuple, whole([(4, 1, "a", "bb"), (4, 1, "a", "bb"), (9, None, "a", "bb")]).collect()))
    assert got == trie_by_hand({4: [("a", "bb")] * 2, 9: [("a", "bb")]})


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def forms_by_hand(counts, ratio=10):
    near = {w: [o for o in counts if edit_one(w, o)] for w in counts}
    form = {}
    for w, os in near.items():
        best = min(os, key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = Counter()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[(w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])] += 1
    return out


@pytest.mark.parametrize("hot", [64, 1])
def test_spellings_equal_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    base = ["stellamar", "northwind", "aaaaaaa", "ÿacht×é", "atlantico"]
    counts = {}
    for b in base:
        counts[b] = int(rng.choice([10_000, 500, 40]))
        words = [b]
        for _ in range(60):
            w = words[int(rng.integers(len(words)))]
            i, kind = int(rng.integers(len(w))), rng.random()
            x = str(rng.choice(list("aeinrst")))
            w = w[:i] + w[i + 1:] if kind < 0.3 else w[:i] + x + w[i:] if kind < 0.6 else w[:i] + x + w[i + 1:]
            words.append(w)
            counts[w] = int(rng.choice([1, 2, 3, 30, 400]))
    counts |= {"": 5, "a": 60, "ab": 7}
    rows = [(w, n) for w, n in counts.items()] + [(None, 9), ("lost", None), ("none", 0), ("ab", 3)]
    counts["ab"] += 3
    d = spark.createDataFrame(rows, "vessel_name string, n_reports long").selectExpr("*", "1 w", "2 root", "3 s")
    assert Counter(map(tuple, spellings.spelling_forms(d, hot=hot).collect())) == forms_by_hand(counts)


def test_signatures_meet_for_every_edit():
    """Names one edit apart share a signature in the very column that reports their pair."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        w = "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 12))))
        i = int(rng.integers(len(w)))
        for o in (w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + "a" + w[i + 1:]):
            if o == w:
                continue
            a, b = spellings.signatures([w, o])
            ours, theirs = (defaultdict(set) for _ in range(2))
            for c, x, y in zip(spellings.COLUMNS, a.tolist(), b.tolist(), strict=True):
                ours[c].add(x)
                theirs[c].add(y)
            shared = [c for c in ours if ours[c] & theirs[c] and spellings._once(w, o, c)]
            assert len(shared) == 1


def test_words_of_messages(spark):
    rows = [(1, "Lighthouse LIGHTHOUSE lighthouse×÷ short Ünderwäy-ünderwäy"), (2, None), (3, ""), (None, "anchorage anchorage"), (4, "anchorage " * 5000)]
    want = Counter()
    for k, t in rows:
        import re
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(str.maketrans(spellings.UPPER, spellings.LOWER))
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            want[r[:h % len(r)] + r[h % len(r) + 1:] if h % 31 == 0 else r] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    got = spellings.count_words(spark.createDataFrame(rows, BULLETIN).selectExpr("*", "1 h", "2 r", "3 k"))
    assert {r.vessel_name: r.n_reports for r in got.collect()} == want


def test_slips_are_taken_out_at_their_place(spark):
    """With ``slip`` 1 every run loses the letter at its crc32 modulo its length."""
    rows = [(i, w) for i in range(40) for w in ("lighthouses", "ÿnderwäyÉ")]
    got = {r.vessel_name: r.n_reports for r in spellings.count_words(spark.createDataFrame(rows, BULLETIN), slip=1, least_count=1).collect()}
    want = Counter()
    for k, r in rows:
        h = zlib.crc32(f"{k}:{r}".encode())
        want[r[:h % len(r)] + r[h % len(r) + 1:]] += 1
    assert got == want


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_copies_equal_brute_force(spark, counters):
    rng = np.random.default_rng(11)
    texts = ["a  b", "a b", "a\tb", "a b", None, "", " ", "\r\n", "x" * 300_000, "x" * 299_999 + "y"]
    rows = [(int(k) if k % 7 else None, texts[int(i)]) for k, i in zip(rng.permutation(400), rng.choice(len(texts), 400, p=[0.35, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05]), strict=True)]
    rows += [(3, "only"), (5, "a b"), (5, "a b"), (None, "alone"), (None, "alone")]
    import re
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size, best = Counter(norm), {}
    for (k, _), t in zip(rows, norm, strict=True):
        best[t] = min(best.get(t, (True, 0)), (k is None, k or 0))
    want = Counter((k, None if best[t][0] else best[t][1], size[t], hashlib.sha256(t.encode()).hexdigest()) for (k, _), t in zip(rows, norm, strict=True))
    got = equal_texts.equal_bulletins(spark.createDataFrame(rows, BULLETIN).selectExpr("*", "1 digest", "2 row", "3 first", "4 n").repartition(9), counters=counters).collect()
    assert Counter((r.incident_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert all(r.incident_id == r.keep_id for r in got if r.kept)


def test_frequent_digests_keep_every_heavy_one(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(900, 1), np.full(500, 2), np.full(260, 3), rng.integers(10, 5000, 3000)])
    rng.shuffle(v)
    d = spark.createDataFrame([(bytes([x % 256, x // 256]),) for x in v.tolist()], "digest binary").repartition(70)
    got = {r.digest: r.low for r in equal_texts.frequent_digests(d, counters=20).collect()}
    assert len(got) <= 20 and {b"\x01\x00", b"\x02\x00", b"\x03\x00"} <= set(got)
    assert 900 - len(v) // 21 <= got[b"\x01\x00"] <= 900


def test_copies_of_an_empty_table_and_string_keys(spark):
    assert equal_texts.equal_bulletins(spark.createDataFrame([], BULLETIN)).collect() == []
    got = equal_texts.equal_bulletins(spark.createDataFrame([("demo-2", "x"), ("demo-1", "x")], "incident_id string, message string")).collect()
    assert {(r.incident_id, r.keep_id, r.kept) for r in got} == {("demo-2", "demo-1", False), ("demo-1", "demo-1", True)}
    assert spellings.spelling_forms(spark.createDataFrame([], "vessel_name string, n_reports long")).collect() == []


def nearest_by_hand(rows, ask, k):
    v = {i: [int(np.floor(64 * c)) for c in x] for i, x in rows}
    return {(q, r + 1, j, max(-2**63, min(2**63 - 1, -s))) for q in ask for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in v if j != q and len(v[j]) == len(v[q]))[:k])}


@pytest.mark.parametrize("scale", [1.0, 3e7, 1e15, 1e200])
def test_chips_of_any_finite_size_are_ranked_exactly(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i, (scale * x).tolist()) for i, x in enumerate(rng.normal(size=(120, 3)))] + [(200, [scale, 1.0, 0.0]), (201, [scale, 1.0 + 1 / 64, 0.0]), (202, [1.0, 2.0])]
    d = spark.createDataFrame([*rows, (300, [float("inf"), 1.0, 1.0]), (301, [])], "chip_id long, vector array<double>").selectExpr("*", "1 dim", "2 block", "3 id")
    got = {tuple(r) for r in chip_search.nearest_chips(d, d.filter("chip_id % 20 = 0"), k=6).collect()}
    assert got == nearest_by_hand(rows, [i for i, _ in rows if i % 20 == 0], 6)


def test_chips_in_many_blocks_with_clusters_and_copies(spark, monkeypatch):
    for name, value in (("LEAF", 4), ("DATA_BLOCK", 60), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(chip_search, name, value)
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(6, 5)) * 20
    rows = [(f"chip-{i:03}", (centres[i % 6] + (0 if i % 4 == 0 else rng.normal(size=5))).tolist()) for i in range(360)]
    d = spark.createDataFrame(rows, "chip_id string, vector array<double>")
    ask = [k for k, _ in rows[::10]]
    got = {tuple(r) for r in chip_search.nearest_chips(d, d.filter(F.col("chip_id").isin(ask)), k=9).collect()}
    assert got == nearest_by_hand(rows, ask, 9)
    assert chip_search.nearest_chips(d.limit(0), d.limit(0)).count() == 0


def test_stray_quotes_and_broken_tags():
    blocks = lambda html: [t for t, _ in page_text.leaf_blocks(html)]
    assert blocks("<p title=it's>First words</p><p>Second paragraph isn't lost</p>") == ["First words", "Second paragraph isn't lost"]
    assert blocks("<p data-x=\"a > b\" 'y>one</p><p>two</p><a href='x") == ["one", "two"]
    import time
    began = time.process_time()
    page_text.leaf_blocks("<a \"" * 40_000 + "<p>x")
    assert time.process_time() - began < 5


def test_cover_tree_halves_its_radius():
    rng = np.random.default_rng(11)
    x = np.concatenate([c + rng.normal(size=(200, 3)) * 0.01 for c in rng.normal(size=(8, 3)) * 30])
    t = chip_search.CoverTree(x)
    assert t.children[0] and sorted(t.order.tolist()) == list(range(len(x)))
    for u, kids in enumerate(t.children):
        rows = t.order[t.lo[u]:t.hi[u]]
        assert np.sqrt(((x[rows] - x[t.centre[u]]) ** 2).sum(1)).max() <= t.radius[u] + 1e-9 and t.centre[u] in rows
        assert all(t.radius[c] <= t.radius[u] / 2 + 1e-9 for c in kids)
        assert not kids or [t.lo[u], *[t.hi[c] for c in kids]] == [*[t.lo[c] for c in kids], t.hi[u]]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")
@pytest.mark.parametrize("name", ["op11_trie", "op12_spellings", "op13_exact_copies"])
def test_query_equals_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


@pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")
def test_workers_need_no_copy_of_the_package(tmp_path):
    """Kernels and what they share travel by value: a driver outside the repository, workers that cannot import it."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from driftwake.llm import queries
from driftwake.session import local_session
spark = local_session(4)
for name in ("op2_extract", "op4_top_k", "op5_quality", "op6_decontaminate", "op11_trie", "op12_spellings", "op13_exact_copies"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 0, name
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
