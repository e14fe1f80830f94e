"""The ``op*`` queries: given tables mapped to the operators' records and results mapped back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm import (chip_search, decontaminate, equal_texts, line_dedup, near_duplicates, packing, page_text, prefix_trie, quality, sharding, span_dedup, spellings,
                           url_filter)

RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"),
         url_filter.Rule("org", "/fr/", "allow")]


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("incident_id"), F.col("text").alias("message"))


def op1_pack(spark, sf_dir):
    return packing.pack_bulletins(bulletins(spark, sf_dir)).withColumnRenamed("incident_id", "doc_id")


def op2_extract(spark, sf_dir):
    return page_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op3_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(bulletins(spark, sf_dir)).withColumnRenamed("incident_id", "doc_id")


def op4_top_k(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chip_id"), F.col("embedding").alias("vector"))
    found = chip_search.nearest_chips(e, e.filter(F.col("chip_id") % 20 == 0))
    return found.withColumnRenamed("chip_id", "vec_id")


def held_out(c):
    return F.crc32(c.cast("string")) % 5 == 0


def op5_quality(spark, sf_dir):
    b = bulletins(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("incident_id"), F.col("quality").alias("usable")).filter(~held_out(F.col("incident_id")))
    scored = quality.score_bulletins(b, quality.fit_quality(b, labels))
    return scored.select(F.col("incident_id").alias("doc_id"), held_out(F.col("incident_id")).alias("held_out"), "score", "predicted")


def op6_decontaminate(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("exercise_id"), F.col("text").alias("message"))
    d = decontaminate.exercise_overlap(bulletins(spark, sf_dir), items)
    return d.select(F.col("incident_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def op7_strip_spans(spark, sf_dir):
    d = span_dedup.strip_repeated_spans(bulletins(spark, sf_dir))
    return d.select(F.col("incident_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("message").cast("binary"), 256).alias("kept_sha256"))


def op8_url_filter(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(p, RULES).select("page_id", "host", "path", "rule", "verdict")


def _stripped_lines(d):
    return d.select(F.col("incident_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("message", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_strip_lines(spark, sf_dir):
    return _stripped_lines(line_dedup.strip_repeated_lines(bulletins(spark, sf_dir)))


def op9_strip_long_lines(spark, sf_dir):
    return _stripped_lines(line_dedup.strip_repeated_lines(bulletins(spark, sf_dir), min_words=line_dedup.LONG_LINE))


def op10_shard(spark, sf_dir):
    d = bulletins(spark, sf_dir).select("incident_id", (F.coalesce(F.octet_length("message"), F.lit(0)) + 8).cast("long").alias("size"),
                                        F.crc32(F.coalesce(F.col("message"), F.lit("")).cast("binary")).alias("text_crc32"))
    s = sharding.shard_records(d, "incident_id")
    return s.select(F.col("incident_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_trie(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("log_id"), F.col("turn").alias("seq"), F.col("role").alias("name"), F.col("text").alias("body"))
    log = F.col("log")
    shared = (F.crc32(log.cast("string").cast("binary")) % 6).cast("int")
    d = prefix_trie.log_trie(prefix_trie.branched_logs(prefix_trie.numbered_entries(e), log - log % 100, shared))
    return d.select(F.col("log_id").alias("conv_id"), "depth", F.col("parent_log_id").alias("parent_conv_id"), F.col("n_logs").alias("n_convs"), "n_children", "n_leaves",
                    F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


def op12_spellings(spark, sf_dir):
    return spellings.spelling_forms(spellings.count_words(bulletins(spark, sf_dir))).withColumnRenamed("vessel_name", "word")


def op13_exact_copies(spark, sf_dir):
    return equal_texts.equal_bulletins(bulletins(spark, sf_dir)).withColumnRenamed("incident_id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_pack, op2_extract, op3_near_duplicates, op4_top_k, op5_quality, op6_decontaminate, op7_strip_spans, op8_url_filter,
                                   op9_strip_lines, op9_strip_long_lines, op10_shard, op11_trie, op12_spellings, op13_exact_copies)}

# unsigned crc32 of a list of bytes, by the table of the reflected polynomial 0xEDB88320
CRC = """bits as (select list(list_reduce(list_prepend(i, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by i) tbl from range(256) r(i))"""


def _crc(byte_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295)"


ORACLES = {
    "op11_trie": f"""
with {CRC},
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 pos,
             concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) entry, length(coalesce(text, '')) chars from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 base, {_crc("list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as bigint))")} % 6 h from (select distinct conv_id from t), bits),
r as (select c.conv_id, t.pos, entry, chars from c join t on t.conv_id = c.conv_id and t.pos >= c.h
      union all select c.conv_id, t.pos, entry, chars from c join t on t.conv_id = c.base and t.pos < c.h),
s as (select conv_id, row_number() over (partition by conv_id order by pos) d, entry, chars from r),
l as (select c.conv_id, coalesce(list(entry order by d) filter (entry is not null), []) e, coalesce(list(chars order by d) filter (entry is not null), []) n from c left join s using (conv_id) group by 1),
p as (select conv_id, len(e) full_depth, d, list_slice(e, 1, d) path, case when d = 0 then 0 else n[d] end chars from l, lateral (select unnest(range(0, len(e) + 1)) d)),
k as (select path, d, any_value(chars) chars, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = full_depth), '')) ends_sha256
      from p group by path, d),
i as (select k.*, (k.n_convs - 1) * chars own, not exists (select 1 from k j where j.d = k.d + 1 and list_slice(j.path, 1, k.d) = k.path) leaf from k),
up as (select i.path, a.k ancestor, list_slice(i.path, 1, a.k) apath, i.leaf, i.own, i.d from i, lateral (select unnest(range(0, i.d + 1)) k) a),
g as (select apath, count(*) filter (d = ancestor + 1) n_children, count(*) filter (leaf) n_leaves, sum(own) saved from up group by apath)
select i.conv_id, i.d depth, j.conv_id parent_conv_id, i.n_convs, g.n_children, g.n_leaves, cast(g.saved as bigint) saved_tokens, i.ends_sha256
from i join g on g.apath = i.path left join k j on i.d > 0 and j.path = list_slice(i.path, 1, i.d - 1) and j.d = i.d - 1""",
    "op12_spellings": f"""
with {CRC},
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r from documents where text is not null),
b as (select r, list_transform(string_split(concat(cast(doc_id as varchar), ':', r), ''), lambda c: cast(ord(c) as bigint)) cp from r where length(r) >= 7),
h as (select r, {_crc("flatten(list_transform(cp, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x & 63)] end))")} h from b, bits),
w as (select word, count(*) n from (select case when h % 31 = 0 then concat(substr(r, 1, h % length(r)), substr(r, h % length(r) + 2)) else r end word from h) where length(word) >= 7 group by word having count(*) >= 2),
v as (select word, n, unnest(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, 1, i - 1), substr(word, i + 1))))) v from w),
p as (select distinct a.word, b.word o, a.n, b.n m from v a join v b on a.v = b.v and a.word <> b.word where levenshtein(a.word, b.word) <= 2),
q as (select word, n, count(*) n_near, min(struct_pack(m := -m, o := o)) best from p where abs(length(word) - length(o)) <= 1 and {{near}} group by word, n),
f as (select word, n_near, case when -best.m >= 10 * n then best.o end form, case when -best.m >= 10 * n then -best.m end form_n from q),
c as (select word, form, form_n from f where form is not null),
x as (select w.word, f.form, coalesce(c5.form, c4.form, c3.form, c2.form, c1.form, f.form, w.word) root, w.n, coalesce(f.n_near, 0) n_near, f.form_n from w left join f using (word)
      left join c c1 on c1.word = f.form left join c c2 on c2.word = c1.form left join c c3 on c3.word = c2.form left join c c4 on c4.word = c3.form left join c c5 on c5.word = c4.form)
select word, form, root, n, n_near, form_n from x""".replace("{near}", """(
  (length(word) = length(o) and len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(o, i, 1))) = 1)
  or (length(word) = length(o) + 1 and list_contains(list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, 1, i - 1), substr(word, i + 1))), o))
  or (length(o) = length(word) + 1 and list_contains(list_transform(range(1, length(o) + 1), lambda i: concat(substr(o, 1, i - 1), substr(o, i + 1))), word)))"""),
    "op13_exact_copies": r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h from documents)
select doc_id, min(doc_id) over (partition by h) keep_id, count(*) over (partition by h) group_size, doc_id = min(doc_id) over (partition by h) kept, h text_sha256 from n""",
    "op4_top_k": """
with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20""",
    "op8_url_filter": """
with u as (select page_id, coalesce(url, '') url, instr(coalesce(url, ''), '://') k from pages),
r as (select page_id, case when k > 0 then substr(url, k + 3) else '' end rest from u),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r),
j as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end verdict from j""",
    "op9_strip_lines": """
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
w as (select *, lead(line) over (partition by doc_id order by i) nxt from l),
s as (select doc_id, i, row_number() over (partition by line, nxt order by doc_id, i) rn from w where nxt is not null),
g as (select distinct doc_id, i + d i from s, (values (0), (1)) t(d) where rn > 1),
k as (select l.*, g.i is not null gone from l left join g using (doc_id, i)),
a as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') kept from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join a using (doc_id)""",
    "op9_strip_long_lines": """
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
w as (select *, lead(line) over (partition by doc_id order by i) nxt from l),
s as (select doc_id, i, 2 n, row_number() over (partition by line, nxt order by doc_id, i) rn from w where nxt is not null
      union all select doc_id, i, 1, row_number() over (partition by line order by doc_id, i) from l where len(regexp_extract_all(line, '[^ \\t\\x0b\\f\\r]+')) >= 35),
g as (select distinct doc_id, i + d i from s, (values (0), (1)) t(d) where rn > 1 and d < n),
k as (select l.*, g.i is not null gone from l left join g using (doc_id, i)),
a as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') kept from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join a using (doc_id)""",
}
