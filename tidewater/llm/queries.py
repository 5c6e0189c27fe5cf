"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import ann, bpe, cosine, decontaminate, hard_negatives, html_text, kmeans, lm, minhash, packing, phrases, toxicity, warc
from tidewater.llm.common import reachable, table

QUERIES = {}
ORACLES = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), is_table=True).drop("url")


ORACLES["op1_warc"] = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages
), d as (
  select page_id, octet_length(body) as payload_bytes, sha1(body) as hex from p
), b as (
  select *, min(page_id) over (partition by hex) as original,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), '')), '') as payload_digest
  from d
)
select page_id, payload_bytes::BIGINT as payload_bytes, payload_digest,
  case when original is null or page_id = original then 'response' else 'revisit' end as record_type,
  case when original is null or page_id = original then null else original end as refers_to
from b
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_embedding_dedup"] = """
with recursive v as (
  select vec_id, embedding::DOUBLE[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach as (
  select a as node, a as got from links union select r.node, l.b from reach r join links l on r.got = l.a
)
select e.vec_id, coalesce(l.n, 0)::BIGINT as n_links, least(e.vec_id, coalesce(r.c, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(r.c, e.vec_id)) as kept
from embeddings e
left join (select a, count(*) as n from links group by a) l on l.a = e.vec_id
left join (select node, min(got) as c from reach group by node) r on r.node = e.vec_id
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


ORACLES["op7_minhash"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w
), e as (
  select doc_id, len(s) as n, unnest(s) as x from s
), c as (
  select a.doc_id as a, b.doc_id as b, a.n as m, b.n as n, count(*) as k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all
), links as (
  select a, b from c where 100 * k >= 80 * (m + n - k)
), reach as (
  select a as node, a as got from links union select r.node, l.b from reach r join links l on r.got = l.a
)
select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(r.c, s.doc_id)) as component_id,
  s.doc_id = least(s.doc_id, coalesce(r.c, s.doc_id)) as kept
from s left join (select node, min(got) as c from reach group by node) r on r.node = s.doc_id
"""


@query
def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = phrases.repeated_windows_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_phrases"] = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), g as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as x from w, unnest(range(1, len(w) - 11)) as r(i)
), later as (
  select doc_id, i from (select *, min(doc_id) over (partition by x) as low from g) where low < doc_id
), gone as (
  select distinct doc_id, i + k as pos from later, range(0, 13) as t(k)
), lists as (
  select doc_id, list(pos) as gone from gone group by doc_id
)
select w.doc_id, len(w.w) as n_words, coalesce(len(l.gone), 0) as n_removed,
  sha256(array_to_string(list_filter(w.w, lambda x, i: not list_contains(coalesce(l.gone, []), i)), ' ')) as kept_sha256
from w left join lists l using (doc_id)
"""


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    hit = decontaminate.n_hit("spans")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLES["op12_decontamination"] = f"""
with d as (
  select row_number() over () as r, doc_id, {_WORDS} as w from documents
), i as (
  select item_id::VARCHAR as item, {_WORDS} as w from benchmark where item_id is not null
), g as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[k : k + 9], ' ') as x from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(k) where len(w) > 0
), p as (
  select r, k, s.n, array_to_string(w[k : k + s.n - 1], ' ') as x from d, (select distinct n from g) s, unnest(range(1, len(w) - s.n + 2)) as t(k)
), found as (
  select r, k, p.n, item from p join g using (n, x)
), words as (
  select r, count(distinct k + o) as n_hit from found, unnest(range(0, n)) as t(o) group by r
), named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from found) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join named using (r)
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.e, b.e)::BIGINT as score from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0
), p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::INT as rank, n.id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) <= 3
"""


@query
def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"))


def _kmeans_sql(rounds: int = 3, k: int = 16) -> str:
    parts = [
        """v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as (select row_number() over (order by h) - 1 as number, e from (select sha256('1:' || vec_id::VARCHAR) as h, e from v order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} as materialized (select vec_id, any_value(v.e) as e, arg_min(number, (d, number)) as number, min(d) as d from
  (select vec_id, v.e, number, list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e) as d from v, c{r} c) v group by vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} as (select number, list(floor(s / n) order by j) as e from (select number, j, sum(e[j]) as s, count(*) as n from a{r}, unnest(range(1, 65)) t(j) group by all) group by number),
c{r + 1} as materialized (select c.number, coalesce(m.e, c.e) as e from c{r} c left join m{r} m using (number))"""
            )
    return (
        "with " + ",\n".join(parts) + f""" select vec_id, a.number::INT as cluster, d::BIGINT as distance, sum(d) over (partition by a.number)::BIGINT as cluster_inertia, sum(d) over ()::BIGINT as inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT::VARCHAR), ',')) as centroid_sha256 from a{rounds} a join c{rounds} c using (number)"""
    )


ORACLES["op13_bit_planes"] = _kmeans_sql()
