"""Queries of this subpackage by name, and their equivalents in SQL where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, table
from facetrank.llm import bpe, distinctive, fused_rank, mixing, perm_index, set_join, truncation


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.telling_tokens(table(spark, folder, "token_sets"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every clean token of every id with its score, by the occurrences in its record and in all."""
    scored = distinctive.distinctiveness(distinctive.token_counts(table(spark, folder, "token_sets")))
    return scored.select("id", "token", "tf", "df", "cf", F.round("score", 9).alias("score"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    top = fused_rank.top_articles(table(spark, folder, "result_scores"), table(spark, folder, "search_pivot"), 5)
    return top.select("search_id", "combo", "article_id")


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole rankings, by projection."""
    all_ = fused_rank.fused(table(spark, folder, "result_scores"), table(spark, folder, "search_pivot"))
    return all_.withColumn("projection", F.round("projection", 9))


def p2_components(spark: SparkSession, folder: str) -> DataFrame:
    """The plain first component of each search, and the columns that it turns against their declared direction."""
    found = fused_rank.components(table(spark, folder, "result_scores"))
    return found.withColumn("component", F.round("component", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return perm_index.near_terms(table(spark, folder, "lda_dictionary"), k=3, most=1.0)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.similar_records(table(spark, folder, "token_sets"), 0.6, 4)


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id: its class of equal sets, the class's size, its number of links to other classes' ids."""
    return set_join.linked_records(table(spark, folder, "token_sets"), 0.6, 4)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents")).select("doc_id", "ids")


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of each text, and whether they decode to it; a null text decodes to an empty one."""
    documents = table(spark, folder, "documents")
    ids = cut(bpe.encode_texts(documents))
    back = bpe.decode_ids(ids).withColumnRenamed("text", "decoded")
    sizes = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return (
        documents.select("doc_id", "text").join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "n_tokens", same.alias("same"))
    )


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_exact_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), exact=True)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_report(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_scores, p2_found, p2_ranking, p2_components, p4_found, p6_found, p6_links, p7_ids, p7_roundtrip,
        p8_mix, p8_report, p8_exact_report, p9_found, p9_report,
    )
}

_CLEAN = r"""
clean as (
  select distinct id, token from (
    select id, lower(regexp_replace(case when instr(t, '|') > 1 then t[:instr(t, '|') - 1] else t end, '^\s+|\s+$', '', 'g')) token
    from (select id, unnest(tokens) t from token_sets where id is not null)
    where t is not null
  ) where token <> ''
)"""

_SIMILAR = (
    "with "
    + _CLEAN
    + """,
sized as (select id, count(*) n from clean group by id having count(*) >= 4),
shared as (
  select a.id id_a, b.id id_b, count(*) common
  from clean a join clean b on a.token = b.token and a.id < b.id
  group by a.id, b.id
),
pairs as (
  select id_a, id_b from shared join sized x on x.id = id_a join sized y on y.id = id_b
  where common >= 0.6 * (x.n + y.n - common) - 1e-9
)
"""
)

_FUSED = """
with recursive s as (
  select search_id, column_name, article_id, max(score) + 0.0 x from result_scores
  where score is not null and not isnan(score) and article_id is not null and search_id is not null and column_name is not null
  group by all
),
r as (
  select search_id, column_name, article_id,
    count(*) over (partition by search_id, column_name order by x)::double / count(*) over (partition by search_id, column_name) r
  from s
),
w as (
  select search_id, combo, column_name, max(w) w from (
    select search_id, column_name, generate_subscripts(weights, 1) - 1 combo, try_cast(trim(unnest(weights)) as double) w from search_pivot
    where search_id is not null and column_name is not null
  ) where w >= 0 and not isnan(w) group by all
),
rho as (
  select a.search_id, a.column_name ca, b.column_name cb,
    case when a.column_name = b.column_name then 1.0 when isnan(corr(a.r, b.r)) then 0.0 else coalesce(corr(a.r, b.r), 0.0) end rho
  from r a join r b on a.search_id = b.search_id and a.article_id = b.article_id group by a.search_id, a.column_name, b.column_name
),
total as (select search_id, combo, sum(w) total from w join (select distinct search_id, column_name from r) using (search_id, column_name) group by all),
n as (
  select a.search_id, a.combo, a.column_name ca, b.column_name cb, a.w wa, sqrt(a.w) * sqrt(b.w) * (rho / 3.0 + 2.0 / 3.0) / total m
  from w a join w b on a.search_id = b.search_id and a.combo = b.combo
    join rho on rho.search_id = a.search_id and rho.ca = a.column_name and rho.cb = b.column_name
    join total t on t.search_id = a.search_id and t.combo = a.combo
),
it as (
  select 0 step, search_id, combo, ca, sqrt(wa) v from n where ca = cb
  union all
  select step + 1, n.search_id, n.combo, n.ca, sum(n.m * it.v) from it join n on n.search_id = it.search_id and n.combo = it.combo and n.cb = it.ca
  where step < 50 group by all
),
l as (
  select search_id, combo, ca column_name,
    coalesce(v * sqrt(w) / nullif(sum(v * sqrt(w)) over (partition by search_id, combo), 0), 0) loading
  from it join w using (search_id, combo) where step = 50 and ca = w.column_name
),
f as (select search_id, combo, article_id, sum(r * loading) projection from r join l using (search_id, column_name) group by all)
"""

ORACLE = {
    "p2_ranking": _FUSED + "select search_id, combo, article_id, round(projection, 9) projection from f",
    "p2_found": _FUSED
    + """, o as (select *, row_number() over (partition by search_id, combo order by round(projection, 12) desc, article_id) place from f)
select search_id, combo, article_id from o where place <= 5""",
    "p1_found": "with "
    + _CLEAN
    + """,
held as (select token, count(*) df from clean group by token),
shared as (select id, token, df, min(df) over (partition by id) least from clean join held using (token) where df >= 2)
select id, token from shared where df = least and df <= 3
""",
    "p1_scores": r"""
with cleaned as (
  select id, list_sort(list_filter(list_transform(list_filter(tokens, lambda t: t is not null),
    lambda t: lower(regexp_replace(case when instr(t, '|') > 1 then t[:instr(t, '|') - 1] else t end, '^\s+|\s+$', '', 'g'))), lambda t: t <> '')) tokens
  from token_sets where id is not null
),
arrays as (select id, max(coalesce(tokens, [])) tokens from cleaned group by id),
pairs as (select id, token, count(*) tf from (select id, unnest(tokens) token from arrays) group by id, token),
held as (select token, count(*) df, sum(tf)::bigint cf from pairs group by token),
n as (select count(distinct id)::double n from pairs)
select id, token, tf, df, cf, round(tf * log2((1 - exp(-cf / n)) / (df / n)), 9) score from pairs join held using (token), n
""",
    "p4_found": """
with usable as (
  select term, min(lda_vector) v from lda_dictionary
  where term is not null and len(lda_vector) = 50
    and len(list_filter(lda_vector, lambda x: x is not null and isfinite(x))) = 50
    and len(list_filter(lda_vector, lambda x: x <> 0)) > 0
  group by term
),
ranked as (
  select a.term q, b.term c, list_distance(a.v, b.v) d,
    row_number() over (partition by a.term order by list_distance(a.v, b.v), b.term) place
  from usable a join usable b on a.term <> b.term
)
select distinct least(q, c) term_a, greatest(q, c) term_b from ranked where place <= 3 and d <= 1.0
""",
    "p6_found": _SIMILAR + "select id_a, id_b from pairs",
    "p6_links": _SIMILAR
    + """, arrays as (select id, list_sort(list(token)) t, count(*) n from clean group by id having count(*) >= 4),
classes as (select id, min(id) over (partition by t) rep, count(*) over (partition by t) copies from arrays),
both_ways as (select id_a a, id_b b from pairs union all select id_b, id_a from pairs),
link as (select a id, count(*) links from both_ways join classes x on x.id = a join classes y on y.id = b where x.rep <> y.rep group by a)
select id, rep, copies, coalesce(links, 0) links from classes left join link using (id)
""",
}
