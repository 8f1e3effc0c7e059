"""Queries of text, vector and table-profile operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles, text
from ..sources import telemetry
from ..sources.shared import Scratch, fresh_path
from .fixtures import table
from .registry import Query

#: Keyword lists for the derived conversations, whose words are invented.
RULES = {"force_analysis": ["Thing"], "force_diagnosis": ["Ichen"], "force_comprehensive": ["schö"], "analysis": ["tion", "ción"], "diagnosis": ["ent", "eit"], "manual": ["über", "pour"]}
_QUERY_STEP = 50


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(coalesce(text, ''), '{w}')" for w in words) + ")"


_H = {k: _has(v) for k, v in RULES.items()}


def _hits(s: SparkSession, d: str, k: int = 3) -> DataFrame:
    """Queries: every row whose id divides by ``_QUERY_STEP``, against all rows."""
    v = table(s, d, "embeddings").select("vec_id", text.normalised(F.col("embedding")).alias("v"))
    return text.top_k(v, v.where(F.col("vec_id") % _QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")), k)


def _pruned_hits(s: SparkSession, d: str) -> DataFrame:
    """The same hits from an index of all rows, written once."""
    v = table(s, d, "embeddings").select("vec_id", text.normalised(F.col("embedding")).alias("v"))
    pivots, sample = text.pivots_of(v)
    index = Scratch(s).keep(text.index_vectors(v, pivots), "vectors")
    asked = v.where(F.col("vec_id") % _QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    return text.top_k_pruned(index, pivots, sample, asked)


_KNN = f"""nv0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), nv AS (SELECT vec_id,
 list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM nv0),
kn AS (SELECT * FROM (SELECT q.vec_id AS query_id, n.vec_id AS id, list_dot_product(q.v, n.v) AS score, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY list_dot_product(q.v, n.v) DESC, n.vec_id) AS rank FROM nv q, nv n WHERE q.vec_id % {_QUERY_STEP} = 0) WHERE rank <= 3)"""


def _formatted(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/manuals/"), "source", F.lit(".pdf")).alias("source"), "text", (F.col("doc_id") % 9).alias("page"))
    return text.format_hits(_hits(s, d, 2).join(docs, "id"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") + F.col("conv_id")
    words = F.when(k % 5 == 0, F.concat(F.lit("see /data/v"), "conv_id", F.lit(".csv, please"))).when(k % 5 == 1, F.lit("第二个文件")).when(k % 5 == 2, F.concat(F.lit("open A"), "conv_id", F.lit(".CSV"))).when(k % 5 == 3, F.lit("第 9 个文件")).otherwise(F.lit("what next"))
    return table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("session_id"), words.alias("text"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    conv = table(s, d, "conversations").select("conv_id").distinct()
    files = conv.select(F.col("conv_id").alias("session_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place")).withColumn("name", F.concat(F.when(F.col("place") == 1, "a").otherwise("b"), F.col("session_id"), F.lit(".csv")))
    return text.resolve_file(_messages(s, d), files.withColumn("path", F.concat(F.lit("/up/"), "name")))


def _dataset(s: SparkSession, d: str) -> DataFrame:
    return profiles.dataset_profile(telemetry.read_dataset(s, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    """The profile of all orders merged from stored parts of a year each, and whether its sketches keep their errors: 7 % of the distinct
    values (four deviations), 2 % of the rows between a quartile's place and that of its value."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    parts = Scratch(s).keep(profiles.profile_parts(orders, F.year("o_orderdate")), "profiles")
    merged = profiles.merge_parts(parts.where("column <> 'o_orderdate'"))
    value = lambda c, x: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), x.cast("double").alias("x"))
    long = orders.select(F.inline(F.array(*(value(c, F.col(c)) for c in ("o_orderkey", "o_custkey", "o_totalprice")), value("o_orderstatus", F.lit(None)))))
    share = lambda below: F.avg(below.cast("double"))
    near = [(share(F.col("x") < F.col(q)) <= p + 0.02) & (share(F.col("x") <= F.col(q)) >= p - 0.02) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    held = long.join(F.broadcast(merged.select("column", "q1", "median", "q3", F.col("distinct").alias("guess"))), "column").groupBy("column").agg(
        (near[0] & near[1] & near[2]).alias("quartiles_close"), (F.abs(F.max("guess") - F.countDistinct("text")) <= 0.07 * F.countDistinct("text")).alias("distinct_close")
    )
    return merged.join(held, "column")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, (1 - count({c}) / CAST(count(*) AS DOUBLE)) * 100 AS missing_pct, count(DISTINCT {c}) AS \"distinct\", " + (f"""avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3,
 max({c}) AS max""" if t != "string" else "NULL AS mean, NULL AS std, NULL AS min, NULL AS q1, NULL AS median, NULL AS q3, NULL AS max") + " FROM orders"
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string"))
)

#: Where a chunk of 500 characters that starts at {at} ends: after the last of the strongest separator found beyond its overlap, looked for from behind.
_BEHIND = "strpos(reverse(t[{at} + 52:{at} + 500]), {s})"
_CHUNK_END = "CASE WHEN {at} + 500 >= n THEN n " + " ".join(
    f"WHEN {_BEHIND.replace('{s}', s)} > 0 THEN {{at}} + 501 - {_BEHIND.replace('{s}', s)}" for s in (" || ".join(f"chr({ord(c)})" for c in sep) for sep in text.SEPARATORS)
) + " ELSE {at} + 500 END"

QUERIES = [
    Query(
        "txt1_chunks",
        lambda s, d: text.chunk_documents(table(s, d, "documents")).select("doc_id", "source", "chunk_no", F.length("text").alias("n_chars")),
        "doc_id:i source:s chunk_no:i n_chars:i",
        f"""RECURSIVE own AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
ch AS (SELECT r, 0 AS a, {_CHUNK_END.format(at="0")} AS e FROM own WHERE n > 0 UNION ALL SELECT r, at2 AS a, {_CHUNK_END.format(at="at2")} AS e FROM (SELECT ch.r, greatest(e - 50, a + 1) AS at2, t, n FROM ch
 JOIN own ON own.r = ch.r WHERE e < n)),
cut AS (SELECT ch.r, a, doc_id, source, regexp_replace(regexp_replace(t[a + 1:e], '^\\s+', ''), '\\s+$', '') AS x FROM ch
 JOIN own ON own.r = ch.r)|||SELECT doc_id, source, row_number() OVER (PARTITION BY r ORDER BY a) - 1 AS chunk_no, length(x) AS n_chars FROM cut WHERE x <> ''""",
    ),
    Query("txt2_top_k", _hits, "query_id:i id:i score:d rank:i", f"{_KNN}|||SELECT * FROM kn"),
    Query("txt2b_top_k_pruned", _pruned_hits, "query_id:i id:i score:d rank:i", f"{_KNN}|||SELECT * FROM kn"),
    Query(
        "txt3_format_hits",
        _formatted,
        "query_id:i references:s",
        f"""{_KNN}|||SELECT query_id, string_agg('[参考' || rank || '] 文档: ' || source || '.pdf, 第 ' || (doc_id % 9) || ' 页 | 内容: ' || replace(text, chr(10), ' '), chr(10) ORDER BY rank) AS \"references\" FROM kn
 JOIN documents ON doc_id = id WHERE rank <= 2 GROUP BY 1""",
    ),
    Query(
        "txt4_intent",
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.route_intent(F.col("text"), RULES).alias("intent")),
        "conv_id:i turn:i intent:s",
        f"SELECT conv_id, turn, CASE WHEN {_H['force_analysis']} THEN 'data_analysis' WHEN {_H['force_diagnosis']} THEN 'diagnosis' WHEN {_H['force_comprehensive']} THEN 'comprehensive_diagnosis' WHEN {_H['analysis']} AND NOT {_H['diagnosis']} AND NOT {_H['manual']} THEN 'data_analysis' WHEN {_H['analysis']} AND ({_H['diagnosis']} OR {_H['manual']}) THEN 'comprehensive_diagnosis' ELSE 'diagnosis' END AS intent FROM conversations",
    ),
    Query(
        "txt5_file_reference",
        _resolved,
        "message_id:s session_id:i status:s file:s",
        "SELECT conv_id || '-' || turn AS message_id, conv_id AS session_id, CASE (turn + conv_id) % 5 WHEN 3 THEN 'missing' WHEN 4 THEN 'ambiguous' ELSE 'ok' END AS status, CASE (turn + conv_id) % 5 WHEN 0 THEN '/data/v' || conv_id || '.csv' WHEN 1 THEN '/up/b' || conv_id || '.csv' WHEN 2 THEN '/up/a' || conv_id || '.csv' END AS file FROM conversations",
    ),
    Query(
        "txt6_history",
        lambda s, d: text.recent_history(table(s, d, "conversations")),
        "conv_id:i turn:i history:s",
        "SELECT conv_id, turn, coalesce(array_to_string(list_filter(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), chr(10)), '') AS history FROM conversations",
    ),
    Query(
        "agg8_dataset_profile",
        _dataset,
        "column:s dtype:s missing_pct:d4 distinct:i mean:d4 std:d4 min:d4 q1:d4 median:d4 q3:d4 max:d4",
        f"SELECT \"column\", dtype, missing_pct, \"distinct\", mean, std, min, q1, median, q3, max FROM ({_PROFILE})",
    ),
    Query(
        "agg8c_merged_parts",
        _merged,
        "column:s dtype:s missing_pct:d4 mean:d4 std:d4 min:d4 max:d4 distinct_close:b quartiles_close:b",
        f"SELECT \"column\", dtype, missing_pct, mean, std, min, max, true AS distinct_close, CASE WHEN mean IS NOT NULL THEN true END AS quartiles_close FROM ({_PROFILE})",
    ),
    Query(
        "agg8b_suggestions",
        lambda s, d: profiles.suggestions(profiles.dataset_profile(table(s, d, "events").select("event_id", "value", "event_type", "ts"))),
        "suggestion:s",
        """ty AS (SELECT unnest([typeof(event_id), typeof(value), typeof(event_type), typeof(ts)]) AS t FROM (SELECT * FROM events LIMIT 1)),
 lost AS (SELECT least(count(event_id), count(value), count(event_type), count(ts)) < count(*) AS gaps FROM events),
 own AS (SELECT 'correlation, outliers, models' AS suggestion WHERE (SELECT count(*) FROM ty WHERE regexp_matches(t, 'INT|DOUBLE|FLOAT|DECIMAL')) >= 2
 UNION ALL SELECT 'category counts, groups, encoding' WHERE EXISTS (FROM ty WHERE t IN ('VARCHAR', 'BOOLEAN')) UNION ALL SELECT 'trends, seasons, forecasts' WHERE EXISTS (FROM ty WHERE regexp_matches(t, 'TIMESTAMP|DATE'))
 UNION ALL SELECT 'fill or drop missing values' FROM lost WHERE gaps)|||SELECT suggestion FROM own UNION ALL SELECT 'clean and standardise first' WHERE NOT EXISTS (FROM own)""",
    ),
    Query("snk1_partitioned", lambda s, d: _partitioned(s, d), "source:s docs:i", "SELECT source, count(*) AS docs FROM documents GROUP BY 1"),
]


def _partitioned(s: SparkSession, d: str) -> DataFrame:
    """Documents written by source and read back."""
    root = fresh_path(s, "docs")
    telemetry.write_table(table(s, d, "documents").select("doc_id", "lang", "source"), root, ("source",), ("doc_id",))
    return s.read.parquet(root).groupBy("source").agg(F.count("*").alias("docs"))
