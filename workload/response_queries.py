"""Queries over prompts, model responses and the incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from filinglens.operators import responses as OR
from filinglens.operators import retrieval
from filinglens.operators.ordering import top_per_group
from filinglens.plans import company_profile as CP
from filinglens.session import materialise, scratch_path, spread
from filinglens.sources import structure
from filinglens.streaming import versions
from filinglens.streaming.ingest import ingest
from workload.document_queries import WORDS
from workload.tables import FILINGS_SQL, filings, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def conversation_evidence(spark, sf):
    t = table(spark, sf, "conversations")
    top = top_per_group(t, ["conv_id"], [F.asc("turn")], 8, "evidence_rank")
    return top.select("conv_id", "evidence_rank", F.concat(F.lit("E"), F.col("evidence_rank").cast("string")).alias("evidence_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"),
                      F.col("role").alias("report_type"), F.lit("").alias("section"), F.col("text").alias("content"))


def conversation_fields(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().select(
        "conv_id", F.lit("business").alias("category"), F.concat(F.lit("B"), F.col("conv_id").cast("string")).alias("code"), F.lit("주요 제품").alias("label"), F.array(F.lit("규칙 1"), F.lit("규칙 2")).alias("rules"))


_INS = OR.INSTRUCTIONS.replace("'", "''").replace("\n", "' || chr(10) || '")


@query("field_prompts", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations QUALIFY r <= 8),
 b AS (SELECT conv_id, string_agg('[E' || r || ']' || chr(10) || 'chunk_id: ' || conv_id || '-' || turn || chr(10) || 'report: ' || role || chr(10) || 'section: ' || chr(10) || 'content:' || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS t, count(*) AS n FROM e GROUP BY 1)
 SELECT conv_id, n AS n_evidence, md5('{_INS}' || chr(10) || 'business / B' || conv_id || ' / 주요 제품' || chr(10) || '- 규칙 1' || chr(10) || '- 규칙 2' || chr(10) || t) AS prompt FROM b""")
def field_prompts(spark, sf):
    p = OR.prompts(conversation_fields(spark, sf), conversation_evidence(spark, sf), ["conv_id"])
    return p.select("conv_id", "n_evidence", F.md5("prompt").alias("prompt"))


def raw_responses(spark, sf):
    """A response per event, its shape set by the event type."""
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"value": "v'), F.col("user_id").cast("string"), F.lit('", "status": "확인", "company_claim": null, "interpretation": "i", "reason": "r", "evidence_ids": ["E2", "E9", "E1"]}'))
    t = F.col("event_type")
    raw = (F.when(t == "click", body).when(t == "error", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(t == "view", F.concat(F.lit("결과: "), body, F.lit(" 끝")))
           .when(t == "signup", F.replace(body, F.lit("확인"), F.lit("모름"))).otherwise(F.lit("no answer")))
    return e.select("event_id", "event_type", "value", raw.alias("raw"))


def known_evidence(spark, sf):
    e = table(spark, sf, "events").filter(F.col("value") > 5)
    return e.select("event_id", F.explode(F.array(F.lit("E1"), F.lit("E2"))).alias("evidence_id"))


PARSED_SQL = """parsed AS (SELECT event_id, event_type, user_id, value > 5 AS asked, CASE WHEN NOT value > 5 THEN NULL WHEN event_type = 'purchase' THEN 'not_json' WHEN event_type = 'signup' THEN 'bad_status' END AS problem,
 CASE WHEN NOT value > 5 THEN '미공시' WHEN event_type IN ('click', 'error', 'view') THEN '확인' END AS status,
 CASE WHEN value > 5 AND event_type <> 'purchase' THEN 'E2,E1' ELSE '' END AS ids, CASE WHEN value > 5 AND event_type <> 'purchase' THEN 'v' || user_id END AS field_value FROM events)"""


def parsed(spark, sf):
    return OR.parse_responses(raw_responses(spark, sf).select("event_id", "raw"), known_evidence(spark, sf), ["event_id"])


@query("parsed_responses", f"WITH {PARSED_SQL} SELECT event_id, status, problem, ids, field_value FROM parsed")
def parsed_responses(spark, sf):
    return parsed(spark, sf).select("event_id", "status", "problem", F.array_join("evidence_ids", ",").alias("ids"), F.col("value").alias("field_value"))


@query("cited_evidence", f"WITH {PARSED_SQL} SELECT event_id, unnest([0, 1]) AS cited_pos, unnest(['E2', 'E1']) AS evidence_id FROM parsed WHERE ids <> ''")
def cited_evidence(spark, sf):
    return OR.resolved_evidence(parsed(spark, sf), known_evidence(spark, sf), ["event_id"]).select("event_id", "cited_pos", "evidence_id")


@query("open_fields", f"WITH {PARSED_SQL} SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM parsed WHERE status IS NOT NULL)")
def open_fields(spark, sf):
    return OR.open_fields(table(spark, sf, "events").select("event_id"), parsed(spark, sf), ["event_id"])


@query("run_summary", f"WITH {PARSED_SQL} SELECT event_type, count(*) FILTER (problem IS NULL) AS ok, count(*) FILTER (problem IS NOT NULL) AS failed, count(*) AS total FROM parsed GROUP BY 1")
def run_summary(spark, sf):
    kinds = table(spark, sf, "events").select("event_id", "event_type")
    return OR.run_summary(parsed(spark, sf).join(kinds, "event_id"), ["event_type"])


@query("profile_rows", f"WITH {PARSED_SQL} SELECT event_id, event_type, status, problem, CASE WHEN ids <> '' THEN 'E2:c2,E1:c1' END AS evidence FROM parsed")
def profile_rows(spark, sf):
    """Fields with their checked answers and the evidence these cite."""
    known = known_evidence(spark, sf).withColumns({"chunk_id": F.replace("evidence_id", F.lit("E"), F.lit("c")), "content": F.lit("x")})
    rows = OR.profile_rows(table(spark, sf, "events").select("event_id", "event_type"), parsed(spark, sf), known, ["event_id"])
    return rows.select("event_id", "event_type", "status", "problem", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["evidence_id"], x["chunk_id"])), ",").alias("evidence"))


@query("normalised_hits", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'c' || doc_id ELSE substr(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) END AS chunk_id, length(text)::INT AS n, CASE WHEN lang = 'de' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, source AS report FROM documents""")
def normalised_hits(spark, sf):
    d = table(spark, sf, "documents")
    raw = d.select("doc_id", "text", "source", F.when(F.col("lang") == "en", F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("id"), F.when(F.col("lang") == "de", F.lit(0.5)).alias("similarity"))
    return OR.normalised_hits(raw, ["doc_id"]).select("doc_id", "chunk_id", F.length("content").alias("n"), "score", "report")


@query("incremental_versions", """WITH sent AS (SELECT o_orderkey, 1 AS version, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 3, o_totalprice + 1 FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 2, o_totalprice + 2 FROM orders WHERE o_orderkey % 7 < 4)
 SELECT o_orderkey, version, o_totalprice FROM sent QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1""")
def incremental_versions(spark, sf):
    """Three deliveries of orders in versions, late older ones among them, each a run of the stream; the newest version of each."""
    o, root = table(spark, sf, "orders"), scratch_path(spark, "versions")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    for where, version, more in ((key % 3 != 0, 1, 0), (key % 5 == 0, 3, 1), (key % 7 < 4, 2, 2)):
        sent = o.filter(where).select("o_orderkey", F.lit(version).alias("version"), (price + more).alias("o_totalprice"))
        sent.write.mode("append").parquet(f"{root}/source")
        versions.ingest_versions(spark, f"{root}/source", f"{root}/sink", f"{root}/checkpoint", sent.schema, "o_orderkey").awaitTermination()
    return versions.current(spark, f"{root}/sink", "o_orderkey").select("o_orderkey", "version", "o_totalprice")


@query("incremental_ingest", f"WITH {FILINGS_SQL} SELECT corp_code, rcept_no, strftime(rcept_dt, '%Y-%m-%d') AS rcept_dt FROM filing")
def incremental_ingest(spark, sf):
    """Two deliveries of overlapping filings taken in by two runs of one stream."""
    root = scratch_path(spark, "ingest")
    f = filings(spark, sf)
    f.filter("report_nm not like '분기%'").write.mode("append").parquet(f"{root}/in")
    ingest(spark, f"{root}/in", f"{root}/out", f"{root}/state", f.schema).awaitTermination()
    f.write.mode("append").parquet(f"{root}/in")
    ingest(spark, f"{root}/in", f"{root}/out", f"{root}/state", f.schema).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("corp_code", "rcept_no", F.date_format("rcept_dt", "yyyy-MM-dd").alias("rcept_dt"))


@query("profile_prompts")
def profile_prompts(spark, sf):
    """Pages to prompts for all eighteen fields of every host."""
    pages = spread(table(spark, sf, "pages"), "page_id").withColumns({"company": F.regexp_extract("url", r"//([^/]+)/", 1), "report_type": F.lit("annual")})
    chunks = materialise(CP.evidence_chunks(structure.structured(pages, ["company", "report_type"], "html"), "company", WORDS).withColumnRenamed("chunk", "content"))
    prompts, _ = CP.field_prompts(OR.profile_fields(spark), chunks, "company", retrieval.hashing_encoder())
    return prompts.select("company", "field", "n_evidence", F.length("prompt").alias("n_chars"))
