"""Prompt rows out, model responses in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens import lexicon as L

RESPONSE_SCHEMA = "value string, status string, company_claim string, interpretation string, reason string, evidence_ids array<string>"
NO_EVIDENCE_REASON = "검색된 근거가 없습니다."
INSTRUCTIONS = "\n".join([
    "아래 근거만 사용해 항목을 작성한다. 근거에 없는 사실, 수치, 이름은 쓰지 않는다.",
    "사실과 해석을 나누어 적고, 근거가 모자라면 value는 null로 둔다.",
    "status는 다음 중 하나: " + ", ".join(L.FIELD_STATUSES) + ".",
    "evidence_ids에는 제시된 ID만 쓴다.",
    'JSON 하나만 출력한다: {"value", "status", "company_claim", "interpretation", "reason", "evidence_ids"}',
])


def profile_fields(spark: SparkSession, queries: dict[str, list[str]] | None = None, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """The eighteen profile fields; queries and rules per field are the caller's."""
    rows = [(c, f, code, label, cats, (queries or {}).get(f, [label]), (rules or {}).get(f, [])) for c, f, code, label, cats in L.PROFILE_FIELDS]
    return spark.createDataFrame(rows, "category string, field string, code string, label string, retrieval_categories array<string>, "
                                       "queries array<string>, rules array<string>")


def defined_fields(fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """``fields`` with the queries and rules of ``definitions`` (field, queries, rules) where it has some."""
    given = definitions.select("field", F.col("queries").alias("_q"), F.col("rules").alias("_r"))
    filled = lambda new, old: F.when(F.size(new) > 0, F.col(new)).otherwise(F.col(old))
    return fields.join(given, "field", "left").withColumns({"queries": filled("_q", "queries"), "rules": filled("_r", "rules")}).select(*fields.columns)


def evidence_block(evidence_id: Column, chunk_id: Column, report: Column, section: Column, content: Column) -> Column:
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("["), evidence_id, F.lit("]")), line("chunk_id", chunk_id),
                       line("report", F.coalesce(report, F.lit("unknown"))), line("section", section), F.lit("content:"),
                       F.coalesce(content, F.lit("")))


def prompts(fields: DataFrame, evidence: DataFrame, keys: list[str], instructions: str = INSTRUCTIONS) -> DataFrame:
    """One prompt per key with its evidence (at most eight pieces) in rank order.

    ``fields``: keys, category, code, label, rules.  ``evidence``: keys,
    evidence_rank, evidence_id, chunk_id, report_type, section, content.
    """
    block = evidence_block(F.col("evidence_id"), F.col("chunk_id"), F.col("report_type"), F.col("section"), F.col("content"))
    packed = evidence.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence_text"),
        F.count("*").alias("n_evidence"))
    rules = F.array_join(F.transform("rules", lambda r: F.concat(F.lit("- "), r)), "\n")
    text = F.concat_ws("\n", F.lit(instructions), F.concat_ws(" / ", "category", "code", "label"), rules,
                       F.coalesce("evidence_text", F.lit("")))
    return (fields.join(packed, keys, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
            .withColumn("prompt", F.when(F.col("n_evidence") > 0, text)))


def response_json(raw: Column) -> Column:
    """Response text without code fence, else its outermost braces."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(bare)


def parse_responses(responses: DataFrame, known: DataFrame, keys: list[str], statuses=None) -> DataFrame:
    """Typed, checked fields; ``problem`` says why a response is unusable.

    ``responses``: keys, raw.  ``known``: keys, evidence_id — at most eight per key.
    Ids that were not offered are dropped; a key without evidence is not asked and
    comes back as undisclosed.
    """
    ids = known.groupBy(*keys).agg(F.collect_set("evidence_id").alias("_known"))
    parsed = F.from_json(response_json(F.col("raw")), RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    rows = responses.join(ids, keys, "left").withColumn("_r", parsed)
    none = F.col("_known").isNull()
    good = F.coalesce(F.col("_r.status").isin(*(statuses or L.FIELD_STATUSES)), F.lit(False))
    offered = F.filter(F.coalesce("_r.evidence_ids", F.array().cast("array<string>")), lambda e: F.array_contains("_known", e))
    return rows.select(
        *keys,
        F.when(~none, F.col("_r.value")).alias("value"),
        F.when(none, F.lit("미공시")).when(good, F.col("_r.status")).alias("status"),
        *[F.when(~none, F.col(f"_r.{c}")).alias(c) for c in ("company_claim", "interpretation")],
        F.when(none, F.lit(NO_EVIDENCE_REASON)).otherwise(F.col("_r.reason")).alias("reason"),
        F.when(none, F.array().cast("array<string>")).otherwise(offered).alias("evidence_ids"),
        F.when(~none & (F.col("_r").isNull() | F.col("_r.status").isNull()), "not_json").when(~none & ~good, "bad_status").alias("problem"))


def resolved_evidence(fields: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows a field cites, in cited order; unknown ids drop out."""
    cited = fields.select(*keys, F.posexplode("evidence_ids").alias("cited_pos", "evidence_id"))
    return cited.join(evidence, [*keys, "evidence_id"])


def open_fields(all_fields: DataFrame, results: DataFrame, keys: list[str], statuses=None) -> DataFrame:
    """Keys without a completed result yet."""
    done = results.filter(F.col("status").isin(*(statuses or L.FIELD_STATUSES))).select(*keys)
    return all_fields.join(done, keys, "left_anti")


def run_summary(results: DataFrame, groups: list[str]) -> DataFrame:
    return results.groupBy(*groups).agg(F.count_if(F.col("problem").isNull()).alias("ok"),
                                        F.count_if(F.col("problem").isNotNull()).alias("failed"), F.count("*").alias("total"))


def normalised_hits(hits: DataFrame, keep: list[str]) -> DataFrame:
    """Search results of uneven shape under one set of names."""
    from filinglens.functions.ident import first_filled
    from filinglens.functions.text import short_id
    have = set(hits.columns)
    alias = lambda *names: first_filled(*([F.col(n) for n in names if n in have] or [F.lit(None).cast("string")]))
    content = F.coalesce(alias("content", "text", "chunk"), F.lit(""))
    return hits.select(*keep, F.coalesce(alias("chunk_id", "id"), short_id(content)).alias("chunk_id"), content.alias("content"),
                       F.coalesce(alias("score", "similarity").try_cast("double"), F.lit(0.0)).alias("score"),
                       alias("report", "source", "report_type").alias("report"), alias("section", "heading").alias("section"),
                       alias("page", "page_number").alias("page"))


def profile_rows(fields: DataFrame, parsed: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Final profile: every field with its checked answer and the evidence it cites.

    ``evidence`` holds at most eight rows per key, so the nested lists stay short.
    """
    cited = resolved_evidence(parsed, evidence, keys)
    item = F.struct("cited_pos", "evidence_id", "chunk_id", "content")
    nested = cited.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    answer = parsed.select(*keys, "value", "status", "company_claim", "interpretation", "reason", "problem")
    return fields.join(answer, keys, "left").join(nested, keys, "left")
