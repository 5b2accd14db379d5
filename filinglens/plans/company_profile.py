"""Grounded company profile: pages → evidence → chunks → retrieval → prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.operators import chunks, responses, retrieval
from filinglens.session import expand_over, materialise
from filinglens.sources import structure


def evidence_chunks(documents: DataFrame, company: str, keywords=None, priority=None) -> DataFrame:
    """Numbered, deduplicated chunks from structured documents.

    ``documents``: company, report_type, markdown, tables.
    """
    keys = [company, "report_type"]
    texts = chunks.text_blocks(documents, keys, "markdown")
    tables = structure.table_rows(documents, keys).select(*keys, "table_id", chunks.table_search_text(F.col("rows")).alias("content"), "markdown")
    evidence = chunks.category_evidence(texts, tables, company, keywords, priority).withColumnRenamed("type", "source_type")
    order = F.array_position(F.array(*[F.lit(c) for c in (keywords or L.CATEGORY_KEYWORDS)]), F.col("category"))
    evidence = evidence.withColumn("category_order", order)
    base = [company, "category", "category_order", "report_type", "source_type", "evidence_rank", "table_id", "block_index", "matched_keywords", "final_score"]
    cut = materialise(chunks.chunk_rows(evidence, base))
    place = ["category_order", "evidence_rank", "piece_index"]
    unique = chunks.first_occurrences(cut, place, [company])
    return chunks.number_chunks(unique, place, (company, "category", "report_type", "source_type"))


def field_prompts(fields: DataFrame, chunk_table: DataFrame, company: str, load, k: int = L.TOP_K_PER_QUERY) -> tuple[DataFrame, DataFrame]:
    """Prompts and the evidence behind them for every (company, field)."""
    asked = retrieval.expand_fields(fields).withColumn("query_id", F.concat_ws(" / ", "field", "category", "query"))
    queries = retrieval.embed(asked, "query", load)
    corpus = retrieval.embed(chunk_table.select(company, "chunk_id", "category", "content"), "content", load)
    hits = retrieval.top_k_within(queries, corpus, [company], k, "chunk_id", {"category": "category"})
    named = hits.join(F.broadcast(asked), "query_id").select(company, "field", "query", "category", "chunk_id", "score")
    evidence = (retrieval.fuse(named, groups=(company, "field"))
                .join(chunk_table.select(company, "chunk_id", "report_type", "content"), [company, "chunk_id"]).withColumn("section", F.lit("")))
    every = expand_over(chunk_table.select(company).distinct(), fields)
    return responses.prompts(every, evidence, [company, "field"]), evidence
