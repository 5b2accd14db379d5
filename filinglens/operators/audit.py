"""Recall audit: are missing fields absent from the filings or lost on the way?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X
from filinglens.operators.ordering import top_per_group

BUCKET = 200


def chunk_hits(chunks: DataFrame, company: str, field: str, keywords: list[str], limit: int = 5) -> DataFrame:
    """Chunks with the most keywords of a field."""
    hit = chunks.withColumn("matched_keywords", X.term_hits_nocase(F.col("content"), keywords)).withColumn("match_count", F.size("matched_keywords"))
    return top_per_group(hit.filter("match_count > 0"), [company], [F.desc("match_count"), F.asc("chunk_id")], limit).select(
        company, F.lit(field).alias("field"), "rank", "chunk_id", "match_count", F.array_join("matched_keywords", "|").alias("matched_keywords"))


def bucket_count(c: Column, keywords: list[str]) -> Column:
    """Number of 200-character buckets any keyword starts in."""
    low = F.lower(c)
    buckets = F.flatten(F.array(*[F.transform(X.occurrences(low, w.lower()), lambda p: F.floor(p / BUCKET)) for w in keywords]))
    return F.size(F.array_distinct(buckets))


def snippets(c: Column, keywords: list[str], reach: int = 350) -> Column:
    """One snippet per 200-character bucket, the first keyword in list order winning it."""
    low = F.lower(c)
    hits = F.flatten(F.array(*[
        F.transform(X.occurrences(low, w.lower()), lambda p: F.struct(
            F.floor(p / BUCKET).cast("int").alias("bucket"), F.lit(i).alias("k"), p.alias("pos"), F.lit(w).alias("keyword"),
            F.lit(len(w)).alias("width"))) for i, w in enumerate(keywords)]))
    ordered = F.array_sort(hits)
    firsts = F.filter(ordered, lambda h, i: (i == 0) | (F.try_element_at(ordered, i)["bucket"] != h["bucket"]))

    def cut(h):
        left = F.greatest(h["pos"] - reach, F.lit(0))
        body = X.squash(F.substring(c, left + 1, h["pos"] + h["width"] + reach - left))
        return F.struct(F.size(X.term_hits_nocase(body, keywords)).alias("match_count"), h["k"].alias("k"), h["pos"].alias("pos"),
                        h["keyword"].alias("keyword"), body.alias("snippet"))

    return F.transform(firsts, cut)


def document_hits(documents: DataFrame, company: str, field: str, keywords: list[str], keys: list[str], limit: int = 5, reach: int = 350) -> DataFrame:
    """Best snippets of a field over each company's documents."""
    rows = documents.select(company, *keys, F.explode(snippets(F.col("text"), keywords, reach)).alias("s"))
    flat = rows.select(company, *keys, "s.*")
    return top_per_group(flat, [company], [F.desc("match_count"), *[F.asc(k) for k in keys], F.asc("k"), F.asc("pos")], limit).withColumn("field", F.lit(field))


def diagnosis(raw: Column, chunked: Column) -> Column:
    return (F.when((raw == 0) & (chunked == 0), "absent_everywhere").when((raw > 0) & (chunked == 0), "lost_before_chunking")
            .when((raw > 0) & (chunked > 0), "retrieval_or_query").otherwise("source_position_unclear"))


def recall_audit(documents: DataFrame, chunks: DataFrame, company: str, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Raw and chunk hit counts of each field and what they suggest; the top lists are ``document_hits`` and ``chunk_hits``."""
    fields = fields or L.AUDIT_FIELDS
    raw_cols = {f: bucket_count(F.col("text"), k) for f, k in fields.items()}
    raw = documents.groupBy(company).agg(*[F.sum(c).alias(f"r_{f}") for f, c in raw_cols.items()])
    got = chunks.groupBy(company).agg(*[F.count_if(X.any_term(F.lower(F.col("content")), [w.lower() for w in k])).alias(f"c_{f}")
                                        for f, k in fields.items()])
    joined = raw.join(got, company, "full")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"r_{f}", F.lit(0)).cast("bigint").alias("raw_hits"),
                                        F.coalesce(f"c_{f}", F.lit(0)).cast("bigint").alias("chunk_hits")) for f in fields]))
    return joined.select(company, each.alias("e")).select(company, "e.*").withColumn("diagnosis", diagnosis(F.col("raw_hits"), F.col("chunk_hits")))
