"""Evidence tables and retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X
from filinglens.operators.ordering import number_rows, top_per_group
from filinglens.session import join_safe


def table_search_text(rows: Column) -> Column:
    """Non-empty cells of each row joined by a pipe, rows joined by newline."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda c: c["text"]), lambda t: t != ""), " | "))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def table_markdown(rows: Column) -> Column:
    """Cells as a pipe table: pipes escaped, spans and short rows padded, rule under the first row."""
    def cells(r):
        return F.flatten(F.transform(r, lambda c: F.concat(
            F.array(F.replace(c["text"], F.lit("|"), F.lit("\\|"))),
            F.array_repeat(F.lit(""), F.greatest(F.coalesce(c["colspan"], F.lit(1)), F.lit(1)) - 1))))

    wide = F.transform(rows, cells)
    width = F.array_max(F.transform(wide, F.size))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    padded = F.transform(wide, lambda a: line(F.concat(a, F.array_repeat(F.lit(""), width - F.size(a)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(
        F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size(padded), F.lit(1)))), "\n")).otherwise(F.lit(""))


def text_blocks(documents: DataFrame, keys: list[str], column: str = "text", limit: int = L.BLOCK_MAX_CHARS) -> DataFrame:
    return documents.select(*keys, F.posexplode(X.pack_paragraphs(F.col(column), limit)).alias("block_index", "content"))


def _scored(rows: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """One row per (candidate, category) with at least one keyword."""
    tags = F.array(*[F.struct(F.lit(c).alias("category"), X.term_hits_nocase(F.col("content"), t).alias("matched"))
                     for c, t in keywords.items()])
    return (rows.select("*", F.explode(F.filter(tags, lambda x: F.size(x["matched"]) > 0)).alias("_m"))
            .select("*", F.col("_m.category").alias("category"), F.col("_m.matched").alias("matched_keywords"),
                    F.size("_m.matched").alias("score")).drop("_m"))


def report_weight(category: Column, report: Column, priority=None) -> Column:
    out = F.lit(1.0)
    for c, order in (priority or L.REPORT_PRIORITY).items():
        for kind, w in zip(order, L.PRIORITY_WEIGHTS):
            out = F.when((category == c) & (report == kind), F.lit(w)).otherwise(out)
    return out


def category_evidence(texts: DataFrame, tables: DataFrame, company: str, keywords=None, priority=None, per_report: int = 15,
                      final: int = 25) -> DataFrame:
    """Best text blocks and tables per category, weighted by report class.

    ``texts``: company, report_type, block_index, content.
    ``tables``: company, report_type, table_id, content, markdown.
    """
    keywords = keywords or L.CATEGORY_KEYWORDS
    both = texts.withColumn("type", F.lit("text")).unionByName(tables.withColumn("type", F.lit("table")), allowMissingColumns=True)
    scored = _scored(both, keywords)
    order = [F.desc("score"), F.desc(F.length("content")), F.asc_nulls_last("block_index"), F.asc_nulls_last("table_id")]
    first = top_per_group(scored, [company, "report_type", "category", "type"], order, per_report, "_r")
    weight = report_weight(F.col("category"), F.col("report_type"), priority)
    weighted = first.withColumns({"priority_weight": weight, "final_score": F.round(F.col("score") * weight, 4)}).drop("_r")
    order = [F.desc("final_score"), F.desc("score"), F.asc("report_type"), F.desc("type"), *order[1:]]
    return top_per_group(weighted, [company, "category"], order, final, "evidence_rank")


def chunk_rows(evidence: DataFrame, keys: list[str], heading_patterns=None, heading_keywords=None) -> DataFrame:
    """Evidence cut into pieces: tables whole, text by heading then length."""
    whole = F.array(X.clean_chunk(F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(F.col("content"))))
    pieces = F.when(F.col("source_type") == "table", whole).otherwise(
        X.text_pieces(F.col("content"), patterns=heading_patterns, keywords=heading_keywords))
    cut = evidence.select(*keys, F.posexplode(pieces).alias("piece_index", "chunk"))
    return cut.filter("chunk <> ''").withColumn("fingerprint", X.fingerprint(F.col("chunk")))


def first_occurrences(rows: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """Keep the earliest row of each fingerprint.

    The winner comes from a partial aggregate, so many copies of one text never
    meet in a single task.
    """
    by = [*(scope or []), "fingerprint"]
    first = rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("_o")).select(*by, *[F.col(f"_o.{c}").alias(c) for c in order])
    return join_safe(rows, first.select(*dict.fromkeys([*by, *order])), list(dict.fromkeys([*by, *order])), "left_semi")


def number_chunks(chunks: DataFrame, order: list[str], groups=("category", "report_type", "source_type")) -> DataFrame:
    """Chunk ids ``category_report_source_0001`` in the given order."""
    numbered = number_rows(chunks, [F.asc(c) for c in order], "_n", list(groups))
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    return numbered.withColumn("chunk_id", F.concat_ws("_", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups], padded)).drop("_n")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunk counts by category, by source type, by report type and in all."""
    sets = F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
        F.struct(F.lit("source_type").alias("dimension"), F.col("source_type").alias("value")),
        F.struct(F.lit("report_type").alias("dimension"), F.col("report_type").alias("value")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value"))))
    return (chunks.groupBy("category", "source_type", "report_type").agg(F.count("*").alias("n"))
            .select(sets.alias("d"), "n").groupBy("d.dimension", "d.value").agg(F.sum("n").alias("n_chunks")))
