"""Writers; Spark's committer makes each write all-or-nothing."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from filinglens.session import bounded_batches
from filinglens.sources import structure

SIGNAL_CSV_COLUMNS = ["stock_code", "company_name", "vector_score", "keyword_score", "edge_score", "centrality_score", "vector_rank",
                      "keyword_rank", "edge_rank", "centrality_rank", "vector_percentile", "keyword_percentile", "edge_percentile",
                      "centrality_percentile", "mean_percentile", "rank_spread", "top5_agreement", "top10_agreement",
                      "node_match_count", "edge_match_count"]


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "list", root_tag: str = "result") -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def write_structured(documents: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Documents and their child tables, one parquet folder each."""
    by = partition_by or []
    write_parquet(documents.select(*keys, "text", "markdown", "n_chars"), f"{path}/documents", by)
    write_parquet(structure.table_rows(documents, keys), f"{path}/tables", by)
    write_parquet(structure.cell_rows(documents, keys), f"{path}/cells", by)
    write_parquet(structure.image_rows(documents, keys), f"{path}/images", by)
    write_parquet(structure.document_counts(documents, keys), f"{path}/counts", by)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``content`` of every row as the file ``path`` below ``folder``; a task that runs again writes the same bytes."""
    bounded_batches(files.sparkSession)

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content.as_py())
            yield batch.select(["path"])

    return files.select("path", "content").mapInArrow(run, "path string").count()
