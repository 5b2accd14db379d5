"""Archives as a Spark data source: ``spark.read.format("filing_archives").load(folder)``.

Rows and schema are those of ``archives.members``.  A partition is a range of bytes of one archive or several small
archives, so a large archive is read by many tasks; each reads the directory at the archive's end and then, one by one,
the members that begin in its range.  No task holds more than one member and a bounded batch of rows.

Options: ``suffix`` (``.zip``), ``splitBytes`` (64 MB), ``batchBytes`` (8 MB).  With a schema given, only its columns
are made; without ``text`` no document is read at all.  Folders may be local to all machines (a shared mount) or of any
store that ``pyarrow.fs`` reads; for others there is ``readers.archives`` with ``archives.members``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from filinglens.sources.archives import MEMBER_SCHEMA, member_rows

SPLIT, BATCH = 64 << 20, 8 << 20
NAMES = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]


@dataclass
class Pieces(InputPartition):
    """Ranges (path, size, lo, hi) that one task reads."""

    ranges: list[tuple[str, int, int, int | None]]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def planned(files: list[tuple[str, int]], split: int) -> list[Pieces]:
    """Files (path, size) as partitions: large ones in ranges of ``split`` bytes, small ones together up to that size."""
    out, held, held_bytes = [], [], 0
    for path, size in sorted(files):
        if size > split:
            cuts = range(0, size, split)
            out += [Pieces([(path, size, lo, None if lo + split >= size else lo + split)]) for lo in cuts]
            continue
        if held and held_bytes + size > split:
            out.append(Pieces(held))
            held, held_bytes = [], 0
        held.append((path, size, 0, None))
        held_bytes += size
    return out + ([Pieces(held)] if held else [])


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.suffix = options["path"], options.get("suffix", ".zip").lower()
        self.split, self.batch = int(options.get("splitBytes", SPLIT)), int(options.get("batchBytes", BATCH))
        self.schema = schema

    def partitions(self):
        store, root = opened(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == pafs.FileType.Directory else [store.get_file_info(root)]
        return planned([(f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(self.suffix)], self.split) or [Pieces([])]

    def read(self, partition: Pieces):
        store, _ = opened(self.path)
        wanted = [NAMES.index(c) for c in self.schema.names]
        shape, rows, held = to_arrow_schema(self.schema), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in zip(wanted, shape)], schema=shape)

        for path, size, lo, hi in partition.ranges:
            with store.open_input_file(path) as file:
                for row in member_rows(path, file, size, lo, hi, "text" in self.schema.names):
                    rows.append(row)
                    held += 200 + (len(row[5]) if row[5] else 0)
                    if held >= self.batch:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "filing_archives"

    def schema(self):
        return MEMBER_SCHEMA

    def reader(self, schema):
        unknown = [c for c in schema.names if c not in NAMES]
        if unknown:
            raise ValueError(f"archives have no columns {unknown}")
        return ArchiveReader(self.options, schema)


def archive_members(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Members of all archives below ``path``, only ``columns`` of them where given."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("filing_archives").options(**{k: str(v) for k, v in options.items()})
    if columns:
        reader = reader.schema(", ".join(c for c in MEMBER_SCHEMA.split(", ") if c.split()[0] in columns))
    return reader.load(path)
