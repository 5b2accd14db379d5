"""Archive members as rows."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.operators.ordering import latest_per_group

_BATCH_BYTES = 8 << 20
MEMBER_SCHEMA = "path string, member_pos int, filename string, kind string, size bigint, text string, saved_name string, error string"


# What a damaged, encrypted or unsupported archive or member raises.
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)


def decode(raw: bytes) -> str:
    for name in L.TEXT_ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", errors="ignore")


def safe_name(name: str) -> str:
    """File name without characters a file system refuses."""
    return name.translate(str.maketrans({c: "_" for c in '\\/:*?"<>|'})).strip()


def saved_names(names: list[str]) -> dict[int, str]:
    """File names for the images among an archive's members, by place; a name in use gets a number."""
    out, used = {}, set()
    for pos, name in enumerate(names):
        if name.lower().endswith(L.IMAGE_SUFFIXES):
            base = safe_name(name.rsplit("/", 1)[-1])
            stem, dot, suffix = base.rpartition(".")
            saved, n = base, 0
            while saved in used:
                n += 1
                saved = f"{stem}_{n}{dot}{suffix}"
            used.add(saved)
            out[pos] = saved
    return out


def member_rows(path: str, file, size: int, lo: int = 0, hi: int | None = None, text: bool = True) -> Iterator[tuple]:
    """Rows of an open archive's members whose bytes begin in [lo, hi); errors of the whole archive come with its first byte.

    Members are read one by one; the archive itself is never held.  Without ``text`` no document is read, and sizes
    are those of the directory.
    """
    try:
        with zipfile.ZipFile(file) as z:
            infos = z.infolist()
            images = saved_names([i.filename for i in infos])
            documents = 0
            for pos, info in enumerate(infos):
                name = info.filename
                document = name.lower().endswith(L.DOCUMENT_SUFFIXES)
                documents += document
                if not (lo <= info.header_offset and (hi is None or info.header_offset < hi)):
                    continue
                if document and not text:
                    yield path, pos, name, "document", info.file_size, None, None, None
                elif document:
                    try:
                        raw = z.read(info)
                    except _BROKEN as e:
                        yield path, pos, name, "error", info.file_size, None, None, type(e).__name__
                        continue
                    yield path, pos, name, "document", len(raw), decode(raw), None, None
                elif pos in images:
                    yield path, pos, name, "image", info.file_size, None, images[pos], None
    except _BROKEN as e:
        if lo == 0:  # files of other stores refuse places before their beginning in their own words
            yield path, None, None, "error", size, None, None, "BadZipFile" if isinstance(e, ValueError) else type(e).__name__
        return
    if not documents and lo == 0:
        yield path, None, None, "error", size, None, None, "NoDocument"


def members(archives: DataFrame) -> DataFrame:
    """One row per document or image member.

    An unreadable member gives an error row and the others stay; so does an archive that can't be opened or has no document.
    """
    names = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"]):
                rows += member_rows(path, io.BytesIO(content), len(content or b""))
                if sum(r[4] or 0 for r in rows) >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return archives.select("path", "content").mapInPandas(run, MEMBER_SCHEMA)


def main_documents(documents: DataFrame, keys: list[str], by: str = "n_chars", keep: list[str] | None = None, prefer: Column | None = None) -> DataFrame:
    """One document of each archive: a preferred one if any, then the largest ``by``, then the earliest member.

    ``prefer`` is a condition such as the file being named after the filing.
    """
    rest = keep or [c for c in documents.columns if c not in keys and c not in (by, "member_pos")]
    ranked = documents.withColumns({"_neg": -F.col("member_pos"), "_first": F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(False)})
    return latest_per_group(ranked, keys, ["_first", by, "_neg"], [*rest, "member_pos"]).drop("_neg", "_first")


def newest_archive(listing: DataFrame, keys: list[str], name: str = "filename") -> DataFrame:
    """Last archive by name for each key, such as a report class."""
    return listing.groupBy(*keys).agg(F.max(name).alias(name))
