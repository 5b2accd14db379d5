"""The archive data source against whole archives in memory."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from filinglens.sources import archive_source as S
from filinglens.sources import archives, readers


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)

    def write(name, members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in members:
                z.writestr(n, c)
        (tmp_path / name).write_bytes(b.getvalue())
        return b.getvalue()

    write("a.zip", [("x.XML", "<p>짧음</p>".encode("cp949")), ("y.html", b"<p>longer</p>"), ("i/f.png", b"1"), ("j/f.png", b"2"), ("n.txt", b"")])
    write("b.zip", [("n.txt", b"")])
    (tmp_path / "c.zip").write_bytes(b"nonsense")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    (tmp_path / "deep").mkdir()
    big = write("deep/big.zip", [(f"{i}/m.html", bytes(rng.randrange(256) for _ in range(3000))) for i in range(40)] + [(f"{i}/p.jpg", b"x") for i in range(5)])
    broken = bytearray(big)
    broken[2000] ^= 255
    (tmp_path / "damaged.zip").write_bytes(bytes(broken))
    return tmp_path


def rows(df):
    out = df.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1)).select(*S.NAMES)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("split", [64 << 20, 20_000, 500])
def test_same_rows_as_whole_archives(spark, folder, split):
    got = S.archive_members(spark, str(folder), splitBytes=split, batchBytes=5000)
    empty = ("empty.zip", None, None, "error", 0, None, None, "BadZipFile")  # Spark's binary files leave empty ones out
    assert rows(got) == sorted([*rows(archives.members(readers.archives(spark, str(folder)))), empty], key=str)
    if split == 20_000:
        assert got.rdd.getNumPartitions() > 10


def test_only_asked_columns_are_made(spark, folder):
    got = S.archive_members(spark, str(folder), ["path", "kind", "saved_name"])
    assert got.columns == ["path", "kind", "saved_name"]
    whole = archives.members(readers.archives(spark, str(folder / "deep")))
    small = S.archive_members(spark, f"file://{folder}/deep", ["kind", "saved_name", "filename"])
    assert sorted(map(tuple, small.select("kind", "saved_name", "filename").collect()), key=str) == sorted(map(tuple, whole.select("kind", "saved_name", "filename").collect()), key=str)
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("filing_archives").schema("path string, nothing int").load(str(folder)).collect()


def test_a_task_reads_its_members_only(folder):
    """What is read of a large archive for one range: its directory and the members that begin there."""
    path = folder / "deep" / "big.zip"
    size = path.stat().st_size

    class Counting(io.FileIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.taken += len(data)
            return data

    found = []
    for pieces in S.planned([(str(path), size)], size // 8):
        (_, _, lo, hi), = pieces.ranges
        Counting.taken = 0
        with Counting(path) as f:
            found += [r[2] for r in archives.member_rows(str(path), f, size, lo, hi)]
        assert Counting.taken < size / 2
    assert len(found) == 45 and len(set(found)) == 45


def test_plan_joins_small_archives_and_cuts_large_ones():
    plan = S.planned([("a", 10), ("b", 95), ("c", 5), ("d", 250)], 100)
    assert [p.ranges for p in plan] == [[("a", 10, 0, None)], [("d", 250, 0, 100)], [("d", 250, 100, 200)], [("d", 250, 200, None)], [("b", 95, 0, None), ("c", 5, 0, None)]] or \
        sorted(r for p in plan for r in p.ranges) == sorted([("a", 10, 0, None), ("b", 95, 0, None), ("c", 5, 0, None), ("d", 250, 0, 100), ("d", 250, 100, 200), ("d", 250, 200, None)])
    assert S.planned([], 100) == []
