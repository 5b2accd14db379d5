"""The vector store after edits, deletions and a change of the model."""

import glob

import numpy as np

from filinglens.operators import retrieval
from filinglens.sources import vector_store as VS

TEXTS = "key long, text string"


def stored(spark, path, model=None):
    field = spark.createDataFrame([], TEXTS).schema["key"]
    return {(r.key, r.model): r.embedding for r in VS.read(spark, path, field, model).collect()}


def vectors(rows, dimension=32):
    encode = retrieval.hashing_encoder(dimension)()
    m = np.asarray(encode([t or "" for _, t in rows]))
    return {k: (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for (k, _), v in zip(rows, m)}


def same(got, want, model):
    mine = {k: v for (k, m), v in got.items() if m == model}
    return mine.keys() == want.keys() and all(np.allclose(mine[k], want[k], atol=1e-6) for k in want)


def test_edit_delete_and_model_change(spark, tmp_path):
    path, load = f"{tmp_path}/store", retrieval.hashing_encoder(32)
    rows = [(i, f"text number {i}") for i in range(60)] + [(None, "no key"), (100, None), (101, "")]
    df = spark.createDataFrame(rows, TEXTS)
    assert VS.sync(df, "key", "text", path, "a", load, buckets=8) == VS.Changes(63, 0, 0, 0, 8)
    assert same(stored(spark, path), vectors(rows), "a")
    assert VS.sync(df, "key", "text", path, "a", load, buckets=8) == VS.Changes(0, 0, 0, 63, 0)
    assert VS.sync(df.filter("key < 10"), "key", "text", path, "b", load, buckets=8).new == 10
    edited = [(k, "another text" if k == 5 else t) for k, t in rows if k not in (7, 8)]
    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    changes = VS.sync(spark.createDataFrame(edited, TEXTS), "key", "text", path, "a", load, buckets=8)
    assert (changes.new, changes.edited, changes.removed, changes.unchanged) == (0, 1, 2, 60) and 1 <= changes.folders <= 3
    after = set(glob.glob(f"{path}/bucket=*/*.parquet"))
    assert len({f.split("/")[-2] for f in before} - {f.split("/")[-2] for f in after & before.keys()}) <= changes.folders  # other folders stay as they were
    got = stored(spark, path)
    assert same(got, vectors(edited), "a") and same(got, vectors(rows[:10]), "b")


def test_only_changed_texts_are_encoded(spark, tmp_path):
    """The encoder sees new and edited texts, nothing else."""
    path, seen = f"{tmp_path}/store", f"{tmp_path}/seen"

    def load():
        encode = retrieval.hashing_encoder(16)()

        def logged(texts):
            with open(seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return encode(texts)
        return logged

    rows = [(i, f"t{i}") for i in range(20)]
    VS.sync(spark.createDataFrame(rows, TEXTS), "key", "text", path, "a", load)
    open(seen, "w").close()
    VS.sync(spark.createDataFrame([(i, "x" if i == 3 else t) for i, t in rows] + [(99, "y"), (99, "y")], TEXTS), "key", "text", path, "a", load)
    assert sorted(open(seen).read().split()) == ["x", "y"]


def test_all_rows_can_go(spark, tmp_path):
    path, load = f"{tmp_path}/store", retrieval.hashing_encoder(16)
    df = spark.createDataFrame([(1, "a"), (2, "b")], TEXTS)
    VS.sync(df, "key", "text", path, "a", load)
    assert VS.sync(df.limit(0), "key", "text", path, "a", load).removed == 2 and stored(spark, path) == {}
    assert VS.sync(df, "key", "text", path, "a", load).new == 2 and len(stored(spark, path)) == 2
