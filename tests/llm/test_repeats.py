import hashlib
import random

import numpy as np
import pytest

from filinglens.llm import repeats


def brute(texts, length):
    seen = {}
    for t, data in enumerate(texts):
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], []).append((t, i))
    gone = [np.zeros(len(d), bool) for d in texts]
    for where in seen.values():
        if len(where) > 1:
            for t, i in where:
                gone[t][i : i + length] = True
    return gone


def digest(data, gone):
    kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
    return len(data), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,gram,most", [(40, 8, 20_000), (40, 8, 2), (60, 16, 3)])
def test_removal_equals_brute_force(spark, length, gram, most):
    draw = random.Random(length + most)
    shared = ["".join(draw.choice("abcdé ") for _ in range(n)) for n in (35, 45, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = ["".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(0, 50))) for _ in range(4)]
        texts.append("".join(p + (draw.choice(shared) if draw.random() < 0.6 else "") for p in parts))
    texts += [texts[0], "ab" * 100, "x" * 150, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string")
    data = [(t or "").encode() for t in texts] + [texts[5].encode()]
    want = sorted((i % 65 if i < 65 else 5, *digest(d, g)) for i, (d, g) in enumerate(zip(data, brute(data, length))))
    got = sorted(tuple(r) for r in repeats.digested(docs, length=length, gram=gram, most=most).collect())
    assert got == want


def test_maximal_repeats_have_all_occurrences():
    rights = sorted([b"abcX1", b"abcX2", b"abcY", b"abd"])
    lefts = [{b"abcX1": b"pq", b"abcX2": b"pr", b"abcY": b"pq", b"abd": b"zz"}[r] for r in rights]
    got = {(a, b, tuple(sorted(rights[m] for m in members))) for a, b, members in repeats.maximal_repeats(rights, lefts, 4)}
    assert got == {(1, 4, (b"abcX1", b"abcX2")), (1, 3, (b"abcX1", b"abcX2", b"abcY")), (2, 3, (b"abcX1", b"abcY"))}


@pytest.mark.parametrize("most", [20_000, 2])
def test_shorter_passages_are_seen_and_not_removed(spark, most):
    """Passages below the removal length are counted by brute force's rule, and the removal stays the same."""
    draw = random.Random(most)
    shared = ["".join(draw.choice("abcdé ") for _ in range(n)) for n in (20, 26, 35, 38, 45, 90)]
    texts = ["".join("".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(0, 40))) + (draw.choice(shared) if draw.random() < 0.5 else "") for _ in range(3)) for _ in range(50)]
    texts += [texts[0], "ab" * 50, "x" * 39, "x" * 30, "a short text that stands twice", "a short text that stands twice", None, ""]
    data = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *digest(d, g), int(s.sum())) for i, (d, g, s) in enumerate(zip(data, brute(data, 40), brute(data, 25)))]
    got = repeats.digested(docs, length=40, gram=8, most=most, passage=25)
    assert got.columns[-1] == "n_passage" and sorted(map(tuple, got.collect())) == want
    assert any(w[-1] > 0 == w[2] for w in want)


def test_query_shows_planted_passages(spark, tmp_path):
    """A passage of 51 words, shorter than 400 bytes, in two documents: not removed, but seen by the query."""
    draw = random.Random(51)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(3, 9))) for _ in range(n))
    passage = words(51)
    docs = spark.createDataFrame([(1, f"{words(90)} {passage} {words(90)}"), (2, f"{words(20)} {passage} {words(50)}"), (3, words(300))], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in repeats.op1_interval_tree(spark, str(tmp_path)).collect()}
    assert 256 < len(passage) < 390 and all(r.n_removed == 0 for r in got.values())
    assert got[3].n_passage == 0 and all(len(passage) <= got[i].n_passage <= len(passage) + 20 for i in (1, 2))


def test_farthest_equals_the_maximal_repeats():
    draw = random.Random(9)
    for _ in range(200):
        rows = sorted(tuple("".join(draw.choice("ab") for _ in range(draw.randrange(n))).encode() for n in (8, 6)) for _ in range(draw.randrange(2, 30)))
        rights, lefts = [b"gg" + r for r, _ in rows], [x for _, x in rows]
        got = repeats.farthest(rights, lefts, (7, 4))
        for k, size in enumerate((7, 4)):
            want = np.zeros((len(rows), 2), int)
            for left, right, members in repeats.maximal_repeats(rights, lefts, size):
                want[members] = np.maximum(want[members], (left, right))
            assert np.array_equal(got[k], want)


def test_groups_report_every_place(spark):
    passage = "the same passage of sixty and more bytes stands in three of the documents"
    docs = spark.createDataFrame([(1, "aa " + passage + " bb"), (2, "cc " + passage + " dd"), (3, passage), (4, "nothing of the kind")], "doc_id long, text string")
    rows = repeats.repeat_groups(docs, length=40, gram=8).collect()
    best = max({r.name for r in rows}, key=lambda n: (len({r.doc_id for r in rows if r.name == n}), sum(r.end - r.start for r in rows if r.name == n)))
    assert {r.doc_id for r in rows if r.name == best} == {1, 2, 3} and 4 not in {r.doc_id for r in rows}


def test_odd_rows(odd, none):
    got = {}
    for r in repeats.digested(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[12]) == 2 and all(r.n_removed == r.n_bytes > 400 for r in got[12]) and got[1][0].n_bytes == 0 and got[7][0].n_removed == got[7][0].n_bytes
    assert repeats.digested(none).collect() == []
