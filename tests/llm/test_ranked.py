"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from filinglens.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string, query string, lane string, weight long"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k=20):
    counts = [collections.Counter(terms(t)) for _, t in docs]
    n, total = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            s = 0
            for t in terms(text):
                if t in c:
                    m = 75 + 25 * sum(c.values()) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(str, out))


def got(out):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in out.collect())


def some_text(r, n):
    return " ".join(r.choice(["Alpha", "beta", "ñandú", "Größe", "seven7", "x"] + [f"w{int(r.paretovariate(0.6))}" for _ in range(6)]) for _ in range(n))


@pytest.mark.parametrize("options", [{}, {"size": 900, "lane": 2, "k": 3}, {"vocabulary": 0, "size": 3000}])
def test_equals_scoring_everything(spark, odd, options):
    r = random.Random(5)
    docs = [(i, some_text(r, r.choice([0, 1, 5, 40, 200]))) for i in range(300)] + [(7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (None, None), (901, "!!! ...")]
    items = [(1, some_text(r, 12)), (1, "beta beta Alpha"), (2, None), (None, "größe ÑANDÚ x"), (3, "nowhere"), (4, ""), (5, some_text(r, 60)), (5, some_text(r, 60)), (6, "x")]
    asked = spark.createDataFrame([(*i, "", "", 1) for i in items], ITEMS)
    out = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), asked, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and got(out) == plain(docs, items, options.get("k", 20))
    rows = [(x.doc_id, x.text) for x in odd.select("doc_id", "text").collect()]
    texts = [(9, "river stone walk"), (10, "word 1234 日本語"), (11, rows[8][1][:4000])]
    assert got(ranked.search(odd, spark.createDataFrame([(*i, "", "", 1) for i in texts], ITEMS), **options)) == plain(rows, texts, options.get("k", 20))


def test_empty(spark, none, odd):
    items = spark.createDataFrame([(1, "word", "", "", 1)], ITEMS)
    assert ranked.search(none, items).collect() == [] and ranked.search(odd, items.limit(0)).collect() == []
    assert ranked.search(odd.filter("text IS NULL"), items).collect() == []


def block_of(texts, n, total):
    data = [t.encode() for t in texts]
    lengths, at, starts, who, tf = ranked.counted(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), None)
    row = {"ids": list(range(len(texts))), "lengths": lengths.astype(np.int64).tobytes(), "terms": at.tobytes(), "starts": starts.astype(np.int64).tobytes(),
           "who": who.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    return ranked.Block(row, n, total)


def test_pair_bounds_skip_what_single_bounds_would_read(spark):
    """Two terms whose best documents differ: the sum of their maxima reaches the threshold, the pair's bound does not."""
    block = block_of(["aa aa aa aa x", "bb bb bb bb y", "aa bb z z z z z z z z z z z z"], 3, 24)
    a, b = (int(ranked.counted(np.frombuffer(t, np.uint8), np.array([0, 2]), None)[1][0]) for t in (b"aa", b"bb"))
    item = {"query": 1, "least": None, "terms": [{"term": a, "weight": 10}, {"term": b, "weight": 10}]}
    lists = ranked.Items([item], 2).lists(block)
    joint, single = int(lists[3][0].max()), [10 * int(block.most[p]) for p in block.places(np.array([a, b]))]
    assert lists[2][0].tolist() == [2] and joint < sum(single)
    asked = []
    item["least"] = (max(joint, *single) + sum(single)) // 2
    state = ranked.Items([item], 2)
    block.postings = lambda at: asked.append(at)
    state.score(block, {(0, 0): joint})
    assert state.best == [[]] and asked == []
