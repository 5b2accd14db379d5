"""Embedding, top-k retrieval, pooled company vectors and fused evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from filinglens import lexicon as L
from filinglens.functions import vectors as V
from filinglens.operators import vector_index
from filinglens.operators.lanes import laid, parts_for, streamed
from filinglens.operators.ordering import number_rows, top_per_group
from filinglens.session import broadcast_bytes, join_to_few, materialise

PAIR_TILE, LANE_TILES = 2048, 4
ENCODED_TOGETHER = 256


# --- encoding ---------------------------------------------------------------------------

def hashing_encoder(dimension: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Deterministic stand-in model: signed hashed character trigrams."""
    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), dtype=np.float64)
            for at in range(0, len(texts), ENCODED_TOGETHER):
                part = [f" {t.lower()} " for t in texts[at : at + ENCODED_TOGETHER]]
                size = np.array([len(t) for t in part])
                c = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                inside = np.ones(len(c), bool)  # no trigram crosses two texts
                inside[np.cumsum(size) - 1] = inside[np.cumsum(size) - 2] = False
                h = (c[:-2] * 73856093 ^ c[1:-1] * 19349663 ^ c[2:] * 83492791)[inside[:-2]] & 0xFFFFFFFF
                h = (h * 2654435761 & 0xFFFFFFFF) >> 7
                place = np.repeat(np.arange(len(part)) * dimension, size - 2) + ((h >> 1) % dimension).astype(np.int64)
                out[at : at + len(part)] = np.bincount(place, weights=np.where(h & 1, 1.0, -1.0), minlength=len(part) * dimension).reshape(-1, dimension)
            return out
        return encode
    return load


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), V.TINY, None)


def embed(rows: DataFrame, column: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """Add unit vectors; the model is loaded once per task and fed Arrow batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            if len(pdf):
                pdf[out] = list(_unit_rows(np.asarray(encode(pdf[column].fillna("").tolist()))).astype(np.float32))
                yield pdf

    return rows.mapInPandas(run, schema)


def checked_queries(queries: DataFrame, column: str = "query") -> tuple[DataFrame, DataFrame]:
    """Usable queries and the blank ones, which must not be searched."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return queries.filter(~blank), queries.filter(blank)


# --- top-k -------------------------------------------------------------------------------------

def top_k(queries: DataFrame, corpus: DataFrame, k: int, corpus_key: str, filters: dict[str, str] | None = None,
          digits: int = 6, query_block: int = vector_index.LANE) -> DataFrame:
    """Best ``k`` corpus rows per query by dot product, ties by ``corpus_key``.

    ``queries``: query_id, embedding and, per ``filters`` entry (corpus column →
    query column), a value the corpus row must equal.  Queries up to the broadcast
    threshold are broadcast and the corpus is read once where it lies; more queries
    meet an index of it.  To ask a corpus again, keep the index
    (``vector_index.build`` and ``search``).
    """
    queries = materialise(queries)
    size = queries.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()[0]
    if size <= broadcast_bytes(queries.sparkSession):
        return vector_index.scan(corpus, corpus_key, queries, k, filters, digits, query_block)
    index = vector_index.build(corpus, corpus_key, list(filters or {}))
    return vector_index.search(index, queries, k, filters, digits, query_block)


def top_k_within(queries: DataFrame, corpus: DataFrame, groups: list[str], k: int, corpus_key: str,
                 filters: dict[str, str] | None = None, digits: int = 6, query_block: int = vector_index.LANE) -> DataFrame:
    """Best ``k`` corpus rows per (group, query), every query asked in every group."""
    index = vector_index.build(corpus, corpus_key, list(filters or {}), groups)
    return vector_index.search(index, queries, k, filters, digits, query_block)


# --- pooled vectors ----------------------------------------------------------------------------------

def mean_vectors(rows: DataFrame, company: str, column: str = "embedding") -> DataFrame:
    """Mean of each company's vectors scaled to length one; null for a zero mean."""
    pooled = rows.filter(F.col(column).isNotNull()).groupBy(company).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(column).cast("array<double>")))).alias("_m"), F.count("*").alias("n_vectors"))
    return pooled.select(company, "n_vectors", V.unit_or_null(F.col("_m")).alias("vector"))


def rank_against_target(vectors: DataFrame, targets: DataFrame, company: str, target: str) -> DataFrame:
    """Cosine of every other company to its target's vector.

    ``targets``: company, target — one row per company to be compared.
    """
    mine = vectors.select(company, F.col("vector").alias("_v")).filter("_v is not null")
    theirs = (vectors.select(F.col(company).alias(target), F.col("vector").alias("_t")).filter("_t is not null")
              .join(targets.select(target).distinct(), target, "left_semi"))
    return (join_to_few(targets.join(mine, company), theirs, [target])
            .select(target, company, F.round(V.dot(F.col("_v"), F.col("_t")), 6).alias("similarity")))


# --- fused evidence --------------------------------------------------------------------------------------

def expand_fields(fields: DataFrame) -> DataFrame:
    """One row per (field, query, category) from array columns."""
    return (fields.select("field", F.explode("queries").alias("query"), "retrieval_categories")
            .select("field", "query", F.explode("retrieval_categories").alias("category")))


def fuse(hits: DataFrame, limit: int = L.EVIDENCE_LIMIT, groups: tuple[str, ...] = ("field",), key: str = "chunk_id") -> DataFrame:
    """Merge hits of one chunk over queries and categories, rank with small bonuses.

    ``hits``: groups, query, category, key, score.
    """
    merged = hits.groupBy(*groups, key).agg(
        F.countDistinct("query").alias("query_hits"), F.countDistinct("category").alias("category_hits"), F.max("score").alias("score"))
    fused = F.round(F.col("score") + L.QUERY_BONUS * (F.col("query_hits") - 1) + L.CATEGORY_BONUS * (F.col("category_hits") - 1), 6)
    ranked = top_per_group(merged.withColumn("fused_score", fused), list(groups), [F.desc("fused_score"), F.asc(key)], limit, "evidence_rank")
    return ranked.withColumn("evidence_id", F.concat(F.lit("E"), F.col("evidence_rank").cast("string")))


# --- sentence pairs ---------------------------------------------------------------------------------------------

class ClosePairs:
    """Of all pairs seen, the best ``pool`` that are among the ``k`` best of their row and column, and the best ``2 k``.

    Pairs are ordered by similarity (in millionths), then by their positions.  A pair that is passed over never makes
    another one place better than it is, so what is kept holds at least the pairs that count.
    """

    def __init__(self, k: int, pool: int):
        self.k, self.pool, self.floor = k, pool, None
        self.parts, self.held, self.room = [], 0, 4 * pool + 20_000

    def add(self, tp: np.ndarray, cp: np.ndarray, similarity: np.ndarray):
        """``similarity`` of all pairs of the ascending positions ``tp`` and ``cp``."""
        flat = similarity.ravel()
        # What rounds to the floor or above lies above its lower edge.
        at = np.arange(flat.size) if self.floor is None else np.flatnonzero(flat >= (self.floor - 1) / 1e6)
        if len(at) > self.room:
            at = self._dense(np.rint(similarity * 1e6).astype(np.int64))
        i, j = np.divmod(at, len(cp))
        self.parts.append((tp[i], cp[j], np.rint(flat[at] * 1e6).astype(np.int64)))
        self.held += len(at)
        if self.held > self.room or self.floor is None:
            self._prune()

    def _dense(self, s: np.ndarray) -> np.ndarray:
        """Places of the pairs of one tile that can be kept; ties are told apart by place, so a tile of equal pairs stays small."""
        n, m = s.shape
        rows = s * m + np.arange(m)[::-1]
        columns = s * n + np.arange(n)[::-1, None]
        every = s.ravel() * s.size + np.arange(s.size)[::-1]
        keep = np.ones(s.shape, bool)
        if m > self.k:
            keep &= rows >= np.partition(rows, m - self.k, axis=1)[:, [m - self.k]]
        if n > self.k:
            keep &= columns >= np.partition(columns, n - self.k, axis=0)[[n - self.k]]
        top = min(2 * self.k, s.size)
        return np.flatnonzero(keep.ravel() | (every >= np.partition(every, s.size - top)[s.size - top]))

    def _place(self, line: np.ndarray) -> np.ndarray:
        """Place of each pair among those of its line, in the order given."""
        order = np.argsort(line, kind="stable")
        first = np.searchsorted(line[order], line[order])
        out = np.empty(len(line), np.int64)
        out[order] = np.arange(len(line)) - first
        return out

    def _prune(self) -> np.ndarray:
        tp, cp, sim = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((cp, tp, -sim))
        tp, cp, sim = tp[order], cp[order], sim[order]
        close = (self._place(tp) < self.k) & (self._place(cp) < self.k)
        close &= np.cumsum(close) <= self.pool
        if close.sum() == self.pool:
            self.floor = int(sim[np.flatnonzero(close)[-1]])
        keep = close.copy()
        keep[: 2 * self.k] = True
        self.parts, self.held = [(tp[keep], cp[keep], sim[keep])], int(keep.sum())
        return close[keep]

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        close = self._prune()
        tp, cp, sim = self.parts[0]
        return tp, cp, sim / 1e6, close


def best_sentence_pairs(pairs: DataFrame, items: DataFrame, k: int, fill: bool = True, company: str = "company") -> DataFrame:
    """Most similar sentence pairs of each company pair, preferring unused sentences.

    Vectors that are null or hold a null or non-finite component take no part.

    ``pairs``: target, candidate.  ``items``: company, pos, embedding.  First pass:
    one-to-one by similarity; second pass (``fill``): best remaining pairs up to ``k``.

    Blocks of ``PAIR_TILE`` sentences of the candidates stream past lanes of the
    targets, so companies may be of any size.  A pick of the first pass is among the
    ``k`` best of its row and of its column, since earlier picks use fewer than ``k``
    of either; each earlier pick rules out at most ``2 k`` such pairs, so the best
    ``2 k² + k`` of them hold all picks.  The second pass needs the best ``2 k`` of all
    pairs.  Both hold for what a lane has seen so far, so it keeps only these
    (:class:`ClosePairs`) and passes over what is below the last of them.
    """
    spark, pool = items.sparkSession, 2 * k * k + k
    items = items.filter(F.col("embedding").isNotNull())

    def packed(side: DataFrame, who: str, rows: int, number: str) -> DataFrame:
        sizes = side.groupBy(company).agg(F.ceil(F.count("*") / rows).cast("int").alias("tiles"))
        tiled = side.join(sizes, company).withColumn("tile", F.pmod(F.xxhash64("pos"), F.col("tiles")).cast("int"))
        tiles = tiled.groupBy(company, "tile").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "embedding"))).alias("s"))
        side = F.struct(F.col(company).alias("who"), F.col("s.pos").alias("pos"), F.col("s.embedding").alias("vectors"))
        return materialise(tiles.select(F.col(company).alias(who), side.alias("side")).withColumn(number, F.monotonically_increasing_id()))

    lanes = packed(items.join(pairs.select(F.col("target").alias(company)).distinct(), company, "left_semi"), "target", LANE_TILES * PAIR_TILE, "lane")
    blocks = packed(items.join(pairs.select(F.col("candidate").alias(company)).distinct(), company, "left_semi"), "candidate", PAIR_TILE, "name")
    parts = parts_for(blocks.count(), lanes.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    meet = (lanes.select("lane", "target").join(pairs.select("target", "candidate").distinct(), "target")
            .join(blocks, "candidate").select("lane", "name", F.col("side").alias("large"), F.xxhash64("candidate").alias("next")))
    kind = T.StructType([T.StructField("target", pairs.schema["target"].dataType), T.StructField("candidate", pairs.schema["candidate"].dataType), T.StructField("tp", T.LongType()),
                         T.StructField("cp", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("close", T.BooleanType())])

    def unit(side):
        v = np.array(side["vectors"], np.float64).reshape(len(side["pos"]), -1)
        sound = np.isfinite(v).all(1)
        return np.array(side["pos"], np.int64)[sound], _unit_rows(v[sound])

    def begin(lane, small):
        return {"target": small["who"], "side": unit(small), "candidate": None, "found": None}

    def end(state):
        if state["found"] is None:
            return None
        tp, cp, sim, close = state["found"].kept()
        return [[state["target"]] * len(tp), [state["candidate"]] * len(tp), tp, cp, sim, close]

    def step(state, large):
        out = None
        if state["found"] is None or state["candidate"] != large["who"]:
            out = end(state)
            state["candidate"], state["found"] = large["who"], ClosePairs(k, pool)
        (tp, t), (cp, c) = state["side"], unit(large)
        for at in range(0, len(tp), PAIR_TILE):
            state["found"].add(tp[at : at + PAIR_TILE], cp, t[at : at + PAIR_TILE] @ c.T)
        return out

    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind])
    found = streamed(laid(lanes.select("lane", F.col("side").alias("small")), meet, parts), begin, step, end, shape, kind)
    order = [F.desc("sim"), F.asc("tp"), F.asc("cp")]
    pair = ["target", "candidate"]
    best = top_per_group(found, pair, order, 2 * k, "_r").drop("_r").withColumn("close", F.lit(False))
    close = top_per_group(found.filter("close"), [*pair, "tp"], order, k, "_r").drop("_r")
    close = top_per_group(top_per_group(close, [*pair, "cp"], order, k, "_r").drop("_r"), pair, order, pool, "_r").drop("_r")
    who = pairs.schema["target"].dataType.simpleString()
    listed = best.unionByName(close).groupBy(*pair, "tp", "cp", "sim").agg(F.max("close").alias("close"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", "tp", "cp"], ascending=[False, True, True], kind="stable")
        used_t, used_c, chosen, left = set(), set(), [], []
        for r in pdf.itertuples(index=False):
            if r.close and len(chosen) < k and r.tp not in used_t and r.cp not in used_c:
                used_t.add(r.tp), used_c.add(r.cp), chosen.append((r.tp, r.cp, r.sim, True))
            else:
                left.append((r.tp, r.cp, r.sim, False))
        if fill:
            chosen += left[: k - len(chosen)]
        rows = [(pdf["target"].iloc[0], pdf["candidate"].iloc[0], n + 1, *x) for n, x in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["target", "candidate", "pair_rank", "target_pos", "candidate_pos", "similarity", "one_to_one"], dtype=object)

    return listed.groupBy(*pair).applyInPandas(choose, f"target {who}, candidate {who}, pair_rank bigint, target_pos bigint, candidate_pos bigint, similarity double, one_to_one boolean")


# --- keyphrases --------------------------------------------------------------------------------------------------------

def keyphrases(rows: DataFrame, keys: list[str], column: str, load, top_n: int = L.KEYWORDS_PER_SENTENCE,
               diversity: float = L.MMR_DIVERSITY) -> DataFrame:
    """One- and two-word phrases of each sentence chosen by relevance and diversity.

    Every sentence is handled alone, so no shuffle is needed.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("phrase", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import re
        encode = load()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                text = getattr(r, column) or ""
                words = re.findall(r"\b\w\w+\b", text.lower())
                phrases = sorted(set(words) | {" ".join(p) for p in zip(words, words[1:])})
                if not phrases:
                    continue
                m = _unit_rows(np.asarray(encode([text, *phrases]), dtype=np.float64))
                relevance, among = m[1:] @ m[0], m[1:] @ m[1:].T
                for i in diverse_order(relevance, among, top_n, diversity):
                    out.append((*[getattr(r, k) for k in keys], phrases[i], round(float(relevance[i]), 4)))
            yield pd.DataFrame(out, columns=[*keys, "phrase", "score"], dtype=object)

    return rows.select(*keys, column).mapInPandas(run, schema)


def diverse_order(relevance: np.ndarray, among: np.ndarray, n: int, diversity: float) -> list[int]:
    """Greedy picks maximising relevance minus likeness to what is already picked."""
    picked = [int(np.argmax(relevance))]
    while len(picked) < min(n, len(relevance)):
        gain = (1 - diversity) * relevance - diversity * among[:, picked].max(axis=1)
        gain[picked] = -np.inf
        picked.append(int(np.argmax(gain)))
    return picked
