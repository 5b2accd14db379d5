"""Vector best-fit packing of tokenised documents into sequences.

A piece of l tokens asks for a vector: l tokens, one document slot, l*l of attention cost.  A sequence has a
capacity in each of the three.  Pieces of one length are alike, so the packing works on the histogram of
lengths, which has at most ``tokens`` entries whatever the size of the corpus: a sequence is filled by taking,
again and again, the length that fits under every constraint and scores best, and the filling found is
repeated as often as the histogram allows.  The plan that comes out is a short list of fillings.

Pieces meet their places by rank: the k-th piece of a length takes the k-th place of that length.  Ranks come
from salted groups of bounded size and running counts of the salts; only the histogram and the plan, both
bounded by the capacity, pass through the driver.

Two measures choose the length: ``norm`` leaves the smallest weighted norm of the residual capacities,
``dot`` has the largest weighted dot product of demand and residual capacities.

Nulls and empty texts give one piece with the end token alone; null ids stay null; repeated rows are packed
each on its own; an empty table gives no pieces.  Pieces do not share a sequence's offsets, ties are broken by
doc_id, piece and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, kept_in_process, stored, whole_text
from filinglens.llm.kernel import U, Hashes, table_of

VOCABULARY = "byte_bpe_50k"
END = 2
TOKENS = 1024
MOST_WORDS = 400_000
RANK_GROUP = 100_000

_BREAKS = table_of(b" \n")
_ODD = table_of(b"\t\x0b\x0c\r")
_ASCII_LETTERS = table_of([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARKS = table_of([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_SPECIAL = b"<|endoftext|>"


class Encoder:
    """Byte-level BPE of many texts at once.

    Tokens never span the border between a visible character and a following blank, nor between an ASCII
    letter and a following ASCII mark, so a text is the concatenation of the chunks cut there and equal
    chunks are encoded once.  Texts with other white space or with a special token's string take the
    tokenizer's own way over the whole text.
    """

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.chunk = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.sizes, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def learn(self, h: int, chunk: bytes) -> int:
        ids = self.chunk(chunk.decode("utf-8"))
        k, n = len(self.known), len(ids)
        if k == len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * k), np.resize(self.sizes, 2 * k)
        while self.used + n > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.known[h], self.starts[k], self.sizes[k] = k, self.used, n
        self.ids[self.used : self.used + n] = ids
        self.used += n
        return k

    def odd(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts whose blanks or special strings the chunk rule doesn't cover."""
        at = [np.flatnonzero(_ODD[buf])]
        lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        if len(lead):
            b0, b1, b2 = buf[lead], buf[np.minimum(lead + 1, len(buf) - 1)], buf[np.minimum(lead + 2, len(buf) - 1)]
            blank = ((b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b0 == 0xE1) & (b1 == 0x9A)) | ((b0 == 0xE3) & (b1 == 0x80))
            blank |= (b0 == 0xE2) & (((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | (b1 == 0x81))
            at.append(lead[blank])
        data = buf.tobytes() if b"<|" in buf.tobytes() else b""
        k = data.find(_SPECIAL)
        while k >= 0:
            at.append(np.array([k]))
            k = data.find(_SPECIAL, k + 1)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return out

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        n = len(buf)
        if n == 0:
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        if len(self.known) > MOST_WORDS:
            self.forget()
        blank = _BREAKS[buf]
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = (blank[1:] & ~blank[:-1]) | (_MARKS[buf[1:]] & _ASCII_LETTERS[buf[:-1]])
        start[offsets[:-1][offsets[:-1] < n]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        odd = self.odd(buf, offsets)
        owner = np.searchsorted(offsets, s, "right") - 1
        use = ~odd[owner]
        s, e, owner = s[use], e[use], owner[use]
        distinct, first, inverse = np.unique(Hashes(buf).span(s, e), return_index=True, return_inverse=True)
        data, known = memoryview(buf), self.known
        index = np.fromiter((k if (k := known.get(h)) is not None else self.learn(h, bytes(data[s[i] : e[i]])) for h, i in zip(distinct.tolist(), first.tolist())), np.int64, len(distinct))
        entry = index[inverse]
        sizes = self.sizes[entry]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[entry] - (ends - sizes), sizes) + np.arange(total)]
        cut = np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(len(offsets)))]
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(offsets) - 1)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole.encode(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        return out


def piece_sums(ids: np.ndarray, tokens: int) -> list[int]:
    """CRC-32 of each piece of one document's ids; the first piece may be shorter."""
    data = np.append(ids, np.uint32(END)).astype("<u4").tobytes()
    head = len(data) % (4 * tokens)
    cuts = [*([0] if head else []), *range(head, len(data) + 1, 4 * tokens)]
    return [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n (ids of the document with its end token), sums (one checksum per piece)."""
    def run(batches):
        encoder = kept_in_process(f"encoder_{vocabulary}", lambda: Encoder(vocabulary))
        for batch in batches:
            sizes, sums = [], []
            for _, _, buf, offsets in blocks(batch.column("text")):
                for ids in encoder(buf, offsets):
                    sizes.append(len(ids) + 1)
                    sums.append(piece_sums(ids, tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "n", "sums"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n long, sums array<long>")


def fillings(counts: dict[int, int], tokens: int = TOKENS, documents_: int | None = None, cost: int | None = None,
             weights: tuple[float, float, float] = (1.0, 0.01, 0.05), measure: str = "norm") -> list[tuple[int, list[int]]]:
    """Vector best fit over a histogram of lengths: (how many sequences, the lengths in each)."""
    limit = np.array([tokens, documents_ or tokens, cost or tokens * tokens], float)
    if any(l > limit[0] or l * l > limit[2] for l, n in counts.items() if n):
        raise ValueError("a piece exceeds the capacity of a sequence")
    lengths = np.array(sorted((l for l, n in counts.items() if n), reverse=True), np.int64)
    left = np.array([counts[l] for l in lengths], np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths]).astype(float)
    scale = np.array(weights)[:, None]
    plan = []
    while left.any():
        rest, taken = limit.copy(), []
        spare = left.copy()
        while True:
            fits = (spare > 0) & (demand <= rest[:, None]).all(0)
            if not fits.any():
                break
            if measure == "norm":
                score = -(scale * ((rest[:, None] - demand) / limit[:, None]) ** 2).sum(0)
            else:
                score = (scale * demand * rest[:, None] / (limit * limit)[:, None]).sum(0)
            k = int(np.argmax(np.where(fits, score, -np.inf)))
            taken.append(k)
            spare[k] -= 1
            rest = rest - demand[:, k]
        kinds, each = np.unique(taken, return_counts=True)
        times = int((left[kinds] // each).min())
        left[kinds] -= times * each
        plan.append((times, [int(lengths[k]) for k in taken]))
    return plan


class Places:
    """Where the k-th piece of a length goes, for whole arrays of lengths and ranks."""

    SHIFT = 44

    def __init__(self, plan: list[tuple[int, list[int]]]):
        rows, used, sequence = [], {}, 0
        for times, lengths in plan:
            at: dict[int, list[int]] = {}
            offset = 0
            for l in lengths:
                at.setdefault(l, []).append(offset)
                offset += l
            for l, offsets in at.items():
                rows.append((l, used.get(l, 0), sequence, offsets))
                used[l] = used.get(l, 0) + times * len(offsets)
            sequence += times
        rows.sort()
        self.keys = np.array([(l << self.SHIFT) + first for l, first, _, _ in rows], np.int64)
        self.first = np.array([r[1] for r in rows], np.int64)
        self.sequence = np.array([r[2] for r in rows], np.int64)
        self.each = np.array([len(r[3]) for r in rows], np.int64)
        self.begin = np.cumsum([0, *self.each[:-1]]) if rows else np.zeros(0, np.int64)
        self.offsets = np.array([o for r in rows for o in r[3]], np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, (length << self.SHIFT) + rank, "right") - 1
        j = rank - self.first[k]
        return self.sequence[k] + j // self.each[k], self.offsets[self.begin[k] + j % self.each[k]]


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Add ``rank`` = 0, 1, … among the pieces of a length; no window spans more than a salted share of a length."""
    salts = max(1, -(-total // RANK_GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("in_salt"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("in_salt").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("own", F.row_number().over(own).cast("long")).join(counts, ["length", "salt"])
            .withColumn("rank", F.col("own") - 1 + F.col("before")).drop("salt", "own", "before"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, tokens: int = TOKENS, documents_: int | None = None, cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.05), measure: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    done = stored(tokenised(docs, vocabulary, tokens), "tokenised")
    head = F.col("n") % tokens
    pieces = done.select("doc_id", "n", F.posexplode("sums").alias("piece", "ids_crc32")).select(
        "doc_id", "piece",
        F.when((F.col("piece") == 0) | (head == 0), F.col("piece").cast("long") * tokens).otherwise(head + (F.col("piece") - 1).cast("long") * tokens).alias("start"),
        F.when((F.col("piece") == 0) & (head > 0), head).otherwise(F.lit(tokens).cast("long")).alias("length"), "ids_crc32")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(fillings(counts, tokens, documents_, cost, weights, measure))

    def put(batches):
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_vector_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


QUERIES = {"op7_vector_packing": op7_vector_packing}
SQL = {}
