"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams, the word itself (all hashed into ``buckets``) and the
lexicons it is in; lexicons hold the words of the fitted rows that stand in one language nearly always.  The
transitions between the labels of neighbouring words are learnt too.  In scripts without blanks (Han, kana, Thai and
the like) every character counts as a word; a word is read in its whole length.  Labels come from the rows' lang, one per
text; half of the training sequences are spliced from texts of two languages, so that switching is learnt.  The
likelihood's gradient and the word labels both come from forward-backward.

A document's prediction is the label with the largest mean marginal over its words, the score is that mean; of
equal labels the first in order.  Forward-backward runs exactly over whole texts: chunks of words give transfer
matrices, these are chained per text, and then every chunk is resolved with its own borders.

The model is fitted in one task on at most ``labelled_rows`` labelled rows (whole texts, chosen by hash) outside
the held-out fold; scoring is one pass without a shuffle.  Only texts are read for a prediction.

A null text, or one without a letter, gets ``und`` and score 0.  Without any labelled row every text gets ``und``.
Repeated rows are scored each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, fold, kept_in_process, whole_text
from filinglens.llm.kernel import LETTERS, LOWER, Hashes, words

LABELLED_ROWS = 2_000
BUCKETS = 1 << 15
FOLDS, HELD_OUT = 4, 2
NONE = "und"
CHUNK = 32
SPAN = 24
MOST_WORDS = 300_000
TOGETHER = 1 << 17
CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def crc32_of(buf: np.ndarray, s: np.ndarray, e: np.ndarray, head: bytes = b"") -> np.ndarray:
    """crc32 of ``head`` and each short span [s, e) of ``buf``, byte by byte for all spans together."""
    state = np.full(len(s), zlib.crc32(head) ^ 0xFFFFFFFF, np.uint32)
    at, open_ = s, np.arange(len(s))
    while len(open_):
        more = at < e[open_]
        at, open_ = at[more], open_[more]
        now = state[open_]
        state[open_] = CRC[(now ^ buf[at]) & np.uint32(255)] ^ (now >> np.uint32(8))
        at = at + 1
    return state ^ np.uint32(0xFFFFFFFF)


def words_features(words_: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affixes, n-grams and identity of lower-cased words: word's number and feature, both ascending."""
    marked = [f"<{w}>".encode("utf-8") for w in words_]
    buf = np.frombuffer(b"".join(marked), np.uint8)
    ends = np.cumsum([len(m) for m in marked])
    sign = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    last = np.searchsorted(sign, ends)
    first = np.concatenate(([0], last[:-1]))
    owner = np.repeat(np.arange(len(marked)), last - first)
    found = [(np.arange(len(marked)), np.array([zlib.crc32(m) for m in marked], np.uint32))]
    for k in (2, 3, 4, 5):
        w = np.flatnonzero(last - first > k)
        found += [(w, crc32_of(buf, sign[first[w]], sign[first[w] + k])), (w, crc32_of(buf, sign[last[w] - k], sign[last[w]]))]
    for k in (2, 3):
        i = np.flatnonzero(np.arange(len(owner)) + k <= last[owner])
        found.append((owner[i], crc32_of(buf, sign[i], sign[i + k], b"_")))
    both = np.sort(np.concatenate([w * buckets + crc.astype(np.int64) % buckets for w, crc in found]))
    both = both[np.append(True, both[1:] != both[:-1])]  # several times as fast as np.unique here
    return both // buckets, both % buckets


def word_features(word: str, buckets: int) -> list[int]:
    """Features of one lower-cased word."""
    return words_features([word], buckets)[1].tolist()


def positions(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chain's positions, and where each text's begin: words, and single characters of scripts without blanks."""
    s, e, first = words(low, offsets, LETTERS)
    lead = np.flatnonzero(low >= 0xE0)
    if not len(lead):
        return s, e, first
    a, b, c = low[lead], low[np.minimum(lead + 1, len(low) - 1)], low[np.minimum(lead + 2, len(low) - 1)]
    # Thai, Lao, Tibetan; Myanmar; Khmer; kana, Han and Yi; compatibility and wide forms; further Han.
    alone = (a == 0xE0) & (b >= 0xB8) | (a == 0xE1) & ((b <= 0x81) | (b == 0x82) & (c < 0xA0) | (b == 0x9E) | (b == 0x9F))
    alone |= (a >= 0xE3) & (a <= 0xE9) | (a == 0xEA) & (b <= 0x93) | (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b >= 0xBC) & (b <= 0xBE)) | (a == 0xF0) & (b >= 0xA0)
    at = lead[alone]
    end = at + np.where(a[alone] == 0xF0, 4, 3)
    s, e = np.unique(np.concatenate((s, at, np.setdiff1d(end, e)))), np.unique(np.concatenate((e, end, np.setdiff1d(at, s))))
    return s, e, np.searchsorted(s, offsets)


class Field:
    """Weights of a fitted chain: emission by feature, transition by pair, start."""

    def __init__(self, langs: list[str], buckets: int, lexicon: dict[str, int]):
        n = len(langs)
        self.langs, self.buckets, self.lexicon = langs, buckets, lexicon
        self.emit, self.move, self.start = np.zeros((buckets + n, n)), np.zeros((n, n)), np.zeros(n)

    def features(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of one word after the other, and how many each has."""
        owner, hashed = words_features(words_, self.buckets)
        own = np.array([self.lexicon.get(w, -1) for w in words_], np.int64)
        listed = np.flatnonzero(own >= 0)
        at = np.searchsorted(owner, listed, "right")
        return np.insert(hashed, at, self.buckets + own[listed]), np.bincount(owner, minlength=len(words_)) + (own >= 0)

    def emissions(self, words_: list[str]) -> np.ndarray:
        flat, sizes = self.features(words_)
        return np.add.reduceat(self.emit[flat], np.cumsum(sizes) - sizes, axis=0)


def decoded(buf: np.ndarray, s: int, e: int) -> str:
    return bytes(buf[s:e]).decode("utf-8", "replace").lower()


def portions(words_: list[str], size: int = TOGETHER) -> Iterator[list[str]]:
    """Runs of words of about ``size`` characters, so that what is made for them stays bounded."""
    ends = np.cumsum([len(w) for w in words_])
    lo = 0
    while lo < len(words_):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield words_[lo:hi]
        lo = hi


def chain_gradient(field: Field, emission: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected minus observed counts for a batch of sequences of one length: by position, by transition, by start."""
    m, t, n = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True))
    a = np.exp(field.move)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = np.exp(field.start) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        alpha[:, k] = (alpha[:, k - 1] @ a) * e[:, k]
        alpha[:, k] /= alpha[:, k].sum(1, keepdims=True)
    moves = np.zeros((n, n))
    for k in range(t - 2, -1, -1):
        ahead = e[:, k + 1] * beta[:, k + 1]
        both = alpha[:, k, :, None] * a * ahead[:, None, :]
        moves += (both / both.sum((1, 2), keepdims=True)).sum(0)
        beta[:, k] = ahead @ a.T
        beta[:, k] /= beta[:, k].sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    start = p[:, 0].sum(0) - np.bincount(label[:, 0], minlength=n)
    np.add.at(moves, (label[:, :-1].ravel(), label[:, 1:].ravel()), -1.0)
    p[np.arange(m)[:, None], np.arange(t), label] -= 1
    return p, moves, start


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, str]], buckets: int, epochs: int = 2, rate: float = 0.3, seed: int = 7) -> Field:
    """Fit on rows of (bytes, word starts, word ends, lang)."""
    langs = sorted({lang for *_, lang in rows})
    number = {x: k for k, x in enumerate(langs)}
    vocabulary: dict[str, int] = {}
    texts, owners = [], []
    for buf, s, e, lang in rows:
        ids = np.array([vocabulary.setdefault(decoded(buf, a, b), len(vocabulary)) for a, b in zip(s, e)], np.int64)
        if len(ids):
            texts.append(ids)
            owners.append(number[lang])
    seen = np.zeros((len(vocabulary), len(langs)))
    for ids, k in zip(texts, owners):
        np.add.at(seen[:, k], ids, 1)
    total = seen.sum(1)
    clear = (total >= 5) & (seen.max(1, initial=0) >= 0.9 * total)
    names = list(vocabulary)
    field = Field(langs, buckets, {names[i]: int(seen[i].argmax()) for i in np.flatnonzero(clear)})
    features = [field.features(some) for some in portions(names)]
    flat, sizes = (np.concatenate(x) for x in zip(*features))
    begin = np.cumsum(sizes) - sizes
    pieces = [(ids[i : i + SPAN], k) for ids, k in zip(texts, owners) for i in range(0, len(ids), SPAN)]
    pieces = [(np.resize(p, SPAN), k) for p, k in pieces]
    draw = np.random.default_rng(seed)
    square = [np.full_like(field.emit, 1e-6), np.full_like(field.move, 1e-6), np.full_like(field.start, 1e-6)]
    for _ in range(epochs):
        order, other = draw.permutation(len(pieces)), draw.permutation(len(pieces))
        for lo in range(0, len(order), 256):
            ids, label = [], []
            for i, j in zip(order[lo : lo + 256], other[lo : lo + 256]):
                cut = int(draw.integers(4, SPAN - 4)) if draw.random() < 0.5 else SPAN
                ids.append(np.concatenate((pieces[i][0][:cut], pieces[j][0][cut:])))
                label.append(np.repeat([pieces[i][1], pieces[j][1]], [cut, SPAN - cut]))
            ids, label = np.stack(ids), np.stack(label)
            own, inverse = np.unique(ids, return_inverse=True)
            ends = np.cumsum(sizes[own])
            at = flat[np.repeat(begin[own] - (ends - sizes[own]), sizes[own]) + np.arange(ends[-1])]
            each = np.add.reduceat(field.emit[at], ends - sizes[own], axis=0)
            p, moves, start = chain_gradient(field, each[inverse.reshape(ids.shape)], label)
            by_word = np.zeros_like(each)
            np.add.at(by_word, inverse.ravel(), p.reshape(-1, len(langs)))
            touched, where = np.unique(at, return_inverse=True)
            g = np.zeros((len(touched), len(langs)))
            np.add.at(g, where, np.repeat(by_word, sizes[own], axis=0))
            n = len(ids)
            for weights, sq, grad, rows_ in ((field.emit, square[0], g / n + 1e-5 * field.emit[touched], touched), (field.move, square[1], moves / n, slice(None)), (field.start, square[2], start / n, slice(None))):
                sq[rows_] += grad * grad
                weights[rows_] -= rate * grad / np.sqrt(sq[rows_])
    return field


def fit(docs: DataFrame, labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS) -> Field | None:
    """Fit in one task on a bounded sample of labelled rows; None without any."""
    def run(batches):
        rows = []
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                low = LOWER[buf]
                s, e, first = positions(low, offsets)
                rows += [(low[offsets[i] : offsets[i + 1]].copy(), s[first[i] : first[i + 1]] - offsets[i], e[first[i] : first[i + 1]] - offsets[i], lang[lo + i]) for i in range(hi - lo)]
        if any(len(s) for _, s, _, _ in rows):
            field = train(rows, buckets)
            data = pickle.dumps((field.langs, field.buckets, field.lexicon, field.emit.astype(np.float32), field.move, field.start))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["model"])

    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(FOLDS) != HELD_OUT))
    chosen = usable.select(F.xxhash64("doc_id", "text").alias("at"), F.col("doc_id").cast("long").alias("id"), "lang")
    chosen = chosen.orderBy("at", "id", "lang").limit(labelled_rows).select("at").distinct()
    drawn = usable.select(F.xxhash64("doc_id", "text").alias("at"), "text", "lang").join(F.broadcast(chosen), "at")
    found = drawn.repartition(1).sortWithinPartitions("at", "lang").select("text", "lang").mapInArrow(run, "model binary").collect()
    if not found:
        return None
    langs, buckets, lexicon, emit, move, start = pickle.loads(found[0]["model"])
    field = Field(langs, buckets, lexicon)
    field.emit, field.move, field.start = emit.astype(np.float64), move, start
    return field


class Labeller:
    """Marginals of the words of many texts at once."""

    def __init__(self, field: Field):
        self.field, n = field, len(field.langs)
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1024, n))
        self.move, self.start = np.exp(field.move - field.move.max()), np.exp(field.start - field.start.max())

    def learn(self, hashes: list[int], words_: list[str]) -> None:
        """Keep the emissions of new words."""
        at = iter(hashes)
        for some in portions(words_):
            k = len(self.known)
            while k + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            e = self.field.emissions(some)
            self.rows[k : k + len(some)] = np.exp(np.maximum(e - e.max(1, keepdims=True), -50))
            self.known.update((h, j) for j, h in zip(range(k, k + len(some)), at))

    def emissions(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        distinct, first, inverse = np.unique(Hashes(low).span(s, e), return_index=True, return_inverse=True)
        known, distinct = self.known, distinct.tolist()
        new = [(h, i) for h, i in zip(distinct, first.tolist()) if h not in known]
        self.learn([h for h, _ in new], [decoded(low, s[i], e[i]) for _, i in new])
        return self.rows[np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[inverse]]

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over each text's words; ``first`` has where each text's words begin."""
        total, n = e.shape
        if not total:
            return e
        sizes = np.diff(first)
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), chunks)
        ordinal = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = first[text] + ordinal * CHUNK
        at = begin[:, None] + np.arange(CHUNK)
        real = at < first[text + 1][:, None]
        padded = e[np.minimum(at, total - 1)]
        opening = ordinal == 0
        # Transfer matrix of each chunk; the first one of a text starts from the start scores whatever comes in.
        transfer = np.where(opening[:, None, None], self.start * padded[:, 0][:, None, :], self.move[None] * padded[:, 0][:, None, :])
        for k in range(1, CHUNK):
            step = (transfer @ self.move) * padded[:, k][:, None, :]
            transfer = np.where(real[:, k][:, None, None], step, transfer)
            transfer /= transfer.max((1, 2), keepdims=True)
        into, after = np.full((len(text), n), 1 / n), np.full((len(text), n), 1 / n)
        head = np.cumsum(chunks) - chunks
        longest = int(chunks.max())
        for k in range(1, longest):
            c = head[chunks > k] + k
            v = (into[c - 1][:, None, :] @ transfer[c - 1])[:, 0]
            into[c] = v / v.sum(1, keepdims=True)
        tail = head + chunks - 1
        for k in range(1, longest):
            c = tail[chunks > k] - k
            v = (transfer[c + 1] @ after[c + 1][:, :, None])[:, :, 0]
            after[c] = v / v.sum(1, keepdims=True)
        alpha, here = np.empty_like(padded), into
        for k in range(CHUNK):
            step = here @ self.move
            if k == 0:
                step = np.where(opening[:, None], self.start, step)
            step = step * padded[:, k]
            here = np.where(real[:, k][:, None], step / step.sum(1, keepdims=True), here)
            alpha[:, k] = here
        beta, here = np.empty_like(padded), after
        for k in range(CHUNK - 1, -1, -1):
            beta[:, k] = here
            step = (here * padded[:, k]) @ self.move.T
            here = np.where(real[:, k][:, None], step / step.sum(1, keepdims=True), here)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        return p[real]


def _labeller(field: Field) -> Labeller:
    name = f"labeller_{zlib.crc32(field.emit.tobytes() + field.move.tobytes())}"
    return kept_in_process(name, lambda: Labeller(field))


def lettered(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predicted(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    def run(batches):
        worker = _labeller(field) if field else None
        for batch in batches:
            lang, score = [], []
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                low = LOWER[buf]
                s, e, first = positions(low, offsets)
                sizes = np.diff(first)
                plain = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
                plain = plain[offsets[1:]] > plain[offsets[:-1]]
                if worker is None:
                    lang += [NONE] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                p = worker.marginals(worker.emissions(low, s, e), first)
                owner = np.repeat(np.arange(hi - lo), sizes)
                mean = np.stack([np.bincount(owner, p[:, k], hi - lo) for k in range(p.shape[1])], 1) / np.maximum(sizes, 1)[:, None]
                best = mean.argmax(1)
                for i in range(hi - lo):
                    known = sizes[i] > 0 and (plain[i] or lettered(bytes(buf[offsets[i] : offsets[i + 1]])))
                    lang.append(field.langs[best[i]] if known else NONE)
                    score.append(min(1.0, float(mean[i, best[i]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(FOLDS) == HELD_OUT).alias("held_out"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def labelled_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and the stretches of its words with one label: first byte, last byte + 1, lang, mean marginal."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches):
        worker = _labeller(field)
        for batch in batches:
            out = []
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                low = LOWER[buf]
                s, e, first = positions(low, offsets)
                p = worker.marginals(worker.emissions(low, s, e), first)
                best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    cuts = np.concatenate(([a], a + 1 + np.flatnonzero(np.diff(best[a:b])), [b])) if b > a else []
                    out.append([{"start": int(s[x] - offsets[i]), "end": int(e[y - 1] - offsets[i]), "lang": field.langs[best[x]], "score": float(p[x:y, best[x]].mean())} for x, y in zip(cuts[:-1], cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "stretches"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, stretches array<struct<start: long, end: long, lang: string, score: double>>")


def op9_crf_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bounded_batches(spark)
    return predicted(docs, fit(docs))


QUERIES = {"op9_crf_language": op9_crf_language}
SQL = {}
