"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed table rows: one for the word and one
for each of its beginnings (``PREFIXES``), so that inflected and compound
forms share what was learned.  Filters of several widths run over neighbouring
words, each keeps its largest response in the whole text (max pooling), and a
logistic layer reads the pooled responses.

Training draws a bounded sample of labelled documents (``PER_CLASS`` of each
class, texts up to ``MAX_BYTES``) and runs mini-batch Adam on the driver; pieces
met in fewer than ``MIN_DOCS`` of them add nothing.  A fifth of
the sample is set aside: on it each language gets a threshold, and the score
is shifted so that every language's threshold lies at ``THRESHOLD``.  The
language is read off the text itself, by its function words.  Labels are
learned only from rows whose crc32(doc_id) mod 3 is not 1; labels, lang,
source and doc_id are never inputs of a score.

The model (a few MB, fixed) is broadcast.

A text longer than ``BATCH_CHARS`` is scored in pieces cut between words: the
filters' largest responses and the function words met are carried from piece
to piece, and the last two words go with the next one, so memory follows the
piece.  (A single word longer than that is one piece.)

Defined results: NULL and empty texts are scored as one blank word; a sample
without both classes gives every text the share of label 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, joined_bytes, packed, slices, spans, training_sample, word_hashes
from .quality import scorer

PER_CLASS = 1200
MAX_BYTES = 100_000
THRESHOLD = 0.7
BUCKETS = 1 << 16  # bucket 0 is the blank piece
PREFIXES = (4, 5, 6)  # bytes of a word's beginnings
PIECES = 1 + len(PREFIXES)
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
STEPS = 320
BATCH = 32
RATE = 0.01
EMBED_RATE = 0.05
MIN_DOCS = 5
DROP = 0.3  # share of pieces left out of a training step
BATCH_CHARS = 1 << 20

# FIXED VALUES: frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to is that it was for on are as with by this from at or",
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine für",
    "fr": "le les des et est dans du pour que qui une sur au par plus pas avec ce",
    "es": "el los del las con para una por su al como lo más pero sus esta entre se",
}
LANGUAGES = ("other", *FUNCTION_WORDS)


def _word_class() -> np.ndarray:
    c = np.zeros(256, dtype=bool)
    c[ord("a"):ord("z") + 1] = True
    c[ord("0"):ord("9") + 1] = True
    c[0x80:] = True
    return c


_WORD = _word_class()


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of its pieces, text number) of every word: runs of letters and digits, lower case."""
    data, ends = joined_bytes([t.lower() for t in texts])
    start, end = spans(_WORD[data])
    h = [word_hashes(data, start, end)]
    for k in PREFIXES:  # the multiplier tells a beginning from a whole word
        h.append(word_hashes(data, start, np.minimum(end, start + k)) * np.uint64(2 * k + 1))
    return np.stack(h, axis=1), np.searchsorted(ends, start, side="right")


_FUNCTION = [text_words([w])[0][:, 0] for w in FUNCTION_WORDS.values()]


def function_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Function words of each language in each text: LANGUAGES x texts."""
    return np.stack([np.zeros(n)] + [np.bincount(doc[np.isin(h[:, 0], f)], minlength=n) for f in _FUNCTION])


def languages(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number in LANGUAGES of each text: most function words; 0 where there is none."""
    return np.argmax(function_words(h, doc, n), axis=0)


_GAP = re.compile("[\x00-/:-`{-\x7f]")  # what is no part of a lower-case word


def word_pieces(text: str, most: int) -> Iterator[str]:
    """The text in lower case, in pieces of about ``most`` characters cut between words."""
    text, at = text.lower(), 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


class TextCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = (r.normal(size=(BUCKETS, DIM)) * 0.02).astype(np.float32)
        self.embed[0] = 0
        self.filters = [(r.normal(size=(k * DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = (r.normal(size=FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)
        self.known = np.zeros(BUCKETS, dtype=bool)
        self.shift = np.zeros(len(LANGUAGES))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (1 + h % np.uint64(BUCKETS - 1)).astype(np.int64)

    # --- training: one document at a time, gradients at the pooled places only

    def _words(self, pieces: np.ndarray) -> np.ndarray:
        """Word vectors, two blank words after the last."""
        v = np.zeros((len(pieces) + 2, DIM), dtype=np.float32)
        for c in range(PIECES):
            v[:-2] += self.embed[pieces[:, c]]
        return v

    def _forward(self, pieces: np.ndarray):
        v, n = self._words(pieces), len(pieces)
        pooled, where = [], []
        for k, f in zip(WIDTHS, self.filters):
            r = sum(v[j:j + n] @ f[j * DIM:(j + 1) * DIM] for j in range(k))
            top = r.argmax(axis=0)
            pooled.append(r[top, np.arange(FILTERS)])
            where.append(top)
        z = np.concatenate(pooled) + self.bias
        return np.maximum(z, 0), where, v

    def fit(self, rows: list[tuple[str, int]]) -> "TextCnn":
        y = np.array([v for _, v in rows], dtype=np.float32)
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        ids, langs = [], np.zeros(len(rows), dtype=np.int64)
        for i, j in slices([t for t, _ in rows], BATCH_CHARS):
            h, doc = text_words([t for t, _ in rows[i:j]])
            langs[i:j] = languages(h, doc, j - i)
            cut = np.searchsorted(doc, np.arange(1, j - i))
            ids += [b if len(b) else np.zeros((1, PIECES), np.int64) for b in np.split(self.bucket(h), cut)]
        if len(set(y.tolist())) < 2:
            self.out[:], self.out_bias = 0, np.float32(np.log(share / (1 - share)))
            return self
        n_docs = np.zeros(BUCKETS, dtype=np.int64)
        for b in ids:
            n_docs[np.unique(b)] += 1
        self.known = n_docs >= MIN_DOCS
        self.known[0] = False
        ids = [np.where(self.known[b], b, 0) for b in ids]
        aside = np.arange(len(rows)) % 5 == 0
        learn = np.flatnonzero(~aside)
        r = np.random.default_rng(11)
        weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-3), 0.5 / max(1 - y[learn].mean(), 1e-3))
        state: dict = {}
        step = 0
        for _ in range(-(-STEPS * BATCH // len(learn))):
            order = r.permutation(learn)
            for at in range(0, len(order), BATCH):
                step += 1
                part = [(np.where(r.random(ids[i].shape) < DROP, 0, ids[i]), y[i], weight[i])
                        for i in order[at:at + BATCH]]
                self._step(part, state, step)
        self.embed[~self.known] = 0
        raw = np.array([self._raw_of(b) for b in ids])
        self._calibrate(raw[aside], y[aside] == 1, langs[aside])
        return self

    def _raw_of(self, ids: np.ndarray) -> float:
        return float(self._forward(ids)[0] @ self.out + self.out_bias)

    def _step(self, batch, state: dict, step: int) -> None:
        g_f = [np.zeros_like(f) for f in self.filters]
        g_bias, g_out, g_b = np.zeros_like(self.bias), np.zeros_like(self.out), np.float32(0)
        rows, grads = [], []
        for ids, y, weight in batch:
            a, where, v = self._forward(ids)
            p = 1 / (1 + np.exp(-np.clip(a @ self.out + self.out_bias, -30, 30)))
            e = np.float32((p - y) * weight / len(batch))
            g_out += e * a
            g_b += e
            back = e * self.out * (a > 0)
            g_bias += back
            blank = np.vstack([ids, np.zeros((2, PIECES), dtype=ids.dtype)])
            for n, (k, top) in enumerate(zip(WIDTHS, where)):
                d = back[n * FILTERS:(n + 1) * FILTERS]
                at = top[:, None] + np.arange(k)               # filters x k word places
                g_f[n] += (v[at].reshape(FILTERS, k * DIM) * d[:, None]).T
                g = (self.filters[n].T * d[:, None]).reshape(FILTERS * k, DIM)
                rows.append(blank[at.ravel()].ravel())
                grads.append(np.repeat(g, PIECES, axis=0))
        self._adam("out", self.out, g_out + 1e-4 * self.out, state, step)
        self._adam("bias", self.bias, g_bias, state, step)
        for n, g in enumerate(g_f):
            self._adam(f"f{n}", self.filters[n], g + 1e-4 * self.filters[n], state, step)
        b = np.array([self.out_bias])
        self._adam("b", b, np.array([g_b]), state, step)
        self.out_bias = b[0]
        # embeddings: only the pieces of words that won some filter
        words, back = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(words), DIM), dtype=np.float32)
        np.add.at(g, back, np.concatenate(grads))
        sq = state.setdefault("embed", np.full((BUCKETS, DIM), 1e-4, dtype=np.float32))
        sq[words] += g * g
        self.embed[words] -= EMBED_RATE * g / (np.sqrt(sq[words]) + 1e-6)
        self.embed[0] = 0

    def _adam(self, name, x, g, state, step) -> None:
        m, v = state.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)

    def _calibrate(self, raw: np.ndarray, toxic: np.ndarray, lang: np.ndarray) -> None:
        """Each language's threshold: the middle of the best-F1 gap on the documents set
        aside; a language with few of either class there shares the pooled one."""
        at = float(np.log(THRESHOLD / (1 - THRESHOLD)))

        def best(r, t):
            order = np.argsort(-r, kind="stable")
            r, t = r[order], t[order]
            hits = np.cumsum(t)
            f1 = 2 * hits / (np.arange(len(t)) + 1 + t.sum())
            k = int(f1.argmax())
            return (r[k] + (r[k + 1] if k + 1 < len(r) else r[k] - 1)) / 2

        pooled = best(raw, toxic) if toxic.any() else at
        self.shift[:] = at - pooled
        for k in range(len(LANGUAGES)):
            own = lang == k
            if toxic[own].sum() >= 20 and (~toxic[own]).sum() >= 20:
                self.shift[k] = at - best(raw[own], toxic[own])

    # --- scoring ------------------------------------------------------------

    def _pool(self, pieces: np.ndarray, first: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Largest response of each filter in each text; two blank words follow each text in ``pieces``."""
        n, out = len(pieces), np.full((len(first), len(self.bias)), -np.inf, dtype=np.float32)
        after = np.concatenate((first[1:], [n]))
        owner = np.repeat(np.arange(len(first)), after - first)
        real = np.arange(n) < (after - 2)[owner]
        for i in range(0, n, block):
            j = min(n, i + block)
            v = self._words(pieces[i:min(n, j + 2)])
            resp = np.concatenate([sum(v[s:s + j - i] @ f[s * DIM:(s + 1) * DIM] for s in range(k))
                                   for k, f in zip(WIDTHS, self.filters)], axis=1)
            at = np.flatnonzero(real[i:j])
            if not len(at):
                continue
            who = owner[i + at]
            edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            np.maximum.at(out, who[edge], np.maximum.reduceat(resp[at], edge, axis=0))
        return out

    def _score_long(self, text: str) -> float:
        pooled = np.full((1, len(self.bias)), -np.inf, dtype=np.float32)
        hits = np.zeros((len(LANGUAGES), 1))
        carried = np.zeros((0, PIECES), dtype=np.int64)
        for piece in word_pieces(text, BATCH_CHARS):
            h, doc = text_words([piece])
            hits += function_words(h, doc, 1)
            rows = np.concatenate([carried, self.bucket(h)])
            # the last two rows only follow others here and lead in the next piece
            pooled = np.maximum(pooled, self._pool(rows, np.zeros(1, np.int64)))
            carried = rows[-2:]
        blank = np.zeros((2 if len(carried) else 3, PIECES), dtype=np.int64)
        pooled = np.maximum(pooled, self._pool(np.concatenate([carried, blank]), np.zeros(1, np.int64)))
        raw = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias + self.shift[np.argmax(hits, axis=0)]
        return float(1 / (1 + np.exp(-np.clip(raw[0], -30, 30))))

    def score(self, texts: list[str]) -> np.ndarray:
        result = np.empty(len(texts))
        for i, j in slices(texts, BATCH_CHARS):
            if j == i + 1 and len(texts[i]) > BATCH_CHARS:
                result[i] = self._score_long(texts[i])
                continue
            h, doc = text_words(texts[i:j])
            n = j - i
            count = np.bincount(doc, minlength=n)
            room = np.maximum(count, 1) + 2  # a text without words is one blank word
            first = np.cumsum(room) - room
            pieces = np.zeros((int(room.sum()), PIECES), dtype=np.int64)
            pieces[first[doc] + np.arange(len(h)) - (np.cumsum(count) - count)[doc]] = self.bucket(h)
            a = np.maximum(self._pool(pieces, first) + self.bias, 0)
            raw = a @ self.out + self.out_bias + self.shift[languages(h, doc, n)]
            result[i:j] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return result


def train(docs: DataFrame, labels: DataFrame) -> TextCnn:
    return TextCnn().fit(training_sample(docs, labels, "toxic", PER_CLASS, MAX_BYTES, "toxic"))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    score = scorer(spark, train(docs, labels))
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the toxicity threshold, with all their columns."""
    score = scorer(spark, train(docs, labels))
    return packed(docs, score(docs["text"]).alias("_s")).filter(F.col("_s") < THRESHOLD).select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"),
                  spark.read.parquet(f"{sf_dir}/labels.parquet"))
