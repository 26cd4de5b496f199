"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score is a sum of learned weights of
its own binned features and of its two neighbours'; further weights rate the
change from one line's label to the next.  Forward-backward gives each
line's marginal probability of being good, and the document's quality is
their mean, weighted by line length.

Training maximises the conditional likelihood of a bounded sample of
labelled documents (``PER_CLASS`` of each class, texts up to ``MAX_BYTES``),
whose lines all carry their document's label.  Labels are learned only from
rows whose crc32(doc_id) mod 3 is not 1; labels, lang, source and doc_id are
never inputs of a score.  The model is a fixed few KB and is broadcast.

Defined results: NULL and empty texts are scored as one empty line; blank
lines are left out; a document without any label class in the sample gets
the share of good labels.  A text of many MB is read in pieces of about
``PIECE_CHARS`` (a longer line is one piece), and its chain is passed in
blocks of ``CHAIN`` lines; some 150 bytes a line are held for a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, joined_bytes, mix64, packed, slices, spans, training_sample, word_hashes

PER_CLASS = 1500
MAX_BYTES = 200_000
THRESHOLD = 0.5
EPOCHS = 120
RATE = 0.1
L2 = 1e-3
BATCH_CHARS = 1 << 20
PIECE_CHARS = 1 << 20
CHAIN = 512  # lines of a block; longer chains are passed block by block
VIEW_LINES = 1 << 16

# Bin edges of each line feature; bin 0 of a neighbour means there is none.
BINS = {
    "length": [20, 60, 150, 400, 1500, 6000],
    "upper": [0.02, 0.08, 0.3, 0.7],
    "digit": [0.005, 0.03, 0.1, 0.3],
    "symbol": [0.002, 0.01, 0.03, 0.08, 0.2],
    "mark": [0.01, 0.03, 0.06, 0.12, 0.25],
    "word_length": [2.5, 3.5, 4.5, 6.0, 9.0],
    "distinct_words": [0.1, 0.3, 0.5, 0.7, 0.9],
    "repeated_next": [0.005, 0.05, 0.2, 0.5],
    "distinct_pairs": [0.2, 0.5, 0.8, 0.95],
    "repeated_line": [0.5],
    "symbol_words": [0.02, 0.1, 0.3, 0.6],
}
N_BINS = 1 + max(len(e) + 1 for e in BINS.values())


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper, 2 lower or non-ASCII, 3 digit, 4 space, 5 mark, 6 symbol."""
    c = np.zeros(256, dtype=np.uint8)
    c[ord("A"):ord("Z") + 1] = 1
    c[ord("a"):ord("z") + 1] = 2
    c[0x80:] = 2
    c[ord("0"):ord("9") + 1] = 3
    c[[9, 11, 12, 13, 32]] = 4
    for s, k in ((b".,;:!?'\"()-", 5), (b"#$%&*+/<=>@[\\]^_`{|}~", 6)):
        c[list(s)] = k
    return c


_CLASS = _classes()


def _distinct(group: np.ndarray, h: np.ndarray, n_groups: int) -> np.ndarray:
    """Number of distinct hashes in each group."""
    key = np.sort((group.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_groups)


def line_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, document, length) of the non-blank lines; a text without any has one empty line.

    A text above ``PIECE_CHARS`` is read in pieces cut after lines, so what is held for each byte and word
    follows a piece (or a longer line); each line's bins, length and hash are held for the whole text.
    """
    owner, pieces = [], []
    for i, t in enumerate(texts):
        parts = line_pieces(t, PIECE_CHARS)
        owner += [i] * len(parts)
        pieces += parts
    read = [_line_features(pieces[i:j], np.array(owner[i:j])) for i, j in slices(pieces, PIECE_CHARS)]
    bins, doc, length, total = (np.concatenate(x) for x in zip(*read))
    # blank pieces of a text that has lines elsewhere count for nothing
    lines = np.bincount(doc, length > 0, minlength=len(texts))
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    keep = (length > 0) | ((lines[doc] == 0) & first)
    bins, doc, length, total = bins[keep], doc[keep], length[keep], total[keep]
    by_doc = np.lexsort((total, doc))
    same = (total[by_doc][1:] == total[by_doc][:-1]) & (doc[by_doc][1:] == doc[by_doc][:-1])
    repeat = np.zeros(len(doc), dtype=bool)
    repeat[by_doc[1:][same]] = True
    repeat[by_doc[:-1][same]] = True
    at = list(BINS).index("repeated_line")
    bins[:, at] = 1 + np.searchsorted(BINS["repeated_line"], repeat.astype(float), side="right")
    return bins, doc, np.maximum(length, 1)


def line_pieces(text: str, most: int) -> list[str]:
    """``text`` cut after line ends into pieces of at most ``most`` characters, or of one line."""
    out, i = [], 0
    while len(text) - i > most:
        cut = text.rfind("\n", i, i + most) + 1
        if not cut:
            cut = text.find("\n", i) + 1
            if not cut:
                break
        out.append(text[i:cut])
        i = cut
    return out + [text[i:]] if out else [text]


def _line_features(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, document, length, hash) of the lines of ``texts``, all bins but the one of repeated lines."""
    data, ends = joined_bytes(texts)
    kind = _CLASS[data]
    newline = data == 10
    start, end = spans(~newline)
    # each line's document; texts without a line get an empty one
    doc = np.searchsorted(ends, start, side="right")
    bare = np.setdiff1d(np.arange(len(texts)), doc)
    if len(bare):
        at = ends[bare] - 1
        start, end = np.concatenate([start, at]), np.concatenate([end, at])
        doc = np.concatenate([doc, bare])
        order = np.lexsort((start, doc))
        start, end, doc = start[order], end[order], doc[order]
    n = len(start)
    length = end - start

    def per_line(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[end] - c[start]

    counts = {k: per_line(kind == k) for k in (1, 2, 3, 5, 6)}
    w_start, w_end = spans((kind != 4) & ~newline)
    w_line = np.searchsorted(start, w_start, side="right") - 1
    h = word_hashes(data, w_start, w_end)
    words = np.bincount(w_line, minlength=n)
    sym = np.concatenate(([0], np.cumsum(kind == 6, dtype=np.int64)))
    sym_words = np.bincount(w_line[sym[w_end] > sym[w_start]], minlength=n)
    same_line = w_line[1:] == w_line[:-1]
    twice = np.bincount(w_line[1:][same_line & (h[1:] == h[:-1])], minlength=n)
    pair = mix64(h[1:] * np.uint64(3) + h[:-1])[same_line]
    # a line's hash is the sum of its words', each mixed with its place
    place = np.arange(len(h)) - (np.cumsum(words) - words)[w_line] if len(h) else np.empty(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, w_line, mix64(h + place.astype(np.uint64)))

    one = np.maximum(length, 1)
    values = {
        "length": length, "upper": counts[1] / np.maximum(counts[1] + counts[2], 1), "digit": counts[3] / one,
        "symbol": counts[6] / one, "mark": counts[5] / one, "word_length": length / np.maximum(words, 1),
        "distinct_words": _distinct(w_line, h, n) / np.maximum(words, 1),
        "repeated_next": twice / np.maximum(words - 1, 1),
        "distinct_pairs": _distinct(w_line[1:][same_line], pair, n) / np.maximum(words - 1, 1),
        "repeated_line": np.zeros(n), "symbol_words": sym_words / np.maximum(words, 1),
    }
    bins = np.stack([1 + np.searchsorted(BINS[f], values[f], side="right") for f in BINS], axis=1)
    return bins.astype(np.int8), owner[doc], length, total


class LineCrf:
    """Weights of the field and its forward-backward pass."""

    def __init__(self):
        self.w = np.zeros((3, len(BINS), N_BINS))  # own, previous and next line's bins
        self.change = np.zeros((2, 2))             # from label to label
        self.begin = np.zeros(2)
        self.prior = 0.0

    def views(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Flat indexes into ``w`` of each line's features, its neighbours' included."""
        before, after = np.zeros_like(bins), np.zeros_like(bins)
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:] = np.where(joined, bins[:-1], 0)
        after[:-1] = np.where(joined, bins[1:], 0)
        f = np.arange(len(BINS), dtype=np.int16) * N_BINS
        return np.concatenate([f + bins, len(BINS) * N_BINS + f + before, 2 * len(BINS) * N_BINS + f + after], axis=1)

    def line_scores(self, bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Each line's sum of weights, some lines at a time (with one more on both sides)."""
        out = np.empty(len(doc))
        for i in range(0, len(doc), VIEW_LINES):
            j = min(i + VIEW_LINES, len(doc))
            lo, hi = max(i - 1, 0), min(j + 1, len(doc))
            out[i:j] = self.w.ravel()[self.views(bins[lo:hi], doc[lo:hi])[i - lo:j - lo]].sum(axis=1)
        return out

    def marginals(self, view: np.ndarray, doc: np.ndarray, n_docs: int):
        """(P(good) of each line, expected label changes from each line to the next, as 2 x 2)."""
        return self.chain_marginals(self.w.ravel()[view].sum(axis=1), doc, n_docs)

    def chain_marginals(self, score: np.ndarray, doc: np.ndarray, n_docs: int):
        """The same from the lines' scores."""
        emit = np.exp(np.clip(np.stack([-score / 2, score / 2], axis=1), -30, 30))
        move = np.exp(self.change)
        first = np.searchsorted(doc, np.arange(n_docs))
        n = np.bincount(doc, minlength=n_docs)
        passed = self._by_line if n.max(initial=0) <= CHAIN else self._by_block
        ahead, back = passed(emit, move, first, n)
        p = ahead * back
        p /= p.sum(axis=1, keepdims=True)
        pair = np.zeros((2, 2))
        i = np.flatnonzero(doc[1:] == doc[:-1])
        if len(i):
            joint = ahead[i][:, :, None] * move[None] * (emit[i + 1] * back[i + 1])[:, None, :]
            pair = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return p[:, 1], pair

    def _by_line(self, emit, move, first, n):
        """Forward and backward messages, line by line in all documents at once."""
        order = np.argsort(-n, kind="stable")
        first, n = first[order], n[order]
        ahead = np.empty_like(emit)
        back = np.empty_like(emit)
        steps = int(n.max(initial=0))
        alive = np.searchsorted(-n, -np.arange(steps), side="left")  # documents longer than each step
        a = np.exp(self.begin) * emit[first]
        for t in range(steps):
            k = alive[t]
            at = first[:k] + t
            if t:
                a = (a[:k] @ move) * emit[at]
            a = a / a.sum(axis=1, keepdims=True)
            ahead[at] = a
        b = np.empty((0, 2))
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            at = first[:k] + t
            more = len(b)
            now = np.ones((k, 2))
            if more:
                now[:more] = (b * emit[at[:more] + 1]) @ move.T
                now[:more] /= now[:more].sum(axis=1, keepdims=True)
            back[at] = now
            b = now
        return ahead, back

    def _by_block(self, emit, move, first, n):
        """The same messages for long chains: 2 x 2 products inside blocks of ``CHAIN`` lines, all blocks at
        once, then from block to block of each document.  lines / CHAIN + CHAIN steps instead of lines."""
        blocks = -(-n // CHAIN)
        doc = np.repeat(np.arange(len(n)), blocks)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[doc] + number * CHAIN
        size = np.minimum(CHAIN, n[doc] - number * CHAIN)
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(CHAIN), side="left")
        begins = number == 0
        fore = np.empty((len(emit), 2, 2))  # from the message before a block to each of its lines
        aft = np.empty((len(emit), 2, 2))   # from a block's last line to each of its lines
        p = np.where(begins[order][:, None, None], np.eye(2), move)
        for t in range(CHAIN):
            k = alive[t]
            at = start[order[:k]] + t
            p = (p[:k] @ move if t else p[:k]) * emit[at][:, None, :]
            p = p / p.sum(axis=(1, 2), keepdims=True)
            fore[at] = p
        q = np.empty((0, 2, 2))
        for t in range(CHAIN - 1, -1, -1):
            k = alive[t]
            at = start[order[:k]] + t
            now = np.broadcast_to(np.eye(2), (k, 2, 2)).copy()
            more = len(q)
            if more:
                now[:more] = move @ (emit[at[:more] + 1][:, :, None] * q)
                now[:more] /= now[:more].sum(axis=(1, 2), keepdims=True)
            aft[at] = now
            q = now
        into, out = np.empty((len(doc), 2)), np.empty((len(doc), 2))
        offset, steps = np.cumsum(blocks) - blocks, int(blocks.max(initial=0))
        state = np.tile(np.exp(self.begin), (len(n), 1))
        for k in range(steps):
            d = np.flatnonzero(blocks > k)
            b = offset[d] + k
            into[b] = state[d]
            state[d] = np.einsum("bi,bij->bj", into[b], fore[start[b] + size[b] - 1])
            state[d] /= state[d].sum(axis=1, keepdims=True)
        state = np.ones((len(n), 2))
        for k in range(steps - 1, -1, -1):
            d = np.flatnonzero(blocks > k)
            b = offset[d] + k
            out[b] = state[d]
            state[d] = (emit[start[b]] * np.einsum("bij,bj->bi", aft[start[b]], out[b])) @ move.T
            state[d] /= state[d].sum(axis=1, keepdims=True)
        block = np.repeat(np.arange(len(doc)), size)
        ahead = np.einsum("li,lij->lj", into[block], fore)
        back = np.einsum("lij,lj->li", aft, out[block])
        return ahead / ahead.sum(axis=1, keepdims=True), back / back.sum(axis=1, keepdims=True)

    def fit(self, rows: list[tuple[str, int]]) -> "LineCrf":
        """Adam on the conditional log-likelihood of whole label chains."""
        good = np.array([y for _, y in rows], dtype=float)
        share = float(np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99))
        self.prior = float(np.log(share / (1 - share)))
        if len(set(good)) < 2:
            self.w[0, 0, :] = self.prior
            return self
        parts = []
        for i, j in slices([t for t, _ in rows], BATCH_CHARS):
            b, d, _ = line_bins([t for t, _ in rows[i:j]])
            parts.append((b, d + i))
        bins, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        view, n_docs = self.views(bins, doc), len(rows)
        y = good[doc]
        same = doc[1:] == doc[:-1]
        seen = np.array([[np.sum(same & (y[:-1] == a) & (y[1:] == b)) for b in (0, 1)] for a in (0, 1)], dtype=float)
        starts = np.searchsorted(doc, np.arange(n_docs))
        sizes = (self.w.size, 4, 2)
        m, v = np.zeros(sum(sizes)), np.zeros(sum(sizes))
        for step in range(1, EPOCHS + 1):
            p, pair = self.marginals(view, doc, n_docs)
            gap = y - p
            gw = np.bincount(view.ravel(), np.repeat(gap, view.shape[1]), minlength=self.w.size)
            gb = np.array([np.sum(-gap[starts]), np.sum(gap[starts])])
            g = np.concatenate([gw, (seen - pair).ravel(), gb]) / n_docs
            flat = np.concatenate([self.w.ravel(), self.change.ravel(), self.begin])
            g -= L2 * flat
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            flat = flat + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            self.w = flat[:sizes[0]].reshape(self.w.shape)
            self.change = flat[sizes[0]:sizes[0] + 4].reshape(2, 2)
            self.begin = flat[-2:]
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text's lines."""
        out = np.empty(len(texts))
        for i, j in slices(texts, BATCH_CHARS):
            bins, doc, length = line_bins(texts[i:j])
            p, _ = self.chain_marginals(self.line_scores(bins, doc), doc, j - i)
            out[i:j] = np.bincount(doc, p * length, minlength=j - i) / np.bincount(doc, length, minlength=j - i)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame) -> LineCrf:
    return LineCrf().fit(training_sample(docs, labels, "quality", PER_CLASS, MAX_BYTES, "quality"))


def scorer(spark: SparkSession, model):
    """``model.score`` as a column function over Arrow batches."""
    bc = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(bc.value.score([t if isinstance(t, str) else "" for t in s]))

    return score


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    score = scorer(spark, train(docs, labels))
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    score = scorer(spark, train(docs, labels))
    return packed(docs, score(docs["text"]).alias("_s")).filter(F.col("_s") >= THRESHOLD).select("_row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"),
                  spark.read.parquet(f"{sf_dir}/labels.parquet"))
