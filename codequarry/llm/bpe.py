"""BPE encoding and decoding by speculation and verification.

For a word-level BPE vocabulary file (word ends marked, lower case, white
space dropped).  Every batch is cut into words; the words not seen before
are encoded together:

1. *Speculate*: a walk down a token trie takes the longest token at each
   place, all words at once.
2. *Verify*: a token sequence is the BPE encoding exactly when no merge ever
   crosses the border of two neighbours.  While x and y are built up, the
   symbols at their border are x's rightmost and y's leftmost parts; a merge
   of two such parts crosses the border if its rank comes before the merges
   that consume them.  All distinct neighbouring pairs are tested at once.
3. *Repair*: only words with a failing pair are merged step by step, again
   many words at once (long ones singly, with a heap).

The proof in 2 needs that each part of a token ranks before the token and
that the token's own text encodes to it; tokens for which the file breaks
this are found when it is loaded, and words that use them go to step 3.

Defined results: a NULL text counts as empty, and empty texts have no ids.
Texts are processed whole; a very long one in segments that end at white
space, which no word crosses.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import known_chars

LONG_WORD = 512                   # bytes above which a word is walked and merged alone
NO = np.int64(1) << np.int64(40)  # above every rank
WORDS_KEPT = 200_000              # words a worker remembers
SEGMENT = 1 << 20                 # characters of a very long text handled at once
BATCH_CHARS = 1 << 20

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{_SPACE}]")
# FIXED VALUES: the word pattern of the vocabulary file, for ASCII and for all texts.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")


@lru_cache(maxsize=1)
def _library_split():
    from tokenizers import Regex, normalizers, pre_tokenizers
    return normalizers.Lowercase(), pre_tokenizers.Split(Regex(
        r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)


def _library_words(text: str) -> list[str]:
    """Words of a text with characters newer than Python's tables, by the tables of the file's library."""
    lower, split = _library_split()
    return [w for w, _ in split.pre_tokenize_str(lower.normalize_str(text))]


class IntTable:
    """Exact open-addressing map from non-negative int64 keys to ints, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, -1, dtype=np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            self.keys[s[free]] = keys[todo[free]]
            mine = self.keys[s] == keys[todo]
            self.values[s[mine]] = values[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is absent."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        todo = np.flatnonzero((at != keys) & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the rest are numbered from U+0100."""
    plain = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 0x100 + n))
        n += b not in plain
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([vocab[c + self.end] for c in alphabet], dtype=np.int64)
        # merges: pair -> rank, and rank -> token; each token's parts and rank
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        first = np.unique(left << 20 | right, return_index=True)[1]  # a repeated pair keeps one rank
        self.rank = IntTable((left << 20 | right)[first], np.arange(len(merges))[first])
        self.made_of = self.made.tolist()
        self.own = np.full(n, -1, dtype=np.int64)
        self.own[self.made] = np.arange(len(merges))
        self.odd = np.zeros(n, dtype=bool)
        self.odd[[i for i, k in zip(*np.unique(self.made, return_counts=True)) if k > 1]] = True
        late = (self.own[left] >= np.arange(len(merges))) | (self.own[right] >= np.arange(len(merges)))
        self.odd[self.made[late]] = True
        self._spines(left, right)
        self._trie(vocab, {c: b for b, c in enumerate(alphabet)})
        self._check_tokens(vocab, {c: b for b, c in enumerate(alphabet)})
        self.slot: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.used = 0
        self.starts = self.counts = np.empty(0, dtype=np.int64)

    def _spines(self, left, right) -> None:
        """Parts at a token's right and left border, with the rank that consumes each."""
        n = len(self.own)
        parts = {"right": np.full(n, -1, np.int64), "left": np.full(n, -1, np.int64)}
        parts["right"][self.made], parts["left"][self.made] = right, left
        for side, child in parts.items():
            node, until = [np.arange(n)], [np.full(n, NO)]
            while True:
                nxt = np.where(node[-1] >= 0, child[node[-1]], -1)
                if (nxt < 0).all() or len(node) > 64:
                    break
                until.append(np.where(nxt >= 0, self.own[node[-1]], -1))
                node.append(nxt)
            setattr(self, f"{side}_node", np.stack(node, axis=1))
            setattr(self, f"{side}_until", np.stack(until, axis=1))
        self.right_depth = (self.right_node >= 0).sum(axis=1)
        self.left_depth = (self.left_node >= 0).sum(axis=1)

    def _trie(self, vocab, byte_of) -> None:
        keys, nodes, self_inner, self_final = {}, 1, {}, {}
        for s, i in vocab.items():
            ends = s.endswith(self.end) and len(s) > len(self.end)
            body = s[:-len(self.end)] if ends else s
            at = 0
            for c in body:
                k = at << 8 | byte_of[c]
                if k not in keys:
                    keys[k] = nodes
                    nodes += 1
                at = keys[k]
            (self_final if ends else self_inner)[at] = i
        self.step = IntTable(np.fromiter(keys, np.int64), np.fromiter(keys.values(), np.int64))
        self.accept = np.full((2, nodes), -1, dtype=np.int64)
        for row, d in ((0, self_inner), (1, self_final)):
            self.accept[row, np.fromiter(d, np.int64)] = np.fromiter(d.values(), np.int64)
        self.accept_of = self.accept.tolist()

    @cached_property
    def step_of(self) -> dict[int, int]:
        """The trie's steps for one byte at a time; made when the first long word comes."""
        used = self.step.keys >= 0
        return dict(zip(self.step.keys[used].tolist(), self.step.values[used].tolist()))

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The ranks for one pair at a time; made when the first long word is merged."""
        used = self.rank.keys >= 0
        return dict(zip(self.rank.keys[used].tolist(), self.rank.values[used].tolist()))

    def _check_tokens(self, vocab, byte_of) -> None:
        """Tokens whose own text is not encoded to them are odd."""
        words, ids, closed = [], [], []
        for s, i in vocab.items():
            ends = s.endswith(self.end) and len(s) > len(self.end)
            body = s[:-len(self.end)] if ends else s
            words.append(bytes(byte_of[c] for c in body))
            ids.append(i)
            closed.append(ends)
        got = self._merge_all(words, np.array(closed))
        for i, t in zip(ids, got):
            if len(t) != 1 or t[0] != i:
                self.odd[i] = True

    # --- encoding of distinct words -----------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        tokens, word = self._longest(words)
        pair = (tokens[:-1] << 20) | tokens[1:]
        inside = word[:-1] == word[1:]
        bad = np.zeros(len(words), dtype=bool)
        bad[word[self.odd[tokens]]] = True
        if inside.any():
            distinct, back = np.unique(pair[inside], return_inverse=True)
            crossing = self._crosses(distinct >> 20, distinct & ((1 << 20) - 1))
            bad[word[:-1][inside][crossing[back]]] = True
        fix = np.flatnonzero(bad)
        if not len(fix):
            return tokens, np.bincount(word, minlength=len(words))
        keep = ~bad[word]
        merged = self._merge_all([words[i] for i in fix], np.ones(len(fix), dtype=bool))
        t = np.concatenate([tokens[keep], *merged])
        w = np.concatenate([word[keep], np.repeat(fix, [len(m) for m in merged])])
        order = np.argsort(w, kind="stable")
        return t[order], np.bincount(w, minlength=len(words))

    def _longest(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(longest tokens of all words in a row, number of the word of each)."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._walk_all(words)
        t, w = self._walk_all([b"" if len(x) > LONG_WORD else x for x in words])
        walks = [self._walk_one(words[k]) for k in long]
        t = np.concatenate([t, *walks])
        w = np.concatenate([w, np.repeat(long, [len(x) for x in walks])])
        order = np.argsort(w, kind="stable")
        return t[order], w[order]

    def _walk_one(self, word: bytes) -> np.ndarray:
        """The longest tokens of one long word, a byte at a time."""
        step, n, out = self.step_of.get, len(word), array("i")
        inner, final = self.accept_of
        at = 0
        while at < n:
            node, cur, best, best_at = 0, at, -1, at
            while cur < n and (nxt := step(node << 8 | word[cur])) is not None:
                node, cur = nxt, cur + 1
                token = final[node] if cur == n else inner[node]
                if token >= 0:
                    best, best_at = token, cur
            out.append(best)
            at = best_at
        return np.frombuffer(out, dtype=np.int32).astype(np.int64)

    def _walk_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(n)
        at = end - n
        who = np.flatnonzero(n > 0)
        cur, end_, node = at[who].copy(), end[who], np.zeros(len(who), np.int64)
        best, best_at = np.full(len(who), -1, np.int64), cur.copy()
        seq = np.zeros(len(who), np.int64)
        out_t, out_w, out_s = [], [], []
        while len(who):
            inside = cur < end_
            nxt = np.where(inside, self.step.get(node << 8 | data[np.where(inside, cur, 0)]), -1)
            go = nxt >= 0
            node = np.where(go, nxt, 0)
            cur = cur + go
            token = np.where(go, self.accept[(cur == end_).astype(np.int64), node], -1)
            hit = token >= 0
            best, best_at = np.where(hit, token, best), np.where(hit, cur, best_at)
            if not go.all():
                stop = ~go
                out_t.append(best[stop])
                out_w.append(who[stop])
                out_s.append(seq[stop])
                seq = seq + stop
                cur = np.where(stop, best_at, cur)
                alive = ~(stop & (best_at == end_))
                who, cur, end_, node = who[alive], cur[alive], end_[alive], node[alive]
                best, best_at, seq = best[alive], best_at[alive], seq[alive]
        if not out_t:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        t, w, s = np.concatenate(out_t), np.concatenate(out_w), np.concatenate(out_s)
        order = np.lexsort((s, w))
        return t[order], w[order]

    def _crosses(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether some merge crosses the border between x and y."""
        bad = np.zeros(len(x), dtype=bool)
        for i in range(int(self.right_depth[x].max(initial=0))):
            for j in range(int(self.left_depth[y].max(initial=0))):
                a, b = self.right_node[x, i], self.left_node[y, j]
                todo = np.flatnonzero((a >= 0) & (b >= 0) & ~bad)
                if not len(todo):
                    continue
                r = self.rank.get(a[todo] << 20 | b[todo])
                # of equal ranks the leftmost pair merges first
                bad[todo] = (r >= 0) & (r < self.right_until[x[todo], i]) & (r <= self.left_until[y[todo], j])
        return bad

    def _merge_all(self, words: list[bytes], closed: np.ndarray) -> list[np.ndarray]:
        """Exact merging, many words of like length at once."""
        out: list = [None] * len(words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(n, kind="stable")
        at = 0
        while at < len(order):
            if n[order[at]] > 48:
                for k in order[at:]:
                    out[k] = self._merge_one(self._symbols(words[k], closed[k]))
                break
            stop = int(np.searchsorted(n[order], min(48, n[order[at]] + 3), side="right"))
            stop = min(stop, at + 65536)
            for k, t in zip(order[at:stop], self._merge_block([words[k] for k in order[at:stop]],
                                                              closed[order[at:stop]])):
                out[k] = t
            at = stop
        return out

    def _symbols(self, word: bytes, closed: bool) -> list[int]:
        b = np.frombuffer(word, dtype=np.uint8)
        t = self.inner[b]
        if closed and len(b):
            t[-1] = self.final[b[-1]]
        return t.tolist()

    def _merge_block(self, words: list[bytes], closed: np.ndarray):
        n = np.fromiter(map(len, words), np.int64, len(words))
        width = max(1, int(n.max(initial=0)))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        cols = np.arange(width)
        t = np.where(cols < n[:, None], self.inner[raw], -1)
        rows = np.arange(len(words))
        last = np.maximum(n - 1, 0)
        t[rows, last] = np.where(closed & (n > 0), self.final[raw[rows, last]], t[rows, last])
        result: list = [None] * len(words)

        def ranks(a, b):
            r = np.where((a >= 0) & (b >= 0), self.rank.get(np.where(b >= 0, a << 20 | b, 0)), -1)
            return np.where(r >= 0, r, NO)

        r = ranks(t[:, :-1].ravel(), t[:, 1:].ravel()).reshape(len(words), width - 1)
        live = rows
        while True:
            best = r.argmin(axis=1) if r.shape[1] else np.zeros(len(live), np.int64)
            low = r[np.arange(len(live)), best] if r.shape[1] else np.full(len(live), NO)
            done = low >= NO
            for k in np.flatnonzero(done):
                row = t[k]
                result[live[k]] = row[row >= 0]
            if done.all():
                return result
            live, t, r, best, low = live[~done], t[~done], r[~done], best[~done], low[~done]
            here = np.arange(len(live))
            cols = np.arange(t.shape[1])
            src = np.minimum(cols + (cols > best[:, None]), t.shape[1] - 1)
            t = np.take_along_axis(t, src, axis=1)
            t[:, -1] = -1
            t[here, best] = self.made[low]
            src = np.minimum(cols[:-1] + (cols[:-1] > best[:, None]), r.shape[1] - 1)
            r = np.take_along_axis(r, src, axis=1)
            r[:, -1] = NO
            prev = np.maximum(best - 1, 0)
            r[here, prev] = np.where(best > 0, ranks(t[here, prev], t[here, best]), r[here, prev])
            nxt = np.minimum(best + 1, t.shape[1] - 1)
            after = ranks(t[here, best], np.where(best + 1 < t.shape[1], t[here, nxt], -1))
            fits = best < r.shape[1]
            r[here[fits], best[fits]] = after[fits]

    def _merge_one(self, symbols: list[int]) -> np.ndarray:
        """One long word: a heap of (rank, place), packed, over a linked list of symbols.

        An entry is stale where the pair at its place no longer has its rank.
        """
        n, rank, made = len(symbols), self.rank_of.get, self.made_of
        t, nxt, prev = array("i", symbols), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(t[i] << 20 | t[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = nxt[i]
            if t[i] < 0 or j >= n or rank(t[i] << 20 | t[j]) != r:
                continue
            t[i], t[j] = made[r], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (x := rank(t[i] << 20 | t[k])) is not None:
                    heapq.heappush(heap, x << 32 | i)
            p = prev[i]
            if p >= 0 and (x := rank(t[p] << 20 | t[i])) is not None:
                heapq.heappush(heap, x << 32 | p)
        out = np.frombuffer(t, dtype=np.int32).astype(np.int64)
        return out[out >= 0]

    # --- texts ----------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not known_chars(text):
            return _library_words(text)
        # lower case character by character: a final sigma is like any other
        return _WORDS.findall(text.replace("Σ", "σ").lower())

    def _slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count) of each word's ids in the third array."""
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(slots < 0)
        if not len(unseen):
            return self.starts[slots], self.counts[slots], self.flat
        asked = [words[i] for i in unseen.tolist()]
        fresh = dict(zip(dict.fromkeys(asked), count()))
        ids, n = self.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
        base, used = len(self.starts), self.used
        slots[unseen] = np.fromiter(map(fresh.__getitem__, asked), np.int64, len(asked)) + base
        starts = np.concatenate([self.starts, np.cumsum(n) - n + used])
        counts = np.concatenate([self.counts, n])
        pool = np.concatenate([self.flat[:used], ids.astype(np.int32)])
        if base + len(fresh) <= WORDS_KEPT:
            self.slot.update((w, base + k) for w, k in fresh.items())
            self.flat, self.used, self.starts, self.counts = pool, len(pool), starts, counts
        return starts[slots], counts[slots], pool

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special tokens in it recognised."""
        words: list[str] = []
        bounds, marks = [], []  # per text: end in words; (place, id) of special tokens
        for text in texts:
            at = 0
            if "<|" in text:
                for m in self.special_re.finditer(text):
                    words += self._words(text[at:m.start()])
                    marks.append((len(words), self.special[m.group()]))
                    words.append("")
                    at = m.end()
            words += self._words(text[at:] if at else text)
            bounds.append(len(words))
        start, n, pool = self._slots(words)
        for i, _ in marks:
            n[i] = 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        idx = np.arange(total) + np.repeat(start - (ends - n), n)
        ids = pool[np.minimum(idx, len(pool) - 1)] if total else np.empty(0, np.int32)
        for i, t in marks:
            ids[ends[i] - 1] = t
        cut = np.concatenate(([0], ends))[np.array(bounds, dtype=np.int64)]
        return np.split(ids, cut[:-1]) if len(texts) else []

    def decode(self, ids) -> str:
        """Token strings joined by a space: the file names no decoder."""
        s = self.strings
        return " ".join([s[i] for i in ids.tolist()])


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A very long text in pieces that start at white space."""
    at = 0
    while len(text) - at > size:
        m = _SPACES.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict[int, WordBpe] = {}


def _codec(bc) -> WordBpe:
    """The worker's codec, built once from the broadcast file (a fixed few MB)."""
    if bc.id not in _LOADED:
        _LOADED.clear()
        _LOADED[bc.id] = WordBpe(bc.value)
    return _LOADED[bc.id]


class _File:
    def __init__(self, bc):
        self.id, self._bc = bc._jbroadcast.id() if bc._jbroadcast is not None else 0, bc

    @property
    def value(self):
        return self._bc.value


def _file(spark: SparkSession, path: str | None) -> _File:
    with open(path or default_path(), encoding="utf-8") as f:
        return _File(spark.sparkContext.broadcast(f.read()))


def _ids_of(codec: WordBpe, texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(text number, its ids in one or more arrays); memory follows BATCH_CHARS, not the batch."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SEGMENT:
            yield i, [codec.encode_batch([s])[0] for s in segments(texts[i])]
            i += 1
            continue
        j, chars = i, 0
        while j < len(texts) and len(texts[j]) <= SEGMENT and (j == i or chars + len(texts[j]) <= BATCH_CHARS):
            chars += len(texts[j])
            j += 1
        for k, ids in enumerate(codec.encode_batch(texts[i:j])):
            yield i + k, [ids]
        i = j


OUT_TOKENS = 200_000  # ids in one output batch


def _out_batch(batch: pa.RecordBatch, rows: list, ids: bool) -> pa.RecordBatch:
    """The kept columns of ``batch`` with the columns made for its rows."""
    n = [r[0] for r in rows]
    columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array([r[1] for r in rows], pa.string()),
               pa.array([r[2] for r in rows], pa.string())]
    names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids:
        parts = [p for r in rows for p in r[3]]
        flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def tokenised(spark: SparkSession, docs: DataFrame, path: str | None = None, keep: tuple = ("doc_id",),
              ids: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, if wanted, ``ids``.

    Every whole text is encoded, and the digest of its decoded text is that of its ids decoded.
    """
    file = _file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            first, held, rows = 0, 0, []
            for i, parts in _ids_of(codec, texts):
                a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    if len(part):
                        a.update(part.astype("<u4").tobytes())
                        b.update((" " if n else "").encode() + codec.decode(part).encode("utf-8"))
                        n += len(part)
                rows.append((n, a.hexdigest(), b.hexdigest(), parts if ids else None))
                held += n
                if held >= OUT_TOKENS or i + 1 == len(texts):
                    yield _out_batch(batch.slice(first, len(rows)), rows, ids)
                    first, held, rows = i + 1, 0, []

    src = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(keep)], docs["text"].alias("_text"))
    schema = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * ids
    return src.mapInArrow(run, ", ".join(schema)).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def decode(spark: SparkSession, tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) with ``decoded``: each id list as text."""
    file = _file(spark, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = _codec(file)
        return pd.Series([codec.decode(np.asarray(i)) if i is not None else "" for i in ids])

    return tokens.withColumn("decoded", text(F.col("ids")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
