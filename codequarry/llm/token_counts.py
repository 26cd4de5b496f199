"""Token counts by a whole-token shortcut, for a byte-level BPE vocabulary file.

Most pre-tokens of a text are tokens of the vocabulary.  That alone does not
make them one token: merging may reach other parts first.  So:

1. *Prove*, once and offline from any text: every vocabulary string is
   merged from its bytes; those that end as the one token are proved.
2. *Count*: a text is cut into pre-tokens, and each proved one counts one by
   a look-up of the string.
3. *Merge* only the rest, by rank, and remember their counts (a bounded
   number of them); a long pre-token is merged with a heap over a linked
   list, so a text of one word takes n log n steps.

A special token's string inside a text is that one token, as the file says.

Defined results: a NULL or empty text has 0 bytes and 0 tokens.  Texts are
counted whole; a very long one in pieces that end before white space, where
every text has a border between pre-tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _File, byte_alphabet
from .common import known_chars

LIMIT = 512
KEPT = 500_000        # merged pre-tokens that a worker remembers
REMEMBERED = 64       # none longer than this is remembered
PIECE = 1 << 20       # characters of a very long text counted at once
_NONE = 1 << 62       # above every rank
_TOKEN = (1 << 20) - 1
MERGED = 1 << 32      # a pre-token that was merged adds this, so one sum gives both counts

# FIXED VALUES: the pre-token pattern of the vocabulary file, for ASCII and for all texts.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ALL = regex.compile(_PATTERN)
_CUT = re.compile(r"(?<=\S)(?=\s)")


class ByteBpe:
    """Ranks and proved whole tokens of one vocabulary file, given as its JSON text."""

    def __init__(self, text: str, proved: list[str] | None = None):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.base = [vocab[c] for c in alphabet]
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.vocab = vocab
        self.rank: dict[int, int] = {}  # two tokens -> rank << 20 | the token they make
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], k << 20 | vocab[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.counts = _Counts(self, self.prove() if proved is None else proved)

    def prove(self) -> list[str]:
        """The vocabulary strings that encode alone as one token (those that are text)."""
        out = []
        for s, i in self.vocab.items():
            raw = bytes(self.byte_of[c] for c in s)
            if self.merge(raw) == [i]:
                try:
                    out.append(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # a part of a character is never a pre-token
        return out

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of one pre-token, by exact merging."""
        t = [self.base[b] for b in raw]
        if len(t) > 48:
            return self._merge_long(t)
        rank = self.rank.get
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(t, t[1:])]
        while ranks and (low := min(ranks)) < _NONE:
            i = ranks.index(low)
            t[i:i + 2] = [low & _TOKEN]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(t[i - 1] << 20 | t[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(t[i] << 20 | t[i + 1], _NONE)
        return t

    def _merge_long(self, t: list[int]) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list; a heap entry whose tokens changed is stale."""
        n = len(t)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        pairs = [a << 20 | b for a, b in zip(t, t[1:])]
        heap = [(r, i, pair) for i, pair in enumerate(pairs) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or t[i] < 0 or t[i] << 20 | t[j] != pair:
                continue
            t[i], t[j] = low & _TOKEN, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank(pair := t[x] << 20 | t[y])) is not None:
                    heapq.heappush(heap, (r, x, pair))
        return [x for x in t if x >= 0]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens of a whole text, its pre-tokens that had to be merged)."""
        total = 0
        for part in self._parts(text):
            total += sum(map(self.counts.__getitem__, pre_tokens(part)))
        total += len(self.special.findall(text)) if self.special else 0
        return total % MERGED, total // MERGED

    def _parts(self, text: str) -> Iterator[str]:
        """What lies between special tokens, in pieces of bounded size."""
        for part in self.special.split(text) if self.special else [text]:
            at = 0
            while len(part) - at > PIECE and (m := _CUT.search(part, at + PIECE)):
                yield part[at:m.start()]
                at = m.start()
            yield part[at:] if at else part


class _Counts(dict):
    """Pre-token -> its number of tokens; one that is absent is merged when first asked for."""

    def __init__(self, codec: ByteBpe, proved: list[str]):
        super().__init__((s, 1) for s in proved)
        self.codec, self.most = codec, len(self) + KEPT

    def __missing__(self, word: str) -> int:
        n = len(self.codec.merge(word.encode("utf-8", "surrogatepass"))) + MERGED
        if len(word) <= REMEMBERED and len(self) < self.most:
            self[word] = n
        return n


def _library_pre_tokens(text: str) -> list[str]:
    """For texts with characters newer than Python's tables: by the tables of the file's library."""
    from tokenizers import Regex, pre_tokenizers
    return [w for w, _ in pre_tokenizers.Split(Regex(_PATTERN), "isolated").pre_tokenize_str(text)]


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    return _ALL.findall(text) if known_chars(text) else _library_pre_tokens(text)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict[int, ByteBpe] = {}


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens, n_merged (pre-tokens without a proof) and over_limit."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    proved = ByteBpe(spec).prove()
    # both broadcasts are as large as the vocabulary file, whatever the table
    file, whole = _File(spark.sparkContext.broadcast(spec)), _File(spark.sparkContext.broadcast(proved))

    def codec() -> ByteBpe:
        if file.id not in _LOADED:
            _LOADED.clear()
            _LOADED[file.id] = ByteBpe(file.value, whole.value)
        return _LOADED[file.id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec()
        names = [*[f"_k{i}" for i in range(len(keep))], "_bytes", "_tokens", "_merged"]
        for batch in batches:
            got = [bpe.count(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], pa.int64())],
                names=names)

    size = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long")
    src = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(keep)], size.alias("_bytes"),
                      docs["text"].alias("_text"))
    schema = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = src.mapInArrow(run, ", ".join([*schema, "_bytes long", "_tokens long", "_merged long"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_bytes").alias("n_bytes"),
                      F.col("_tokens").alias("n_tokens"), F.col("_merged").alias("n_merged"),
                      (F.col("_tokens") > limit).alias("over_limit"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
