import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import periodic as P


def brute(words):
    """Runs by definition: every lag's maximal matches, kept where no smaller lag has the same stretch as period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(24, 3 * q) and not any(
                    all(words[k] == words[k - d] for k in range(s + d, s + length)) for d in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def ids(words):
    return np.array([hash(w) % 1000003 if not isinstance(w, int) else w for w in words], dtype=np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9)), max_size=5))
def test_runs_equal_the_definition(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert P.find_runs(np.array(words, dtype=np.int64)) == brute(words)


def test_runs_of_long_and_nested_periods():
    r = random.Random(5)
    inner = [0] * 30 + [1]
    for unit in (inner, inner * 2 + [2], [r.randrange(3) for _ in range(64)], [r.randrange(2) for _ in range(65)], [7], [1, 1, 2]):
        for times in (3, 4):
            for tail in ([], unit[:5], [9]):
                words = [r.randrange(50) for _ in range(20)] + unit * times + tail + [3, 4]
                assert P.find_runs(np.array(words, dtype=np.int64)) == brute(words)


def fixed(doc_id, text):
    """The words of the query's input, by plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def contract(doc_id, words):
    found = brute(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best if best else (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["a", "b", "the", "é", f"w{i}"]) for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    rows += [(300 + i, "\n".join(["same line of words"] * i)) for i in range(12)]
    rows += [(None, "x " * 40), (None, None), (7001, None), (7002, " \n\t "), (3, "x y " * 30), (3, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    have = sorted(map(repr, map(tuple, P.op12(spark, str(tmp_path)).collect())))
    assert have == sorted(repr(contract(i, fixed(i, t))) for i, t in rows)


def test_odd_rows_empty_table_and_clashing_columns(spark, odd, none):
    rows = P.periodic_runs(spark, odd, keep=tuple(odd.columns)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(words) < 3000:
            assert [tuple(x) for x in r.runs] == brute(words) and r.n_words == len(words)
    long = next(r for r in rows if r.n_words == 4000)
    assert [tuple(x) for x in long.runs] == [(0, 4000, 1)] and long.collapsed == "word"
    assert P.periodic_runs(spark, none).count() == 0


def test_neighbours_in_a_batch_do_not_matter():
    texts = ["a b c d e f g h " * 9, "", "a b c d e f g h " * 9, "q", "a b c d e f g h " * 4]
    alone = [next(P._batch_runs([t])) for t in texts]
    assert list(P._batch_runs(texts)) == alone and alone[0][1] == [(0, 72, 8)]


def test_five_megabytes():
    r = random.Random(2)
    unit = " ".join(f"u{r.randrange(1000)}" for _ in range(30_000))
    for text in ("the cat " * 625_000, " ".join(f"w{r.randrange(5000)}" for _ in range(900_000)), (unit + " ") * 30, "x" * 5_000_000):
        t = time.perf_counter()
        ((n, found, kept),) = P._batch_runs([text])
        assert time.perf_counter() - t < 60
        if text.startswith("the"):
            assert found == [(0, 1_250_000, 2)] and kept == "the cat"
        if text.startswith(unit):
            assert found == [(0, 900_000, 30_000)] and kept == unit


def test_pieces_of_a_long_text(monkeypatch):
    text = "".join(random.Random(4).choice("ab \n") for _ in range(3000))
    want = [re.findall(r"[^\x20\x09-\x0D]+", text)[i] for i in range(len(P.word_ids(text)[0]))]
    monkeypatch.setattr(P, "PIECE", 7)
    got, words = P.word_ids(text)
    assert [words[i] for i in got] == want
