import time
import zlib

import numpy as np

from codequarry.llm import quality as Q
from codequarry.llm import toxicity as X


def test_crf_marginals_match_all_labelings():
    rng = np.random.default_rng(0)
    c = Q.LineCrf()
    c.w = rng.normal(size=c.w.shape)
    c.change, c.begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    texts = ["One line.\nTwo lines!! AB\nthree ### ###", "", "solo"]
    bins, doc, _ = Q.line_bins(texts)
    view = c.views(bins, doc)
    p, pair = c.marginals(view, doc, len(texts))
    want, want_pair = [], np.zeros((2, 2))
    score = c.w.ravel()[view].sum(axis=1)
    for d in range(len(texts)):
        s = score[doc == d]
        total, good = 0.0, np.zeros(len(s))
        pairs = np.zeros((2, 2))
        for m in range(2 ** len(s)):
            y = [(m >> k) & 1 for k in range(len(s))]
            e = c.begin[y[0]] + sum(x * (k - 0.5) for x, k in zip(s, y)) + sum(c.change[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(e)
            good += np.exp(e) * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += np.exp(e)
        want += list(good / total)
        want_pair += pairs / total
    assert np.allclose(p, want) and np.allclose(pair, want_pair)


def test_line_bins_cover_all_texts_and_skip_blank_lines():
    bins, doc, length = Q.line_bins(["a\n\nb", "", "\n\n", "c"])
    assert doc.tolist() == [0, 0, 1, 2, 3] and (bins >= 1).all() and (length >= 1).all()


def rows_and_truth(spark, labels, label, scored):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    out = []
    for r in scored.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == held and 0 <= r.score <= 1
        if held and r.doc_id in truth:
            out.append((r.predicted, truth[r.doc_id]))
    return out


def test_quality_on_held_out_rows(spark, corpus, labels):
    got = rows_and_truth(spark, labels, "quality", Q.scored(spark, corpus, labels))
    assert np.mean([p == t for p, t in got]) >= 0.97
    good = [p for p, t in got if t == 1]
    assert np.mean(good) >= 0.98  # clean documents stay


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = rows_and_truth(spark, lab, "toxic", X.scored(spark, docs, lab))
    assert np.mean([p == t for p, t in got]) >= 0.96
    assert np.mean([p for p, t in got if t == 0]) <= 0.03
    assert np.mean([p for p, t in got if t == 1]) >= 0.85


def test_score_is_the_same_alone_and_in_a_batch():
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "vile", "nasty", "kind", "warm"]
    rows = [(" ".join(r.choice(words, size=12)) + (" vile nasty" if k % 2 else ""), k % 2) for k in range(80)]
    texts = ["", "vile", "alpha beta", "x" * 5000, "warm " * 3000, "a b c"]
    for model in (X.TextCnn().fit(rows), Q.LineCrf().fit(rows)):
        together = model.score(texts)
        assert np.allclose(together, [model.score([t])[0] for t in texts], atol=1e-6)


def random_crf(seed):
    r = np.random.default_rng(seed)
    c = Q.LineCrf()
    c.w[:] = r.normal(size=c.w.shape)
    c.change[:], c.begin[:] = r.normal(size=(2, 2)), r.normal(size=2)
    return c


def test_crf_chains_in_blocks_equal_line_by_line(monkeypatch):
    c, r = random_crf(6), np.random.default_rng(7)
    n = [1, 5, 6, 7, 12, 40, 83]
    doc, score = np.repeat(np.arange(len(n)), n), r.normal(size=sum(n)) * 8
    want = c.chain_marginals(score, doc, len(n))
    for chain in (1, 2, 5, 6, 40, 82):
        monkeypatch.setattr(Q, "CHAIN", chain)
        got = c.chain_marginals(score, doc, len(n))
        assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-9)


def test_crf_reads_a_text_in_pieces(monkeypatch):
    c, r = random_crf(8), np.random.default_rng(9)
    lines = ["", "   ", "a b a b", "The quick, brown fox; 1234 #### --", "x" * 90, "é ü 中文", "same line here"]
    texts = ["\n".join(r.choice(lines, size=k)) for k in (0, 1, 30, 200)] + ["\n" * 300, "", " \n" * 200 + "end"]
    want, score = [x.tolist() for x in Q.line_bins(texts)], c.score(texts)
    for most in (1, 7, 64, 500):
        monkeypatch.setattr(Q, "PIECE_CHARS", most)
        monkeypatch.setattr(Q, "VIEW_LINES", 1 + most // 5)
        assert [x.tolist() for x in Q.line_bins(texts)] == want
        assert np.allclose(c.score(texts), score, atol=1e-12)
        assert all("".join(Q.line_pieces(t, most)) == t for t in texts)


def test_crf_scores_a_text_of_many_lines():
    c = random_crf(10)
    text = "\n".join(["one two three", "4 5 6 ####", "The end."] * 100_000)
    start = time.monotonic()
    score = c.score([text, "one two three"])
    assert 0 <= score[0] <= 1 and time.monotonic() - start < 20


def test_cnn_pools_a_long_text_in_blocks():
    c = X.TextCnn()
    c.embed[:] = np.random.default_rng(2).normal(size=c.embed.shape)
    h, _ = X.text_words([" ".join(f"w{i}" for i in range(700))])
    ids = c.bucket(h)
    blank = np.vstack([ids, np.zeros((2, X.PIECES), dtype=ids.dtype)])
    a = c._pool(blank, np.array([0]), block=64)[0]
    assert np.allclose(np.maximum(a + c.bias, 0), c._forward(ids)[0], atol=1e-4)


def plain_raw(c, text):
    """Score before calibration, word by word and filter by filter."""
    ids = c.bucket(X.text_words([text])[0]).tolist() or [[0] * X.PIECES]
    words = [[sum(float(c.embed[p][d]) for p in piece) for d in range(X.DIM)] for piece in ids]
    words += [[0.0] * X.DIM] * 2
    total, n = float(c.out_bias), 0
    for k, f in zip(X.WIDTHS, c.filters):
        for o in range(X.FILTERS):
            best = max(sum(words[i + j][d] * float(f[j * X.DIM + d][o]) for j in range(k) for d in range(X.DIM))
                       for i in range(len(ids)))
            total += max(0.0, best + float(c.bias[n])) * float(c.out[n])
            n += 1
    return total


def plain_language(text):
    words = "".join(x if x.isalnum() else " " for x in text.lower()).split()
    counts = [0] + [sum(w in f.split() for w in words) for f in X.FUNCTION_WORDS.values()]
    return counts.index(max(counts))


def test_cnn_against_plain_loops():
    r = np.random.default_rng(4)
    c = X.TextCnn()
    c.embed[1:] = r.normal(size=(X.BUCKETS - 1, X.DIM))
    c.bias[:], c.out[:], c.out_bias = r.normal(size=len(c.bias)), r.normal(size=len(c.out)), np.float32(0.3)
    c.shift = r.normal(size=len(X.LANGUAGES))
    texts = ["", "one", "the cat and the hat", "der Hund und die Katze sind nicht hier", "le chat est dans les rues",
             "los perros y el gato con una casa", "nothing known ... at all 123", "é è ü"]
    want = [1 / (1 + np.exp(-(plain_raw(c, t) + c.shift[plain_language(t)]))) for t in texts]
    assert np.allclose(c.score(texts), want, atol=1e-4)


def test_calibration_takes_the_best_f1_of_each_language():
    r = np.random.default_rng(5)
    c = X.TextCnn()
    lang = r.integers(0, 3, size=600)
    toxic = r.random(600) < 0.3
    raw = np.where(toxic, 1.0, -1.0) + lang * 2.0 + r.normal(size=600) * 0.8
    toxic[lang == 2] = False
    toxic[np.flatnonzero(lang == 2)[:3]] = True  # too few: language 2 shares the pooled threshold
    c._calibrate(raw, toxic, lang)
    at = np.log(X.THRESHOLD / (1 - X.THRESHOLD))

    def f1(raw, toxic, threshold):
        hit = sum(1 for x, t in zip(raw, toxic) if x >= threshold and t)
        return 2 * hit / (sum(1 for x in raw if x >= threshold) + int(toxic.sum()))

    for k, rows in ((0, lang == 0), (1, lang == 1), (2, lang >= 0)):
        best = max(f1(raw[rows], toxic[rows], x) for x in raw[rows])
        assert np.isclose(f1(raw[rows], toxic[rows], at - c.shift[k]), best)


def test_toxicity_of_long_texts_in_pieces(monkeypatch):
    r = np.random.default_rng(6)
    c = X.TextCnn()
    c.embed[1:] = r.normal(size=(X.BUCKETS - 1, X.DIM))
    c.shift = r.normal(size=len(X.LANGUAGES))
    words = ["the", "und", "Größe", "x", "a1", "vile", "中文", "THE", "…", "--", "e\u0301"]
    texts = [" ".join(r.choice(words, size=k)) for k in (0, 1, 2, 3, 5, 40, 400)] + ["...", "y" * 300, "  the  ", "a" * 90 + " b"]
    whole = c.score(texts)
    for most in (1, 2, 7, 64):
        monkeypatch.setattr(X, "BATCH_CHARS", most)
        assert np.allclose(c.score(texts), whole, atol=1e-5)
        assert all("".join(X.word_pieces(t, most)) == t.lower() for t in texts)


def test_a_text_of_some_megabytes():
    r = np.random.default_rng(8)
    text = "\n".join(" ".join(r.choice(["the", "vile", "one", "Größe", "中文", "7"], size=12)) for _ in range(110_000))
    assert len(text.encode()) > 5_000_000
    c = X.TextCnn()
    c.embed[1:] = r.normal(size=(X.BUCKETS - 1, X.DIM)) * 0.1
    short = text[:len(text) // 50]
    a, b, short_alone = *c.score([text, short]), c.score([short])[0]
    assert 0 <= a <= 1 and np.isclose(b, short_alone)
    q = Q.LineCrf()
    assert 0 <= q.score([text])[0] <= 1


def test_odd_rows_empty_tables_and_missing_classes(spark, odd, none, labels):
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (Q, X):
        for lab in (one, no_labels):
            out = module.scored(spark, odd, lab).collect()
            assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert module.scored(spark, none, labels).count() == 0
    assert Q.keep_good(spark, odd, one).columns == odd.columns
    assert X.keep_clean(spark, odd, one).count() == odd.count()
