import hashlib
import random
import re

import pytest

from codequarry.llm import pii as P

# The contract's patterns, as given.
CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
    return 16 <= len(d) <= 19 and total % 10 == 0


def brute(text):
    return [(k, m.start(), m.end()) for k in P.KINDS for m in re.finditer(CONTRACT[k], text or "")
            if passes(k, m.group())]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    bits = ["1", "23", "4", "0", "255", "256", ".", ".", "-", " ", "  ", "@", "a", "B.c", "+", "+1", "(", ")", "é", "😀",
            "x_y", "%", "com", "\n", "4111111111111111", "1.2.3.4", "a@b.c", "999.1.1.1.1.1.1.1", "tel "]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1200)]
    return out + ["", None, "1" * 20000, "a" * 30000 + "@b.c", "1 " * 9000, "1.2.3.4 " * 2000, "+" * 5000 + "1"]


def test_base_spans_match_the_contract_patterns(spark, texts, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path + "/documents.parquet")
    got = {r.doc_id: r for r in P.op8(spark, path).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert [getattr(got[i], f"n_{k}") for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS], t
        joined = ",".join("%s:%d:%d" % x for x in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        all_spans = set(got[i].spans.split(","))
        assert set(joined.split(",")) <= all_spans or not joined  # base spans stay


def test_added_spans_do_not_overlap_base_spans(spark, tmp_path):
    rows = [(0, "tel: 555-123-4567 today"), (1, "call +1 (555) 123-4567 now"), (2, "mail john (at) site (dot) com, ok"),
            (3, "card 3782 822463 10005 x"), (4, "nothing here at all")] * 3
    path = str(tmp_path)
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(
        path + "/documents.parquet")
    got = {r.doc_id: r.spans for r in P.op8(spark, path).collect()}
    assert got[0] == "phone:5:17" and got[1] == "phone:5:22" and got[4] == ""


def test_em_ranks_reliable_labelers():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        good = [("+" if true else "-") if rng.random() < 0.95 else rng.choice("+-0") for _ in range(4)]
        v = "".join(good + [rng.choice("+-0") for _ in range(3)])
        counts[v] = counts.get(v, 0) + 1
    post = P.reliabilities([("ip", v, n) for v, n in counts.items()])
    assert post[("ip", max((v for v in counts if v.startswith("++++")), key=counts.get))] > 0.95
    assert post[("ip", max((v for v in counts if v.startswith("----")), key=counts.get))] < 0.05


def test_classifier_learns_its_features():
    row = lambda **k: {"kind": "phone", **{f: 0 for f in P.FEATURES}, **k}
    m = P.train_spans([row(n_digits=2, true=90.0, n=100), row(n_digits=3, true=5.0, n=100)])["phone"]
    assert m["n_digits"][2] > 0.5 > -0.5 > m["n_digits"][3]


def test_odd_rows_empty_table_and_plan(spark, odd, none, corpus):
    rows, spans = P.personal_data(spark, odd)
    assert rows.count() == odd.count()
    assert sorted(r.kind for r in spans.collect()) == ["card", "email", "ip", "phone"]
    assert P.personal_data(spark, none)[1].count() == 0
    plan = spans._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


NAMES = ["anna", "b.meyer", "lucia", "t_roy", "carlos", "info", "marie"]
HOSTS = ["example", "mail-host", "firma", "tienda", "post"]


def generated(n, seed):
    """(text, [(kind, span)]) with planted personal data in forms that the base patterns do not know, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("123456789") for _ in range(k))
    words = ["the", "report", "und", "de", "la", "green", "house", "was", "at", "dot", "of", "ein", "mot", "sur"]

    def card():
        p = r.choice(["34" + d(12), "4" + d(11), "36" + d(11)])
        return next(p + str(k) for k in range(10) if passes_luhn(p + str(k)))

    true = {
        "phone": lambda: r.choice(["tel ", "phone ", "call ", "fax: ", "Telefon ", "téléphone "]) + "<" + r.choice(
            [f"0{d(2)}/{d(7)}", f"0{d(3)} {d(6)}", f"(0{d(2)}) {d(4)}-{d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]) + ">",
        "email": lambda: r.choice(["mail ", "contact ", "write to ", "Kontakt: ", ""]) + "<" + r.choice(NAMES) + r.choice(
            [" (at) ", " [at] ", " at ", " arroba ", " arobase "]) + r.choice(HOSTS) + r.choice(
            [" dot ", " (dot) ", " punkt ", " punto ", " point "]) + r.choice(["com", "de", "fr", "es", "org"]) + ">",
        "ip": lambda: r.choice(["host ", "server ", "ip ", ""]) + "<" + r.choice(
            [":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8)), "[.]".join(str(r.randrange(1, 255)) for _ in range(4))]) + ">",
        "card": lambda: r.choice(["card ", "visa ", "amex ", "Karte "]) + "<" + card() + ">",
    }
    false = [lambda: f"order {d(9)}", lambda: f"on 20{d(1)}0-1{r.randrange(3)}-1{d(1)} {d(2)} ", lambda: f"isbn 978{d(10)}",
             lambda: f"invoice {d(8)}", lambda: f"section {d(3)} {d(3)} {d(3)}", lambda: "look at house dot then",
             lambda: f"ticket {d(13)}", lambda: f"id {d(10)}", lambda: f"version {d(2)}.{d(2)}.{d(4)}", lambda: "was at report dot green"]
    out = []
    for _ in range(n):
        parts, kinds = [], []
        for _ in range(r.randrange(1, 5)):
            parts.append(" ".join(r.choice(words[:8]) for _ in range(r.randrange(2, 9))) + ",")
            if r.random() < 0.5:
                k = r.choice(list(true))
                parts.append(true[k]())
                kinds.append(k)
            else:
                parts.append(r.choice(false)())
        parts.append("end.")
        text, spans, at = "", [], 0
        for piece in re.split(r"([<>])", ", ".join(parts)):
            if piece == "<":
                at = len(text)
            elif piece == ">":
                spans.append((kinds[len(spans)], at, len(text)))
            else:
                text += piece
        out.append((text, spans))
    return out


def passes_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_added_spans_of_held_out_documents(spark):
    """Fitted without labels on one part, measured on documents generated apart from it."""
    fit, held = generated(1500, 1), generated(600, 2)
    table = lambda docs: spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    _, spans = P.candidate_table(spark, table(fit))
    model = P.fit_spans(spark, spans)
    rows, found = P.personal_data(spark, table(held), model)
    got = {(r.doc_id, r.kind, r.start, r.end) for r in rows.join(found, "rid").filter("not base").collect()}
    want = {(i, k, a, b) for i, (_, s) in enumerate(held) for k, a, b in s}
    by = {k: (len({x for x in got & want if x[1] == k}), len([x for x in got if x[1] == k]), len([x for x in want if x[1] == k]))
          for k in P.KINDS}
    print(by)
    hit = len(got & want)
    assert hit / len(got) >= 0.95 and hit / len(want) >= 0.8, by
    for k, (both, g, w) in by.items():
        assert both and both / g >= 0.9, (k, by)


def test_five_megabytes(spark, tmp_path):
    import time
    texts = ["1 " * 2_500_000, "a at b dot " * 450_000, "x" * 5_000_000, "12:" * 1_600_000, "0" * 5_000_000, "(" * 5_000_000]
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path + "/documents.parquet")
    t = time.perf_counter()
    assert P.op8(spark, path).count() == len(texts)
    assert time.perf_counter() - t < 120
