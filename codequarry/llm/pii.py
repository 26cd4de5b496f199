"""Personal data by weak supervision (DataFrame functions only).

*Candidates.*  For each kind (email, ip, card, phone) the base pattern gives
base spans: its leftmost matches that pass the kind's rule; they always
stay.  A wider pattern proposes forms that the base does not know, true or
not: addresses spelled with "at" and "dot" words or with letters outside
ASCII; longer and shortened or defanged host addresses; cards of 13 to 15
digits or with other separators; local numbers of 8 to 15 digits.  Dates,
order numbers and sentences with "at" are proposed as well.

*Labelers.*  Seven labelers vote +, - or 0 on every candidate: the base
rule, a checksum or shape test, a gazetteer (top-level domains, calling
codes, issuer digits, reserved ranges), cue and counter-cue words before
the span, the characters next to it, the variety of its digits, and its
form (separators and lengths that are usual, dates and book numbers that
are not).

*EM.*  Votes are counted by (kind, base or wider, vote pattern), at most
8 * 3**7 rows, and a Dawid-Skene model is fitted to each of the eight
groups: each labeler's vote distribution for true and for false spans, and
the share of true ones.

*Span classifier.*  A logistic model of a candidate's own features (length,
digits, the word before, the character after, what the gazetteer, the cues
and the form say) is trained on the EM posteriors, summed by feature tuple,
at most ``MAX_TUPLES`` rows; it is applied as a column expression.  Wider
candidates that pass their check and reach ``ADD_FROM`` and overlap no base
span and no earlier addition are added.

Offsets: a text is split at a pattern's matches, and prefix sums over the
lengths of gaps and matches give each match its place, in code points.  All
patterns run in time linear in the text: runs are entered at their first
character only and are possessive or of bounded length.

Defined results: NULL counts as empty; a text without spans has the digest
of the empty string; rows that repeat are rows of their own.
"""

from __future__ import annotations

from math import exp, log, prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
ADD_FROM = 0.9
BEFORE, AFTER = 40, 2  # characters of context kept

# The base patterns, written so that no run of characters is scanned twice: "at the
# start of a run, or where the last match ended", and possessive runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the maximal runs of 16 to 19 digits; shorter and longer ones fail the rule
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = "(?:at|arroba|arobase|ät)", "(?:dot|punkt|point|punto)"  # FIXED VALUES: the words for the marks
_HOST = r"[A-Za-z0-9-]{1,63}+"
WIDER = {
    "email": r"(?i)(?<![\p{L}\p{N}._%+@-])(?:"
             rf"[A-Za-z0-9._%+-]{{1,64}}+(?: ?[(\[{{] ?{_AT} ?[)\]}}] ?| {_AT} ){_HOST}"
             rf"(?:(?: ?[(\[{{] ?{_DOT} ?[)\]}}] ?| {_DOT} |\.){_HOST}){{1,5}}+"
             r"|[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,5}+)",
    "ip": r"(?i)(?<![\p{L}\p{N}:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}"
          r"|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[\[(]dot[\])])[0-9]{1,3}){3})(?![\p{L}\p{N}:])",
    "card": r"(?<![0-9])(?<![0-9][\x20./-])(?:[0-9](?:[\x20-]?[0-9]){12,14}+|[0-9]{4}(?:[./][0-9]{4}){3})(?![\x20./-]?[0-9])",
    "phone": r"(?<![\p{L}\p{N}+(.,])(?<![\p{N}][\x20./-])\(?[0-9]{2,5}\)?(?:[\x20./-]{0,2}[0-9]{2,5}){1,4}+(?![\p{L}\p{N}])",
}
# FIXED VALUES: gazetteers and cue words.
DOMAINS = "com org net edu gov info io de fr es it nl uk eu ch at co us ca"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91"
CUES = {
    "email": "mail email e-mail contact write kontakt courriel correo",
    "ip": "ip host server address adresse dirección node",
    "card": "card visa mastercard amex credit karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon handy téléphone teléfono móvil",
}
COUNTER_CUES = "version v section isbn issn order invoice bestellung commande pedido ticket date datum fecha id page nr no"
LABELERS = ("rule", "check", "gazetteer", "cue", "edge", "variety", "form")


def _words(s: str) -> str:
    return "|".join(w.replace("-", r"\-") for w in s.split())


# --- candidates ---------------------------------------------------------------

def with_matches(df: DataFrame, name: str, text: str, pattern: str, worth: Column, number: int) -> DataFrame:
    """Adds ``name``: array of (p, gap, before, m, after), one for each match of ``pattern``.

    ``gap`` is the number of code points since the last match.  ``worth`` is a cheap test
    without which no match is possible.
    """
    t = F.when(worth, F.col(text)).otherwise(F.lit(""))
    gaps = F.transform(F.split(t, pattern, -1), lambda s: F.struct(
        F.length(s).alias("n"), F.right(s, F.lit(BEFORE)).alias("before"), F.left(s, F.lit(AFTER)).alias("after")))
    df = df.withColumn("_g", gaps).withColumn("_m", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_z", F.arrays_zip(F.col("_g"), F.col("_m"), F.slice("_g", 2, 1 << 30).alias("_n")))
    spans = F.transform(F.filter("_z", lambda z: z["_m"].isNotNull()), lambda z: F.struct(
        F.lit(number).alias("p"), z["_g"]["n"].alias("gap"), z["_g"]["before"].alias("before"),
        z["_m"].alias("m"), z["_n"]["after"].alias("after")))
    return df.withColumn(name, spans).drop("_g", "_m", "_z")


def candidates(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: rid, doc_id; spans: rid, kind, wide, m, before, after, start, end)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digits, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    other = F.octet_length("text") > F.length("text")  # characters outside ASCII
    worth = {"email": (at, F.col("text").rlike(rf"(?i){_AT} ?[)\]}}]|[ .)\]}}]{_DOT}[ )\]}}]") | (at & other)),
             "ip": (digits, digits & F.col("text").rlike(r"(?i)[0-9a-f]:[0-9a-f:]|[\[(](?:\.|dot)[\])]")),
             "card": (digits, digits), "phone": (F.col("text").contains("+"), digits)}
    names = []
    for k, kind in enumerate(KINDS):
        for w, pattern in enumerate((BASE[kind], WIDER[kind])):
            names.append(f"_s{2 * k + w}")
            df = with_matches(df, names[-1], "text", pattern, worth[kind][w], 2 * k + w)
    df = df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*names).alias("spans"))
    df = staged(spark, df, "pii-spans")
    s = df.select("rid", F.posexplode("spans").alias("pos", "s")).select("rid", "pos", "s.*")
    upto = Window.partitionBy("rid", "p").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    s = s.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # a wider match that is a base one (an address in ASCII) or has too few digits proposes nothing
    number = F.length(F.regexp_replace("m", "[^0-9]", "")).between(8, 15)
    plain = F.col("m").contains("@") & ~F.col("m").rlike("[^\\x00-\\x7F]")
    s = s.filter((F.pmod("p", F.lit(2)) == 0) | ((F.col("p") == 1) & ~plain) | ((F.col("p") == 7) & number)
                 | F.col("p").isin(3, 5))
    spans = s.select("rid", F.get(kinds, F.floor(F.col("p") / 2).cast("int")).alias("kind"),
                     (F.pmod("p", F.lit(2)) == 1).alias("wide"), "m", "before", "after", "start", "end")
    return df.select("rid", "doc_id"), spans


# --- rules and labelers ---------------------------------------------------------

def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(F.pmod(i, F.lit(2)) == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)
    return (F.length(digits) > 0) & (F.pmod(total, F.lit(10)) == 0)


def with_votes(spans: DataFrame) -> DataFrame:
    """Adds ``base`` (passes the base rule), ``check`` and ``votes``, a string of + - 0, one for each labeler."""
    kind, m = F.col("kind"), F.col("m")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    s = spans.withColumn("digits", digits)
    octets = m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    check = (F.when(kind == "card", F.when(n.between(13, 19), luhn(F.col("digits"))).otherwise(False))
              .when(kind == "ip", F.when(F.col("wide"), F.lit(True)).otherwise(octets))
              .when(kind == "phone", n.between(8, 15))
              .otherwise(m.rlike(rf"(?i)(?:\.|{_DOT} ?[)\]}}]?) ?[\p{{L}}]{{2,24}}$")))
    s = s.withColumn("check", check)
    rule = (F.when(kind == "email", True).when(kind == "card", n.between(16, 19) & F.col("check"))
             .otherwise(F.col("check")))
    s = s.withColumn("base", ~F.col("wide") & rule)

    def vote(plus: Column, minus: Column) -> Column:
        return F.when(plus, "+").when(minus, "-").otherwise("0")

    no = F.lit(False)
    before = F.lower("before")
    gazetteer = (
        F.when(kind == "email", vote(F.lower(m).rlike(rf"(?:\.|{_DOT} ?[)\]}}]?) ?(?:{_words(DOMAINS)})$"), F.col("wide")))
         .when(kind == "ip", vote(no, ~F.col("wide") & m.rlike(r"^(?:0|127|255)\.")))
         .when(kind == "card", vote(F.col("digits").rlike("^[3456]"), ~F.col("digits").rlike("^[3456]")))
         .otherwise(F.when(F.col("wide"), vote(F.col("digits").rlike("^0[1-9]"), no)).otherwise(
             vote(F.col("digits").rlike(f"^(?:{_words(CALLING_CODES)})"), F.col("digits").rlike("^0{2,}")))))
    cue = F.when(before.rlike(rf"\b(?:{_words(COUNTER_CUES)})[.:#]? *$"), "-")
    for k in KINDS:
        cue = cue.when((kind == k) & before.rlike(rf"\b(?:{_words(CUES[k])})\b"), "+")
    edge = vote(before.rlike(r"(?:^|[\s(<\[,;:\"'])$") & F.col("after").rlike(r"^(?:$|[\s)>\],;:.!?\"'])"),
                before.rlike(r"[\p{L}0-9]$") | F.col("after").rlike(r"^[\p{L}0-9]"))
    kinds_of_digit = F.size(F.array_distinct(F.split("digits", "")))
    variety = F.when(kind == "email", "0").otherwise(vote(kinds_of_digit >= 4, kinds_of_digit <= 2))
    date = m.rlike(r"^(?:19|20)[0-9]{2}[-./ ]?[01][0-9][-./ ]?[0-3][0-9]|^[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}")
    usual = F.col("digits").rlike("^(?:3[47][0-9]{13}|3[068][0-9]{12}|4[0-9]{12}|[3-6][0-9]{15})$")
    form = (F.when(kind == "phone", vote(m.rlike(r"[/()]|^0[0-9]+[\x20-]"), date | F.col("digits").rlike("^97[89]")
                                         | ~m.rlike("[^0-9]")))
             .when(kind == "card", vote(usual, ~usual))
             .when(kind == "email", vote(m.rlike(r"[(\[{@]"), no))
             .otherwise(vote(m.rlike(r"(?i)[a-f].*:|[\[(]"), no)))
    votes = F.concat(F.when(F.col("wide"), "0").otherwise(vote(F.col("base"), ~F.col("base"))),
                     vote(F.col("check"), ~F.col("check")), gazetteer, cue.otherwise("0"), edge, variety,
                     F.when(F.col("wide"), form).otherwise("0"))
    return s.withColumn("votes", votes)


# --- reliabilities by expectation-maximisation ----------------------------------

def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Posterior that a span is true, for each (kind, votes) with its count.

    One model a kind: labelers vote independently given the truth.  Starts from the
    majority of votes; counts are smoothed by one vote of each sort.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        post = {}
        for v, _ in rows:
            lead = v.count("+") - v.count("-")
            post[v] = 0.9 if lead > 1 else 0.1 if lead < 1 else 0.5
        for _ in range(rounds):
            true = sum(n * post[v] for v, n in rows)
            total = sum(n for _, n in rows)
            prior = (true + 1) / (total + 2)
            table = []
            for j in range(len(LABELERS)):
                t = {c: 1.0 for c in "+-0"}
                f = {c: 1.0 for c in "+-0"}
                for v, n in rows:
                    t[v[j]] += n * post[v]
                    f[v[j]] += n * (1 - post[v])
                st, sf = sum(t.values()), sum(f.values())
                table.append({c: log(t[c] / st) - log(f[c] / sf) for c in "+-0"})
            base = log(prior / (1 - prior))
            new = {v: 1 / (1 + exp(-max(-30.0, min(30.0, base + sum(table[j][c] for j, c in enumerate(v))))))
                   for v, _ in rows}
            moved = max(abs(new[v] - post[v]) for v in new)
            post = new
            if moved < 1e-7:
                break
        out.update({(kind, v): p for v, p in post.items()})
    return out


# --- the span classifier ----------------------------------------------------------

# Number of values of each feature; a tuple of all of them is a row of the training table.
FEATURES = {"wide": 2, "length": 4, "n_digits": 5, "word_before": 8, "char_after": 3, "gazetteer": 3, "cue": 3, "form": 3}
MAX_TUPLES = len(KINDS) * prod(FEATURES.values())


def vote_of(labeler: str) -> Column:
    """0, 1 or 2 for a vote of - 0 +."""
    c = F.substring("votes", 1 + LABELERS.index(labeler), 1)
    return F.when(c == "-", 0).when(c == "0", 1).otherwise(2)


def with_features(spans: DataFrame) -> DataFrame:
    n, d = F.length("m"), F.length("digits")
    word = F.regexp_extract(F.lower("before"), r"([\p{L}]+)[^\p{L}]*$", 1)
    step = lambda c, *at: sum((c >= a).cast("int") for a in at)
    return (spans.withColumn("f_wide", F.col("wide").cast("int"))
                 .withColumn("f_length", step(n, 12, 17, 25))
                 .withColumn("f_n_digits", step(d, 3, 8, 11, 16))
                 .withColumn("f_word_before", F.when(word == "", 0).otherwise(
                     1 + F.pmod(F.crc32(word.cast("binary")), F.lit(7))).cast("int"))
                 .withColumns({f"f_{name}": vote_of(name) for name in ("gazetteer", "cue", "form")})
                 .withColumn("f_char_after", F.when(F.col("after") == "", 0)
                             .when(F.col("after").rlike(r"^[\p{L}0-9]"), 1).otherwise(2)))


def train_spans(rows: list[dict], rounds: int = 200, rate: float = 1.0, l2: float = 0.01) -> dict[str, dict]:
    """Weights by kind of a logistic model; each row has the features, ``true`` and ``n``."""
    model = {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        w = {f: [0.0] * size for f, size in FEATURES.items()}
        bias, total = 0.0, sum(r["n"] for r in own) or 1
        for _ in range(rounds if own else 0):
            g, gb = {f: [-l2 * x for x in v] for f, v in w.items()}, 0.0
            for r in own:
                z = bias + sum(w[f][r[f]] for f in FEATURES)
                e = (r["true"] - r["n"] / (1 + exp(-max(-30.0, min(30.0, z))))) / total
                gb += e
                for f in FEATURES:
                    g[f][r[f]] += e
            bias += rate * gb
            for f in FEATURES:
                w[f] = [x + rate * d for x, d in zip(w[f], g[f])]
        model[kind] = {"bias": bias, **w}
    return model


def span_score(model: dict[str, dict]) -> Column:
    out = None
    for kind, w in model.items():
        z = F.lit(w["bias"])
        for f in FEATURES:
            z = z + F.get(F.array(*[F.lit(x) for x in w[f]]), F.col(f"f_{f}"))
        p = 1 / (1 + F.exp(-z))
        out = F.when(F.col("kind") == kind, p) if out is None else out.when(F.col("kind") == kind, p)
    return out


def _group(kind: Column, wide: Column) -> Column:
    return F.concat(kind, F.when(wide, ":wide").otherwise(":base"))


def candidate_table(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents; all candidate spans with votes and features, written once)."""
    rows, spans = candidates(spark, docs)
    return rows, staged(spark, with_features(with_votes(spans)), "pii-votes")


def fit_spans(spark: SparkSession, spans: DataFrame) -> dict[str, dict]:
    """The span classifier: labelers' reliabilities from all candidates, then weights from their posteriors."""
    group = _group(F.col("kind"), F.col("wide")).alias("group")
    counts = spans.groupBy(group, "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    post = reliabilities([(r["group"], r["votes"], r["n"]) for r in counts])
    table = spark.createDataFrame([(k, v, p) for (k, v), p in post.items()] or [("", "", 0.0)],
                                  "group string, votes string, p double")
    feats = [F.col(f"f_{f}").alias(f) for f in FEATURES]
    train = (spans.withColumn("group", group).join(F.broadcast(table), ["group", "votes"]).groupBy("kind", *feats)
                  .agg(F.sum("p").alias("true"), F.count(F.lit(1)).alias("n")).collect())
    return train_spans([r.asDict() for r in train])


def personal_data(spark: SparkSession, docs: DataFrame, model: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: rid, doc_id; spans: rid, kind, start, end, m, base): base spans and added ones.

    Without a ``model`` (of :func:`fit_spans`) it is fitted to these documents.
    """
    rows, spans = candidate_table(spark, docs)
    model = model or fit_spans(spark, spans)
    keep = spans.withColumn("p", span_score(model))
    keep = keep.filter(F.col("base") | (F.col("wide") & F.col("check") & (F.col("p") >= ADD_FROM)))
    # additions give way to base spans and to additions that begin earlier
    by_start = Window.partitionBy("rid").orderBy("start", F.col("base").desc(), F.col("p").desc(), "end", "kind")
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    later = by_start.rowsBetween(1, Window.unboundedFollowing)
    keep = (keep.withColumn("reach", F.max("end").over(earlier))
                .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(later))
                .filter(F.col("base") | ((F.coalesce("reach", F.lit(0)) <= F.col("start"))
                                         & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))))
    return rows, keep.select("rid", "kind", "start", "end", "m", "base")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, spans = personal_data(spark, docs)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct(order.alias("k"), "start", "end", name.alias("name"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["name"]), ",")
    by_doc = spans.groupBy("rid").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        listed(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"),
        listed(F.collect_list(item)).alias("spans"))
    out = rows.join(by_doc, "rid", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"))
