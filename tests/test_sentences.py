"""The learned splitter on texts with planted abbreviations."""

import random

from codequarry.operators import sentences as S


def corpus(n=800, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("kar", "lo", "mi", "ten", "so", "vel") for b in ("ta", "rin", "po", "shan")]
    docs = []
    for i in range(n):
        first = [r.choice(words) for _ in range(r.randrange(3, 9))]
        if i % 2:
            first.insert(r.randrange(1, len(first)), r.choice(["Dr.", "e.g.", "bzw.", "No."]) + " " + r.choice(words))
        sentence = " ".join(first) + r.choice([".", "!", "?", '."'])
        docs.append((i, sentence, sentence + " " + " ".join(r.choice(words) + r.choice(["", "", "", "."]) for _ in range(30)) + "."))
    return docs


def test_planted_abbreviations_are_learned_and_do_not_end_sentences(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    learned = S.abbreviations(df)
    assert {r.type for r in learned.collect()} == {"dr", "e.g", "bzw", "no"}
    got = {r.doc_id: r.sentence for r in S.first_sentences(df, learned).collect()}
    assert got == {i: s for i, s, _ in docs}
    none = S.first_sentences(df, learned.limit(0)).collect()
    assert sum(r.sentence != docs[r.doc_id][1] for r in none) > 300  # without them the sentences end too early


def test_defined_results(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  no end\there "), (4, "One. Two."), (None, "x. y"), (None, "z! y"),
                                (4, "One. Two.")], "doc_id long, text string")
    got = sorted(map(tuple, S.first_sentences(df, S.abbreviations(df)).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "no end here"), (4, "One."), (4, "One."), (None, "x."), (None, "z!")], key=str)
    assert S.first_sentences(df.limit(0), S.abbreviations(df.limit(0))).count() == 0
