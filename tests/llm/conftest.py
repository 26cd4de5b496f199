import pytest

# One odd table for every document operator: NULLs, empty and blank texts, ties, repeated rows,
# a long text without spaces, and columns whose names clash with working columns.
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _row string, size int, "
              "key string, kept boolean, score double, node string")


def odd_rows():
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = [None, "", "  \n\t ", prose, prose, " " + prose.replace(" ", "\n") + " ", "x" * 30_000,
             ("word " * 4000).strip(), "é😀 ñ 中文 </s> <|endoftext|> end", "one two", "one two",
             "mail a.b@c.example.com or +1 (553) 555-7953, 4111 1111 1111 1111 at 10.0.0.1"]
    rows = [(i, t, None if i % 4 == 0 else "en", [None, "a", "b", ""][i % 4], None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose, None, None, None), (None, None, None, None, None)]
    return [r + ("r", 1, "k", True, 0.5, "n") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], ODD_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
