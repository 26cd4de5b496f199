"""identifiers(code) in SQL against the rewrite job."""

from pyspark.sql import functions as F

from codequarry.operators import rewrite as RW
from codequarry.operators import table_functions as TF

CODES = ["def f(a, b=1):\n    c = a + b\n    return len(c)\n", "class A:\n    def g(self):\n        return [x for x in self.y]\n",
         "import os\nfor i in range(3):\n    print(os, i)\n", "def broken(:\n", "", None]


def test_lateral_equals_the_job(spark):
    codes = spark.createDataFrame(list(enumerate(CODES)), "id int, code string")
    got = TF.identifiers(codes, "id")
    job = RW.rewrite_distinct(codes.filter("code IS NOT NULL"), "code")
    want = (codes.join(job, F.md5("code") == F.col("code_key")).select("id", F.explode("idents").alias("i")).select("id", "i.*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["id"] for r in got.collect()} == {0, 1}  # imports and names of the module stay, the others do not parse or are empty


def test_in_sql(spark):
    TF.register(spark)
    spark.createDataFrame([(1, "x = y")], "id int, code string").createOrReplaceTempView("codes_in_sql")
    rows = spark.sql("SELECT id, i.name FROM codes_in_sql c, LATERAL identifiers(c.code) i").collect()
    assert ("x" in {r["name"] for r in rows}) == ("x" in {i["name"] for i in RW.rewrite_code("x = y", "k")["idents"]})
    assert spark.sql("SELECT * FROM identifiers('def q(w): pass')").count() == 2
