"""Contamination: which reference texts occur in which documents.

Texts are compared by their words (runs of letters and digits, lower case):
a reference occurs in a document where its words stand in a row.  Documents
and references are never paired to find out.  Instead:

1. every reference is cut into grams of ``GRAM`` words (one gram of all its
   words if it has fewer), and the documents' grams that are among them are
   counted;
2. each reference is looked up by its rarest gram alone.  One whose rarest
   gram occurs nowhere is done; a gram that a third of all documents share
   is used only by references that have no rarer one;
3. the documents' grams join these chosen ones, which gives candidates
   (document, reference, place), and each candidate's words are compared.

A document's grams are 64-bit hashes made where the text lies; only those
that meet a reference's gram leave the scan, if the references' grams are
few enough to be broadcast (``BROADCAST_GRAMS``, counted first).  Beyond
that the join is shuffled and Spark splits hot grams.  Texts are moved for
candidate documents alone.

Defined results: a reference without words occurs nowhere; NULL texts have
no words; rows that repeat id and text count once; a NULL id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persisted

GRAM = 5
BROADCAST_GRAMS = 1_000_000  # 16 bytes each


def compared_words(text: Column) -> Column:
    """The words of a text as it is compared."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _grams(hashes: Column, size: int) -> Column:
    """The grams of ``size`` words as array<long>, from the words' hashes."""
    places = F.sequence(F.lit(0), F.size(hashes) - size)
    gram = lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + j) for j in range(size)])
    return F.when(F.size(hashes) >= size, F.transform(places, gram)).otherwise(F.array().cast("array<bigint>"))


def _side(few: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few else df


def contamination(documents: DataFrame, references: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                  ref_key: str = "item_id", ref_text: str = "text", gram: int = GRAM,
                  broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_key, ref_key, first_word): every pair where the reference occurs, and where it first does.

    ``first_word`` counts the document's words before it.
    """
    refs = references.select(F.col(ref_key).alias("_ref"), compared_words(F.col(ref_text)).alias("_words"))
    refs = refs.filter(F.size("_words") > 0).withColumn("_rid", F.md5(F.array_join("_words", " ")))
    refs = persisted(refs, "references")
    distinct = refs.groupBy("_rid").agg(F.first("_words").alias("_words"))
    size = F.least(F.size("_words"), F.lit(gram))
    sizes = sorted(r[0] for r in distinct.select(size).distinct().collect())  # at most ``gram`` numbers

    def cut(df: DataFrame, keep: list[str], own: bool) -> DataFrame:
        """(keep, _at, _gram): grams of each size in use; of a reference (``own``) those of its own size."""
        df = df.select(*keep, "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
        lists = [F.when(size == s, _grams(F.col("_h"), s)) if own else _grams(F.col("_h"), s) for s in sizes]
        each = df.select(*keep, F.explode(F.array(*lists)).alias("_g"))
        return each.select(*keep, F.posexplode("_g").alias("_at", "_gram"))

    if not sizes:
        return documents.select(doc_key).limit(0).join(references.select(ref_key).limit(0), F.lit(False)).select(
            doc_key, ref_key, F.lit(0).cast("long").alias("first_word"))
    ref_grams = persisted(cut(distinct, ["_rid"], True), "reference-grams")
    wanted = ref_grams.select("_gram").distinct()
    few = wanted.count() <= broadcast_grams
    docs = documents.select(F.col(doc_key).alias("_doc"), F.md5(F.coalesce(doc_text, F.lit(""))).alias("_dg"),
                            compared_words(F.col(doc_text)).alias("_words"))
    # all meetings of documents and references' grams: what both following steps need
    met = persisted(cut(docs, ["_doc", "_dg"], False).join(_side(few, wanted), "_gram"), "gram-meetings")
    count = met.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = ref_grams.join(count, "_gram", "left").groupBy("_rid").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_at", "_gram")).alias("_b")).filter("_b.n > 0")
    chosen = rarest.select("_rid", F.col("_b._at").alias("_off"), F.col("_b._gram").alias("_gram"))
    hits = met.join(_side(few, chosen), "_gram").filter("_at >= _off")
    hits = hits.select("_doc", "_dg", "_rid", (F.col("_at") - F.col("_off")).alias("_start")).distinct()
    hits = persisted(hits, "candidates")
    # the words of a candidate are compared where its document's text is
    near = hits.join(distinct.withColumnRenamed("_words", "_ref_words"), "_rid")
    keyed = near.select(F.col("_doc").alias("_d"), F.col("_dg").alias("_g"), "_rid", "_start", "_ref_words")
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_dg") == F.col("_g"))
    exact = F.slice("_words", F.col("_start") + 1, F.size("_ref_words")) == F.col("_ref_words")
    found = docs.join(keyed, same).filter(exact).groupBy("_doc", "_dg", "_rid").agg(F.min("_start").alias("_start"))
    return (found.join(refs.select("_rid", "_ref"), "_rid")
                 .groupBy(F.col("_doc").alias(doc_key), F.col("_ref").alias(ref_key), "_dg")
                 .agg(F.min("_start").cast("long").alias("first_word")).drop("_dg"))
