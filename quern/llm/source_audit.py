"""How far the sources of a language differ in the words they use (operator 11); plain relational.

1. Terms are regexp matches of a text, exploded: all of them for counts, each once for the number of documents. They are
   counted by (lang, source, term), combined before the shuffle, and written.
2. A language keeps the terms of at least ``MIN_DOCS`` of its documents.
3. Groups (lang, source) are crossed with the kept terms of their language, which fills in zeros. Terms are dealt out by a
   salt, so a language of most of the rows is spread over all tasks.
4. Smoothed shares in parts of ``SCALE``, in whole numbers: p of a group, q of its language.
5. Pairs of sources: a self-join on lang and term, each pair once, summed as it is joined. Terms: those that a group uses
   more than its language.
6. Ranks inside each group; those of terms stop at ``TOP``, which Spark applies before the shuffle too.

Defined results: null text, lang and source are empty strings; a text without matches counts for its group alone. A
language without kept terms gives each pair of its sources the value 0 and no terms. A source without another in its
language has no pairs. Ties go by the item's UTF-8 bytes. doc_id isn't read, so null or repeated ones don't matter and
repeated rows count again; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import docs_of, written

#: Fixed value: what counts as a term, once A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, SMOOTH, TOP = 30, 5, 50
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have the term) of the columns lang, source and text."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    # Bound once: the matches and, beside them, each of them once.
    both = F.get(F.transform(F.array(found), lambda t: F.array(t, F.array_distinct(t))), F.lit(0))
    lists = docs.select("lang", "source", F.posexplode(both).alias("once", "terms"))
    terms = lists.select("lang", "source", "once", F.explode("terms").alias("term"))
    return terms.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("docs"))


def smoothed(n: str, total: str, terms: str, smooth: int = SMOOTH) -> Column:
    """1 + floor(SCALE * (n + smooth) / (total + smooth * terms)), exact for any long."""
    return F.expr(f"1 + ((cast({n} as decimal(20, 0)) + {smooth}) * {SCALE}) div (cast({total} as decimal(20, 0)) + {smooth} * cast({terms} as decimal(18, 0)))")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smooth: int = SMOOTH, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module."""
    spark = docs.sparkSession
    rows = docs_of(docs, "text", "lang", "source").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(term_counts(rows))
    vocabulary = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))

    langs = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    used = counts.select("lang", "source", "term", "n").join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = written(groups.na.fill(0, ["lang_total", "terms", "total"]))

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.where("terms > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cells = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(dealt, ["lang", "salt"]).drop("salt")
    cells = cells.join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    cells = written(cells.select("lang", "source", "term", "n", smoothed("n", "total", "terms", smooth).alias("p"), smoothed("lang_n", "lang_total", "terms", smooth).alias("q")))

    x, y = (cells.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("a", "pa"), ("b", "pb")))
    sums = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    bare = groups.where("terms = 0")
    bare = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    turned = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.unionByName(bare).select("lang", turned, "value")

    terms = cells.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(name)) for name, part in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
