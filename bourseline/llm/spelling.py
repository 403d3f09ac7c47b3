"""Spelling variants: words that differ by one letter, without pairs of words.

Two words that differ by one replaced letter agree in (place, prefix, suffix),
so each word joins one group for each of its places.  A group needs only its
size and its two best words: every member is near all others of the group, and
the best of the others is the first word or, for the first word itself, the
second.  Two words that differ by an inserted or deleted letter meet where the
longer one, less one letter, is in the vocabulary.  A group of either kind is
bounded by the alphabet: a word has one neighbour for each letter at a place.
Sums and best words of the groups are then combined for each word.

Words: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with only A-Z lower-cased.
Every 31st occurrence by hash loses a letter, which plants misspellings.  The
best of several words is that of largest count, then the first in the order of
code points.  No table is broadcast: a table of words is small as a file and
many times that as rows, and Spark does not count what an explode adds.  A null
text has no words; a null doc_id is written as nothing.  Rows that repeat a
doc_id and its text count again.  An empty table gives an empty one.  Only
``doc_id`` and ``text`` are read; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Stands for the replaced letter; no word has it.
HOLE = "*"


def _without(word: Column, at: Column) -> Column:
    """A word without its letter at a place, counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def occurrences(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """``word`` of each occurrence of at least ``least`` letters, misspelt where ``every`` divides its hash."""
    run = F.explode(F.regexp_extract_all(text_or_empty(), F.lit(LETTERS + "{%d,}" % least), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    lower = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    word = F.when(F.col("h") % every == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int") + 1)).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """``word, n``: words that occur at least ``times``."""
    return occurrences(docs, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _places(key: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), key)).alias("key")


def _rank() -> Column:
    """Least for the word of largest count, then the first in code-point order (UTF-8 keeps that order)."""
    return F.struct((-F.col("n")).alias("less"), "word")


def replaced(words: DataFrame) -> DataFrame:
    """``word, near, best`` from groups with a hole at one place."""
    hole = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(HOLE), F.substring("word", i + 1, F.length("word")))
    rows = words.select(_rank().alias("own"), _places(hole))
    group = Window.partitionBy("key")
    ranked = group.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rows.select("own", (F.count("*").over(ranked) - 1).alias("near"), F.first("own").over(ranked).alias("first"), F.nth_value("own", 2).over(ranked).alias("second"))
    other = F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return met.filter("near > 0").select(F.col("own.word").alias("word"), "near", other.alias("best"))


def shortened(words: DataFrame) -> DataFrame:
    """``word, near, best`` from words that another word becomes by losing a letter, for both of them."""
    losing = words.select(_rank().alias("own"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: _without(F.col("word"), i)))).alias("key"))
    whole = words.select(F.col("word").alias("key"), _rank().alias("short"))
    met = stored(losing.join(whole.hint("merge"), "key"), "shortened")
    longer = met.select(F.col("own.word").alias("word"), F.lit(1).cast("long").alias("near"), F.col("short").alias("best"))
    shorter = met.groupBy("key").agg(F.count("*").alias("near"), F.min("own").alias("best"))
    return longer.unionByName(shorter.withColumnRenamed("key", "word"))


def neighbours(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near words' number, and the best one if it is ``times`` as frequent."""
    parts = replaced(words).unionByName(shortened(words)).withColumn("n", F.lit(None).cast("long"))
    own = words.select("word", F.lit(0).cast("long").alias("near"), F.lit(None).cast(parts.schema["best"].dataType).alias("best"), "n")
    sums = parts.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    ruled = -F.col("best.less") >= times * F.col("n")
    return sums.select("word", "n", "n_near", F.when(ruled, F.col("best.word")).alias("form"), F.when(ruled, -F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``: the last of the forms that lead on from a word.  Each form is more frequent than its word, so the way ends."""
    step = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    roots = step
    while True:  # each round doubles the steps taken
        on = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge"), "root", "left")
        further = stored(on.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            break
        roots = further.drop("moved")
    return forms.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_forms(docs: DataFrame) -> DataFrame:
    """Every word with its form and root: ``word, form, root, n, n_near, form_n``."""
    words = stored(vocabulary(docs), "vocabulary")
    return with_roots(stored(neighbours(words), "neighbours")).select("word", "form", "root", "n", "n_near", "form_n")


def respelled(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """``doc_id, word, root, times``: the words of each document that a root replaces, to mend texts with."""
    changes = forms.filter("root <> word").select("word", "root")
    run = F.explode(F.regexp_extract_all(text_or_empty(), F.lit(LETTERS + "+"), F.lit(0)))
    own = docs.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    return own.groupBy("doc_id", "word").agg(F.count("*").alias("times")).join(changes.hint("merge"), "word").select("doc_id", "word", "root", "times")
