"""Line dedup over overlapping three-line windows, with DataFrame functions
alone: windows of consecutive lines are hashed, windows that occur again
anywhere are found, and the lines that later occurrences cover go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import rows_of, store

#: A window is hot that has over one in so many of the occurrences of all that
#: repeat; fewer than this number are, which bounds what is broadcast.
HOT = 1000

#: A line that counts: one with a word. Blank lines neither count nor break a window.
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _counted(lines: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """``_id, _t, _at, _h1, _h2`` per window: the document (id and text hash),
    the window's first counted line, and 128 bits of hash of its lines."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), _lines(F.col("text")).alias("_lines"))
    lines = lines.select("_id", "_t", F.filter("_lines", lambda x: x.rlike(_WORD)).alias("_lines")).where(F.size("_lines") >= size)

    def window(i: Column) -> Column:
        part = [F.get("_lines", i + k) for k in range(size)]
        return F.struct(i.alias("at"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(size), *reversed(part)).alias("h2"))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("_lines") - size), window))
    return lines.select("_id", "_t", each.alias("_w")).select("_id", "_t", F.col("_w.at").alias("_at"), F.col("_w.h1").alias("_h1"), F.col("_w.h2").alias("_h2"))


def _place() -> Column:
    """Order of occurrences: by id (null last), text hash, position."""
    return F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_t").alias("t"), F.col("_at").alias("at"))


def _later(occur: DataFrame) -> DataFrame:
    """The occurrences after the first one of their window.

    Finding the first one combines map-side. A window that over a HOT-th of
    all occurrences have would meet in one task when these are joined back:
    there are fewer than HOT such windows, so those are broadcast.
    """
    first = occur.groupBy(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2")).agg(F.min(_place()).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = store(first, "line-repeats")
    total = first.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * HOT > total
    same = (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    few = F.broadcast(first.where(hot))
    rest = occur.join(few.select("_k1", "_k2"), same, "left_anti").join(first.where(~hot), same)
    return occur.join(few, same).unionByName(rest).where(_place() > F.col("_first"))


def deduped(docs: DataFrame, size: int = 3) -> DataFrame:
    """``_row`` (struct of all columns of ``docs``, whatever their names) and
    ``_lines`` (struct of n_lines, n_removed, text): the document's lines and
    what is left of them.

    The first occurrence of a window, by document id, text hash and position,
    stays; the lines that any later one covers go, overlapping windows merged.
    Texts of fewer than ``size`` lines with a word stay as they are; a null
    text has one empty line and stays null; of rows with one id the text hash
    decides, and fully repeated rows are one document and come out alike. An
    empty table gives an empty one.
    """
    later = _later(store(windows(docs, size), "line-windows"))
    cover = later.groupBy(F.col("_id").alias("_cid"), F.col("_t").alias("_ct")).agg(F.collect_set("_at").alias("_starts"))
    joined = rows_of(docs).join(cover, F.col("_row.doc_id").eqNullSafe(F.col("_cid")) & (F.xxhash64("_row.text") == F.col("_ct")), "left")
    split = joined.withColumn("_l", _lines(F.col("_row.text"))).withColumn("_c", F.when(F.col("_starts").isNotNull(), _counted(F.col("_l"))))
    gone = F.flatten(F.transform("_starts", lambda s: F.slice(F.col("_c"), s + 1, F.lit(size))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone)
    split = split.withColumn("_left", F.when(F.col("_starts").isNotNull(), left))
    text = F.when(F.col("_starts").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_l", i)), "\n"))
    n = F.size("_l").cast("long")
    removed = F.when(F.col("_starts").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("_left"))
    return split.select("_row", F.struct(n.alias("n_lines"), removed.alias("n_removed"), text.alias("text")).alias("_lines"))


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """All columns of ``docs`` and ``_lines``, see :func:`deduped`. A column of
    ``docs`` that has that name already gives way to the result."""
    found = deduped(docs, size)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "_lines"), "_lines")
