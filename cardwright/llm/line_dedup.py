"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_filter, materialise, may_hold, release

WINDOW = 3


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """(d, t, pos, h1, h2) of every window of consecutive lines; d and t name the document."""
    lines = F.col("lines")
    at = lambda i: [F.get(lines, i + j) for j in range(WINDOW)]
    return docs.filter(F.size(lines) >= WINDOW).select(
        "d", "t",
        F.inline(F.transform(
            F.sequence(F.lit(0), F.size(lines) - WINDOW),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(*at(i)).alias("h1"), F.hash(*at(i)).alias("h2")),
        )),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without the removed lines) per row.

    Lines are what newlines separate, compared as they are. Every run of three
    consecutive lines is a window. Of equal windows in all texts the first, by
    doc_id (null first) and position, stays; the lines that any later one
    covers are removed, so overlapping windows merge into one removed passage
    and of every line at least one occurrence stays. Texts of fewer than three
    lines have no window and stay whole; null stays null with no lines. Rows
    that repeat both doc_id and text count as one document and stay alike;
    rows that repeat a doc_id with other text are told apart by the text's
    hash. An empty table gives an empty result. Other columns are not read.

    Windows are cut once and written as two hashes (96 bits), on which equality
    rests; lines are not compared again. Counts and first places are summed on
    the map side, and the table of windows is joined to the first places, so a
    window that a third of all texts hold is a skewed key that the join splits.
    Of the texts only those cross the network that a filter of key hashes cannot
    tell to be untouched.
    """
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col("text"))
    # Both sides of the join are read from tables, so that adaptive execution may split a hot window.
    windows = materialise(_windows(keyed.withColumn("lines", _lines())), "windows")
    repeated = materialise(
        windows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "pos")).alias("first"))
        .filter("n > 1").select("h1", "h2", "first"),
        "repeated-windows",
    )
    later = windows.join(repeated, ["h1", "h2"]).filter(~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
    covered = materialise(
        later.select("d", "t", F.explode(F.array(*[F.col("pos") + j for j in range(WINDOW)])).alias("pos"))
        .groupBy("d", "t").agg(F.collect_set("pos").alias("covered")),
        "covered-lines",
    )
    release(windows, repeated)
    # Texts whose hash falls in no cell of the covered ones need not move; only the others meet their covered lines.
    hit = may_hold(key_filter(covered, F.col("t")), F.col("t"))
    marked = keyed.withColumn("mark", hit)
    hit = F.col("mark")
    left, right = marked.filter(hit).drop("mark").alias("l"), covered.alias("r")
    joined = left.join(right, (F.col("l.t") == F.col("r.t")) & F.col("l.d").eqNullSafe(F.col("r.d")), "left").select("l.d", "l.text", "covered")
    both = joined.unionByName(marked.filter(~hit).select("d", "text", F.lit(None).cast("array<int>").alias("covered"))).withColumn("lines", _lines())
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    return both.select(
        F.col("d").alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")).alias("text"),
    )
