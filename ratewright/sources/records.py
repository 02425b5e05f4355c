"""Record structure of a CSV file, read as text: an independent look at what the loader saw.

A quoted field may hold line breaks, so a line is not yet a record, and whether a line
starts inside quotes depends on every quote before it. Each scan block reports its lines
and quotes; running totals over these few block rows then tell every block where it
stands. No task reads more than one block of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratewright.session import land

_BLOCK = ["file", "block"]


def _count_of(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("bigint")


def _line_facts(text: Column) -> Column:
    """Separators outside quotes, and whether the first or last field is empty."""
    plain = F.regexp_replace(text, '"[^"]*("|$)', "q")  # every quoted stretch becomes a q
    return F.struct(
        _count_of(plain, ",").alias("commas"),
        (
            plain.startswith(",")
            | (plain == "")
            | (plain.rlike("^q(,|$)") & text.rlike('^""(,|$)'))
        ).alias("empty_first"),
        (
            plain.endswith(",")
            | (plain == "")
            | (plain.rlike("(^|,)q$") & text.rlike('(^|,)""$'))
        ).alias("empty_last"),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.col("value")
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.pmod(_count_of(text, '"'), F.lit(2)).alias("odd"),
        (text == "").alias("bare"),
        _line_facts(text).alias("from_outside"),
        _line_facts(F.concat(F.lit('"'), text)).alias("from_inside"),
    )


def _of_one_line(lines: DataFrame) -> DataFrame:
    """``records`` of a file whose quotes are even in number on every line. A block's lines lie
    together in one task, so a line's number in it is its distance from the first."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        lines.groupBy(*_BLOCK)
        .agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
        .withColumn("lines_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select(*_BLOCK, "first_at", "lines_before")
    )
    line = F.col("lines_before") + F.col("at") - F.col("first_at") + 1
    return (
        lines.join(F.broadcast(blocks), _BLOCK)
        .withColumn("line", line)
        .filter(~F.col("bare") & (F.col("line") > 1))
        .select(
            "file",
            F.col("line").alias("record"),
            F.col("line").alias("first_line"),
            F.lit(1).cast("bigint").alias("n_lines"),
            (F.col("from_outside.commas") + 1).alias("n_fields"),
            F.col("from_outside.empty_first").alias("empty_first"),
            F.col("from_outside.empty_last").alias("empty_last"),
        )
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record after the header: file, record number, first line, lines, fields,
    and whether the first or last field is empty. Bare lines are no records."""
    read = _lines(spark, path)
    if read.filter("odd = 1").isEmpty():
        return _of_one_line(read)
    in_block = W.partitionBy(*_BLOCK).orderBy("at")
    lines = (
        read.withColumn(
            "odd_above",
            F.coalesce(
                F.sum("odd").over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("even", 1 - F.pmod("odd_above", F.lit(2)))
        .withColumn("nth", F.row_number().over(in_block))
        .withColumn("even_upto", F.sum("even").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    )
    # A line opens a record when the quotes before it are even in number.
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        lines.groupBy(*_BLOCK)
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("odd").alias("n_odd"),
            F.sum("even").alias("n_even"),
        )
        .withColumn("lines_before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
        .withColumn("flipped", F.pmod(F.coalesce(F.sum("n_odd").over(earlier), F.lit(0)), F.lit(2)))
        .withColumn(
            "n_opens",
            F.when(F.col("flipped") == 0, F.col("n_even")).otherwise(
                F.col("n_lines") - F.col("n_even")
            ),
        )
        .withColumn("opens_before", F.coalesce(F.sum("n_opens").over(earlier), F.lit(0)))
        .select(*_BLOCK, "lines_before", "flipped", "opens_before")
    )
    inside = F.pmod(F.col("flipped") + F.col("odd_above"), F.lit(2)) == 1
    opens_upto = F.when(F.col("flipped") == 0, F.col("even_upto")).otherwise(
        F.col("nth") - F.col("even_upto")
    )
    return (
        lines.join(blocks, _BLOCK)
        .select(
            "file",
            (F.col("lines_before") + F.col("nth")).alias("line"),
            (F.col("opens_before") + opens_upto).alias("record"),
            inside.alias("inside"),
            (F.col("bare") & ~inside).alias("bare"),
            F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside")).alias("facts"),
        )
        .filter(~F.col("bare"))
        .groupBy("file", "record")
        .agg(
            F.min("line").alias("first_line"),
            F.count(F.lit(1)).alias("n_lines"),
            (F.sum("facts.commas") + 1).alias("n_fields"),
            F.max(~F.col("inside") & F.col("facts.empty_first")).alias("empty_first"),
            F.max_by("facts.empty_last", "line").alias("empty_last"),
        )
        .filter(F.col("record") > 1)
    )


def record_structure(found: DataFrame) -> DataFrame:
    """Field counts of ``records`` and, per count, how many records are of several lines or
    lack their first or last field."""
    return found.groupBy("n_fields").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col("n_lines") > 1).alias("n_multi_line"),
        F.count_if(F.col("empty_first") | F.col("empty_last")).alias("n_suspect"),
    )


def suspect_records(found: DataFrame) -> DataFrame:
    """Where to look: records whose first or last field is empty."""
    return found.filter(F.col("empty_first") | F.col("empty_last")).select(
        "file", "record", "first_line", "n_fields", "empty_first", "empty_last"
    )


def torn_pairs(found: DataFrame, expected: int) -> DataFrame:
    """Halves of records that a line break cut in two: neighbouring records of ``records`` that are
    both too short and together have ``expected`` fields, or one more where the break fell inside a
    field. File, both first lines and field counts, and whether the pair is ``sure``: no half of it
    fits another neighbour too. Nothing is repaired.

    Only short records are compared, each with the record of the next number, wherever in the file
    a task's share ends. They are written once, so that the file is not read again for either half.
    """
    short = land(
        found.filter(F.col("n_fields") < expected).select("file", "record", "first_line", "n_fields"), "short-records"
    )
    left = short.select(
        "file", "record", F.col("first_line").alias("left_line"), F.col("n_fields").alias("left_fields")
    )
    right = short.select(
        "file",
        (F.col("record") - 1).alias("record"),
        F.col("first_line").alias("right_line"),
        F.col("n_fields").alias("right_fields"),
    )
    together = F.col("left_fields") + F.col("right_fields")
    pairs = left.join(right, ["file", "record"]).filter(together.isin(expected, expected + 1))
    # a half in two pairs: the pair before or after shares a record with this one
    beside = pairs.select("file", F.explode(F.array(F.col("record") - 1, F.col("record") + 1)).alias("record")).distinct()
    return pairs.join(beside.withColumn("_beside", F.lit(True)), ["file", "record"], "left").select(
        "file", "left_line", "right_line", "left_fields", "right_fields", F.col("_beside").isNull().alias("sure")
    )
