"""Overlapping line windows, and the gaps that spans leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import is_blank, joined, lines_of


def line_windows(df: DataFrame, text_col: str = "text", size: int = 60, overlap: int = 10) -> DataFrame:
    """One row for each window of ``size`` lines, a new one every ``size - overlap`` lines, the
    last being the first that reaches the end, with its number ``ord`` in the text. Blank windows
    are left out (and not numbered) before the rows are made, so nothing is shuffled."""
    step = max(size - overlap, 1)
    lines = df.withColumn("_lines", lines_of(F.col(text_col))).withColumn("_n", F.size("_lines")).filter("_n > 0")
    lines = lines.withColumn("_solid", F.transform("_lines", lambda x: ~is_blank(x)))
    last = lambda s: (s == 1) | (s - step + size - 1 < F.col("_n"))
    solid = lambda s: F.exists(F.slice(F.col("_solid"), s, F.lit(size)), lambda x: x)
    starts = F.filter(F.sequence(F.lit(1), F.col("_n"), F.lit(step)), lambda s: last(s) & solid(s))
    out = lines.select("*", F.posexplode(starts).alias("ord", "start_line"))
    out = out.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("_n")))
    return out.withColumn("chunk_text", joined(F.col("_lines"), F.col("start_line"), F.col("end_line"))).drop("_lines", "_n", "_solid")


def gaps(spans: DataFrame, keys: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """What the spans (start, end) of each group leave free between ``first`` and ``last``."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    seen = spans.withColumn("_from", F.greatest(F.coalesce(before + 1, F.col(first)), F.col(first)))
    between = seen.filter(F.col("start") > F.col("_from")).select(*keys, F.col("_from").alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    ends = spans.groupBy(*keys).agg(F.max("end").alias("_e"), F.max(last).alias("_l"), F.max(first).alias("_f"))
    tail = ends.withColumn("_from", F.greatest(F.col("_e") + 1, F.col("_f"))).filter("_from <= _l").select(*keys, F.col("_from").alias("gap_start"), F.col("_l").alias("gap_end"))
    return between.unionByName(tail)
