"""Co-change counts over a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.history import jaccard_percent


def pair_counts(commits: DataFrame, suffix: str = "cwl") -> DataFrame:
    """file1, file2, co: a running count for a stream of commits (id, changed_files); in ``update`` or ``complete`` mode.

    A commit arrives whole, so pairs are made from its own row and the only state is a count for each pair.
    """
    files = F.array_distinct(F.filter("changed_files", lambda f: f.endswith(suffix)))
    sets = commits.select(files.alias("files")).where(F.size("files") >= 2)
    pairs = sets.select("files", F.explode("files").alias("file1")).select("file1", F.explode("files").alias("file2")).where("file1 >= file2")
    return pairs.groupBy("file1", "file2").agg(F.count(F.lit(1)).alias("co"))


def percentages(counts: DataFrame) -> DataFrame:
    """file1, file2, co, pct of counts as a table."""
    own = counts.where("file1 = file2").select(F.col("file1").alias("file"), F.col("co").alias("n"))
    both = counts.join(own.select(F.col("file").alias("file1"), F.col("n").alias("n1")), "file1").join(own.select(F.col("file").alias("file2"), F.col("n").alias("n2")), "file2")
    return both.select("file1", "file2", "co", jaccard_percent(F.col("co"), F.col("n1"), F.col("n2")).alias("pct"))
