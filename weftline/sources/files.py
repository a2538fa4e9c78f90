"""Flows, commits, matrices and scores as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.matrix import unpivoted
from weftline.plans import schemas


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """The long table of nested flows, source -> target -> [[context, type, distance], ...]."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<array<string>>>>").alias("m"))
    by_source = nested.select(F.explode("m").alias("source_id", "targets"))
    by_target = by_source.select("source_id", F.explode("targets").alias("target_id", "entries"))
    one = by_target.select("source_id", "target_id", F.explode("entries").alias("e"))
    return one.select("source_id", "target_id", F.col("e")[0].alias("context_id"), F.col("e")[1].alias("flow_type"), F.col("e")[2].cast("int").alias("distance"))


def write_flows(nested: DataFrame, path: str) -> None:
    """One JSON object per source, as flows.nested() makes them."""
    nested.write.mode("overwrite").json(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMMITS).option("multiLine", "true").json(path)


def write_commits(commits: DataFrame, path: str) -> None:
    commits.select("id", "changed_files").write.mode("overwrite").json(path)


def read_matrix(spark: SparkSession, path: str, a: str = "id_1", b: str = "id_2", value: str = "score") -> DataFrame:
    """The long table of a dense CSV matrix whose first column holds the row's id."""
    wide = spark.read.option("header", "true").csv(path)
    index = wide.columns[0]
    long = unpivoted(wide.withColumnRenamed(index, "_id"), "_id", a, b, value)
    return long.withColumn(value, F.col(value).cast("double"))


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def scores_json(scores: DataFrame) -> DataFrame:
    """repo, json: the map of files to scores of each repository."""
    return scores.groupBy("repo").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "score"))))).alias("json"))


def repositories(projects: DataFrame, wanted: DataFrame, on: str = "path_with_namespace") -> DataFrame:
    """The listed projects that are wanted."""
    return projects.join(wanted.select(on).distinct(), on, "left_semi")


def listing(repo_files: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_url, path of repositories; those without a listing have no rows."""
    return repo_files.join(repos.select("repo_url").distinct(), "repo_url", "left_semi")
