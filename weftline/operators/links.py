"""Links from commands and scripts to the repositories their programs come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.functions.text import has_word
from weftline.plans.lineage import cut


#: Characters of a command that lead it to the keys that may contain it.
GRAM = 8


def run_commands(files: DataFrame) -> DataFrame:
    """path, at, command: the parts between ``&&`` of every RUN instruction of Dockerfiles (path, text), in order."""
    joined = F.regexp_replace("text", r"\\[ \t]*\r?\n", " ")
    runs = F.regexp_extract_all(joined, F.lit(r"(?im)^[ \t]*RUN[ \t]+(.+)$"), 1)
    return files.select("path", F.posexplode(F.flatten(F.transform(runs, lambda r: F.split(r, "&&")))).alias("at", "command")).withColumn("command", F.trim("command"))


def clones(commands: DataFrame) -> DataFrame:
    """Adds url and folder of the clone commands; folder is null where nothing is checked out."""
    c = F.col("command")
    return commands.where(paths.is_clone(c)).withColumn("url", paths.clone_url(c)).withColumn("folder", paths.clone_folder(c)).where("url is not null")


def moves(commands: DataFrame) -> DataFrame:
    """Adds from_path and to_path of the link commands."""
    c = F.col("command")
    return commands.where(paths.is_link(c)).withColumn("from_path", paths.link_source(c)).withColumn("to_path", paths.link_target(c)).where("from_path is not null and to_path is not null")


def follow_moves(known: DataFrame, linked: DataFrame) -> DataFrame:
    """kind, key, git_url of ``known`` (key, git_url) and of every path that links (at, from_path, to_path), made in order, lead to.

    A link carries over what its source is at that time, so chains go along rising ``at`` and end; the last link to a path counts.
    """
    reached = frontier = cut(known.select("key", "git_url", F.lit(-1).alias("at")))
    while True:
        met = frontier.withColumnRenamed("at", "since").join(linked, F.col("key") == F.col("from_path")).where("at > since")
        frontier = cut(met.select(F.col("to_path").alias("key"), "git_url", "at").distinct())
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.groupBy("key").agg(F.max_by("git_url", "at").alias("git_url")).select(F.lit("paths").alias("kind"), "key", "git_url")


def of_dockerfiles(files: DataFrame, repo_files: DataFrame) -> DataFrame:
    """The links (kind, key, git_url) of Dockerfiles (path, text), given what lies in each repository (repo_url, path).

    ``paths``: files of repositories where they are checked out, and what links lead there; ``commands``: names of repositories
    that are cloned without a checkout.
    """
    commands = run_commands(files)
    cloned = clones(commands)
    inside = cloned.where("folder is not null").select("url", "folder").distinct().join(repo_files.withColumnRenamed("path", "file"), F.col("url") == F.col("repo_url")).select(F.concat_ws("/", "folder", "file").alias("key"), F.col("url").alias("git_url"))
    names = cloned.where("folder is null").select(F.lit("commands").alias("kind"), paths.repo_name(F.col("url")).alias("key"), F.col("url").alias("git_url")).distinct()
    return union(follow_moves(inside.distinct(), moves(commands).select("at", "from_path", "to_path")), names)


def union(*of: DataFrame) -> DataFrame:
    """All links; where tables share a key, the later one counts."""
    ranked = reduce(DataFrame.unionByName, (df.withColumn("priority", F.lit(i)) for i, df in enumerate(of)))
    return ranked.groupBy("kind", "key").agg(F.max_by("git_url", F.struct("priority", "git_url")).alias("git_url"))


def exact(commands: DataFrame, links: DataFrame, name: str = "command") -> DataFrame:
    """Commands whose text is a link's key."""
    return commands.join(links.select(F.col("key").alias(name), "git_url"), name)


def containing(commands: DataFrame, links: DataFrame, name: str = "command") -> DataFrame:
    """For each command the first link, by key, whose key contains it.

    They meet by the command's first GRAM characters, or all of a shorter one, which are among the key's runs of as many.
    """
    asked = commands.withColumn("_gram", F.substring(name, 1, GRAM))
    sizes = asked.agg(F.collect_set(F.length("_gram")).alias("sizes"))  # one row of GRAM + 1 numbers at most
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - n + 1, F.lit(1))), lambda i: F.substring("key", i, n))))
    keys = links.select("key", "git_url").crossJoin(F.broadcast(sizes)).select("key", "git_url", F.explode(F.array_distinct(runs)).alias("_gram"))
    return _first(asked.join(keys, "_gram").where(F.contains("key", name)).drop("_gram"), commands.columns)


def mentioned(scripts: DataFrame, links: DataFrame, text: str = "text") -> DataFrame:
    """For each script the links whose key stands in it as a word.

    They meet by the key's first run of letters and digits, which is a whole run of the script too. A key without any stands between
    two runs, so it meets every script.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(\w+)"), 1)
    keys = links.select("key", "git_url", F.coalesce(F.get(words("key"), 0), F.lit("")).alias("_word"))
    asked = scripts.withColumn("_word", F.explode(F.array_distinct(F.array_append(words(F.col(text)), F.lit("")))))
    return asked.join(keys, "_word").where(has_word(F.col(text), F.col("key"))).drop("_word")


def base_command_references(entities: DataFrame, links: DataFrame) -> DataFrame:
    """component_id, reference, git_url of tools' base commands: a first command with a suffix is sought within the paths of executables, another one among the commands."""
    tools = entities.where(F.size("base_command") > 0).select(F.col("path").alias("component_id"), F.array_join("base_command", " ").alias("reference"), F.get("base_command", 0).alias("command"))
    has_suffix = paths.suffix(F.col("command")) != ""
    found = containing(tools.where(has_suffix), links.where((F.col("kind") == "paths") & paths.is_executable(F.col("key"))))
    named = exact(tools.where(~has_suffix), links.where("kind = 'commands'"))
    return found.select("component_id", "reference", "git_url").unionByName(named.select("component_id", "reference", "git_url"))


def listing_references(entities: DataFrame, links: DataFrame) -> DataFrame:
    """component_id, reference, git_url: links that stand in a script which a tool both lists and runs, by path or by what an executable is called."""
    given = entities.select(F.col("path").alias("component_id"), "base_command", F.explode("listing").alias("l")).where(F.array_contains("base_command", F.col("l.entryname")))
    scripts = given.select("component_id", F.col("l.entry").alias("text"))
    known = union(links.where("kind = 'commands'").withColumn("kind", F.lit("any")), links.where("kind = 'paths'").withColumn("kind", F.lit("any")))
    keys = known.select(F.explode(F.array_compact(F.array(F.replace(F.col("key"), F.lit("\\"), F.lit("/")), paths.executable(F.col("key"))))).alias("key"), "git_url")
    return mentioned(scripts, keys).select("component_id", F.col("text").alias("reference"), "git_url").distinct()


def _first(met: DataFrame, of: list[str]) -> DataFrame:
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy("key"))).where("_n = 1").drop("_n")
