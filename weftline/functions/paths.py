"""Paths, URLs and shell tokens as Column functions. ``sep`` is the separator of the corpus; everything is an expression Catalyst sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    """A regular expression for a literal text."""
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def clean_component_id(path: Column, root: str = "repos", sep: str = "\\") -> Column:
    """The path without one leading root folder."""
    return F.regexp_replace(path, "^" + _quoted(root + sep), "")


def fold_path(path: Column, sep: str = "/") -> Column:
    """``.`` and ``..`` resolved; ``..`` above the root is dropped."""
    parts = F.split(path, _quoted(sep))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == ".") | (p == ""), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.array_join(folded, sep)


def workflow_folder(path: Column, sep: str = "/") -> Column:
    """The folder of a definition: everything before the first segment that names one, also for entities inside it."""
    parts = F.split(path, _quoted(sep))
    at = F.array_position(F.transform(parts, lambda p: p.contains(".cwl")), F.lit(True))
    return F.array_join(F.when(at > 0, F.slice(parts, 1, at.cast("int") - 1)).otherwise(F.slice(parts, 1, F.size(parts) - 1)), sep)


def step_target(workflow: Column, step_id: Column, run: Column, inline: Column, sep: str = "/") -> Column:
    """The component a step calls: its run path from the workflow's folder, or an entity inside the workflow."""
    folder = workflow_folder(workflow, sep)
    return F.when(inline, F.concat_ws(sep, workflow, step_id)).otherwise(fold_path(F.concat_ws(sep, folder, run), sep))


def name(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, _quoted(sep)), -1)


def stem(path: Column, sep: str = "/") -> Column:
    """The last part without its last suffix."""
    return F.regexp_replace(name(path, sep), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column, sep: str = "/") -> Column:
    return F.regexp_extract(name(path, sep), r"(?<=.)(\.[^.]+)$", 1)


def parts(path: Column, sep: str = "/") -> Column:
    return F.split(path, _quoted(sep))


def repo_key(path: Column, depth: int = 2, sep: str = "\\") -> Column:
    """The first ``depth`` parts, null for shorter paths: equal keys mean the same repository."""
    enough = path.contains(sep) if depth == 2 else F.size(parts(path, sep)) >= depth
    return F.when(enough, F.substring_index(path, sep, depth))


def same_repo(a: Column, b: Column, sep: str = "\\") -> Column:
    return F.coalesce(repo_key(a, 2, sep) == repo_key(b, 2, sep), F.lit(False))


def is_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://") | text.startswith("git@")


def repo_name(url: Column) -> Column:
    """The last part of a repository's URL, without ``.git``."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def project_path(url: Column, host: Column | str) -> Column:
    """The project's path on its host."""
    return F.regexp_replace(F.replace(url, F.lit(host), F.lit("")), "^/+", "")


#: Where programs are installed that a path makes executable.
EXECUTABLES = "/usr/local/bin"


def is_executable(path: Column) -> Column:
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).startswith(EXECUTABLES + "/"), F.lit(False))


def executable(path: Column) -> Column:
    """What stands below the folder of executables, or null."""
    return F.when(is_executable(path), F.substring(F.replace(path, F.lit("\\"), F.lit("/")), len(EXECUTABLES) + 2, 1 << 20))


def tokens(command: Column) -> Column:
    """The words of a command."""
    return F.filter(F.split(F.trim(command), r"\s+"), lambda t: t != "")


def clone_url(command: Column) -> Column:
    """The first URL of a clone command."""
    return F.get(F.filter(tokens(command), is_url), 0)


def clone_folder(command: Column) -> Column:
    """The word after the URL, if there is one; by default the repository's name. Null where nothing is checked out."""
    words, url = tokens(command), clone_url(command)
    after = F.get(words, F.array_position(words, url).cast("int"))
    return F.when(~command.contains("--no-checkout"), F.coalesce(after, repo_name(url)))


def is_clone(command: Column) -> Column:
    return command.contains("git clone")


def link_source(command: Column) -> Column:
    """What an ``ln`` command links: its first word that is neither ``ln`` nor a flag."""
    return F.get(_link_words(command), 0)


def link_target(command: Column) -> Column:
    return F.get(_link_words(command), 1)


def _link_words(command: Column) -> Column:
    return F.filter(tokens(command), lambda t: (t != "ln") & ~t.startswith("-"))


def is_link(command: Column) -> Column:
    return F.coalesce(command.startswith("ln"), F.lit(False))
