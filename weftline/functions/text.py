"""Expressions over texts of definitions and commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "struct<kind:string,ref:string>"


def expression_references(expression: Column) -> Column:
    """array<struct<kind, ref>>: every ``inputs.X`` as (parameter, X), then every ``steps.S.outputs.O`` as (step_output, S/O)."""
    names = F.regexp_extract_all(expression, F.lit(r"(?U)\binputs\.([a-zA-Z_]\w*)"), 1)
    steps = F.regexp_extract_all(expression, F.lit(r"(?U)\bsteps\.([a-zA-Z_]\w*)\.outputs\.([a-zA-Z_]\w*)"), 1)
    outputs = F.regexp_extract_all(expression, F.lit(r"(?U)\bsteps\.([a-zA-Z_]\w*)\.outputs\.([a-zA-Z_]\w*)"), 2)
    own = F.transform(names, lambda x: F.struct(F.lit("parameter").alias("kind"), x.alias("ref")))
    other = F.zip_with(steps, outputs, lambda s, o: F.struct(F.lit("step_output").alias("kind"), F.concat_ws("/", s, o).alias("ref")))
    return F.concat(own, other)


def type_text(types: Column) -> Column:
    """A parameter's alternative types as one text."""
    return F.array_join(types, " OR ", "null")


def is_noise_message(message: Column) -> Column:
    """Commit messages about merges of branches or conflicts, documentation or comments; parts of words count."""
    m = F.lower(message)
    return (m.contains("merge") & (m.contains("branch") | m.contains("conflict"))) | m.contains("doc") | m.contains("comment")


def escaped(text: Column) -> Column:
    """The text as a regular expression that matches it."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def has_word(text: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``text`` between word boundaries."""
    return F.regexp_like(text, F.concat(F.lit(r"\b"), escaped(word), F.lit(r"\b")))


def suffix_of(inner: Column, outer: Column) -> Column:
    """Whether array ``inner`` ends ``outer``; an empty one ends only an empty one."""
    return F.when(F.size(inner) == 0, F.size(outer) == 0).when(F.size(inner) > F.size(outer), F.lit(False)).otherwise(F.slice(outer, F.size(outer) - F.size(inner) + 1, F.greatest(F.size(inner), F.lit(1))) == inner)


def erfc(x: Column) -> Column:
    """The complementary error function to about 1e-7, by Chebyshev's rational fit; JVM-side, for p-values."""
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    y = t * F.exp(-x * x - 1.26551223 + t * poly)
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_sf(z: Column) -> Column:
    """P(Z > z) of a standard normal variable."""
    return 0.5 * erfc(z / F.sqrt(F.lit(2.0)))
