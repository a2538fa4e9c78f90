"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on binned statistics of labelled documents; every path from a root to a node below it is a conjunctive
rule. Logistic regression with an L1 penalty weighs the rules, most of which get weight zero, and what is left compiles into one
Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _hashing, _shared
from weftline.llm.language_id import remainder

#: Labelled rows that the classifier is fitted on, about, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
_CLASSES = ("upper", "lower", "digit", "blank", "newline", "exclamation", "period", "pipe", "hash", "dollar", "percent", "ampersand", "asterisk", "brackets", "slash", "other", "high")
_MARKS = {"!": 5, ".": 6, "|": 7, "#": 8, "$": 9, "%": 10, "&": 11, "*": 12, "<": 13, ">": 13, "{": 13, "}": 13, "[": 13, "]": 13, "/": 14, "\\": 14}
FEATURES = (*(f"{x}_share" for x in _CLASSES), "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "distinct_pairs", "distinct_fives", "distinct_lines", "words_per_line", "top_word_share", "other_words")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _class_of() -> np.ndarray:
    out = np.full(256, 15, np.int64)
    out[65:91], out[97:123], out[48:58], out[128:] = 0, 1, 2, 16
    out[[32, 9, 11, 12, 13]], out[10] = 3, 4
    for c, k in _MARKS.items():
        out[ord(c)] = k
    return out


_CLASS = _class_of()


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; an empty one has zeros."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    place = {x: i for i, x in enumerate(FEATURES)}
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    for i, t in enumerate(texts):
        for at in range(0, len(t or b""), _hashing.PIECE):
            out[i, : len(_CLASSES)] += np.bincount(_CLASS[np.frombuffer(t, np.uint8, min(_hashing.PIECE, len(t) - at), at)], minlength=len(_CLASSES))
    out[:, : len(_CLASSES)] /= np.maximum(sizes, 1)[:, None]
    words, bounds = _hashing.word_hashes(texts, lower=True)
    pairs, pair_bounds = _hashing.windows(words, bounds, 2)
    fives, five_bounds = _hashing.windows(words, bounds, 5)
    lines, line_bounds = _hashing.word_hashes(texts, lower=False, separators=_NEWLINE)
    many = np.diff(bounds)
    out[:, place["log_bytes"]], out[:, place["log_words"]] = np.log1p(sizes), np.log1p(many)
    out[:, place["mean_word"]] = sizes / np.maximum(many, 1)
    for i, t in enumerate(texts):
        if not many[i]:
            continue
        _, counts = np.unique(words[bounds[i] : bounds[i + 1]], return_counts=True)
        out[i, place["distinct_words"]], out[i, place["top_word_share"]] = len(counts) / many[i], counts.max() / many[i]
        out[i, place["other_words"]] = np.count_nonzero(counts == 1) / many[i]
        for name, h, b in (("distinct_pairs", pairs, pair_bounds), ("distinct_fives", fives, five_bounds), ("distinct_lines", lines, line_bounds)):
            m = b[i + 1] - b[i]
            out[i, place[name]] = len(np.unique(h[b[i] : b[i + 1]])) / m if m else 1.0
        out[i, place["words_per_line"]] = many[i] / max(1, line_bounds[i + 1] - line_bounds[i])
        out[i, place["longest_word"]] = max(map(len, t.split()), default=0)
    return out


def with_statistics(docs: DataFrame, keep: str, kept_type: str) -> DataFrame:
    """``keep``, a column of ``docs``, and FEATURES of its text."""

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            x = statistics(_shared.texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=[keep, *FEATURES])

    return docs.select(keep, F.col("text").cast("string")).mapInArrow(run, f"{keep} {kept_type}, " + ", ".join(f"{x} double" for x in FEATURES))


@dataclass
class Rule:
    """All of (feature, is above, threshold) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.conditions:
            out &= (x[:, j] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, above, t in self.conditions:
            c = F.col(FEATURES[j])
            out = out & (c > F.lit(t) if above else c <= F.lit(t))
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The probability of label 1 as an expression over FEATURES."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def _tree(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple, paths: list, values: np.ndarray, least: int = 10) -> None:
    """Grows a node of a regression tree; ``paths`` gets the conditions of every node, ``values`` the leaves' means."""
    values[rows] = residual[rows].mean()
    if path:
        paths.append(path)
    if not depth or len(rows) < 2 * least:
        return
    best = (1e-9, None, None)
    total, n = residual[rows].sum(), len(rows)
    for j in columns:
        many = np.bincount(binned[rows, j], minlength=len(edges[j]) + 1)
        sums = np.bincount(binned[rows, j], weights=residual[rows], minlength=len(edges[j]) + 1)
        left, left_sum = np.cumsum(many)[:-1], np.cumsum(sums)[:-1]
        ok = (left >= least) & (n - left >= least)
        if ok.any():
            gain = np.where(ok, left_sum**2 / np.maximum(left, 1) + (total - left_sum) ** 2 / np.maximum(n - left, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    _, j, k = best
    if j is None:
        return
    above = binned[rows, j] > k
    for side in (False, True):
        _tree(binned, edges, residual, rows[above == side], columns, depth - 1, (*path, (int(j), side, float(edges[j][k]))), paths, values, least)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty (not on the bias), by accelerated proximal gradients."""
    n = len(y)
    share = y.mean().clip(1e-4, 1 - 1e-4)
    w, bias = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    v, v_bias, t = w.copy(), bias, 1.0
    rate = 4 / max(float(np.linalg.norm(x, 2) ** 2 / n) + 1, 1e-9)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(x @ v + v_bias))) - y) / n
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = v_bias - rate * g.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, v_bias = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> Ensemble:
    """The ensemble for rows of FEATURES and labels 0 or 1. With no row, or one label only, a constant near it."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    edges = [(e[:-1] + e[1:]) / 2 if len(e) > 1 else e for e in edges]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw, paths = np.zeros(len(y)), []
    least = max(2, min(10, int(min(y.sum(), len(y) - y.sum())) // 4))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-raw))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if len(rows) < 2 * least:
            continue
        values = np.zeros(len(y))
        start = len(paths)
        _tree(binned, edges, residual, rows, rng.permutation(x.shape[1])[: max(1, int(x.shape[1] * 0.6))], depth, (), paths, values, least)
        leaf = np.zeros(len(y))
        for p in paths[start:]:  # deeper nodes come later and overwrite
            at = Rule(p).holds(x)
            leaf[at] = residual[at].mean() if at.any() else 0.0
        raw += leaf
    rules, seen = [], set()
    for p in paths:
        r = Rule(p)
        held = r.holds(x)
        mark = held.tobytes()
        if mark not in seen and held.any() and not held.all():
            seen.add(mark)
            rules.append((r, held))
    if not rules:
        share = y.mean()
        return Ensemble(float(np.log(share / (1 - share))))
    m = np.stack([h for _, h in rules], axis=1).astype(np.float64)
    check = rng.random(len(y)) < 0.2
    best = (np.inf, 1e-3)
    if check.any() and 0 < y[~check].mean() < 1:
        for penalty in (3e-3, 1e-3, 3e-4):
            b, w = _lasso(m[~check], y[~check], penalty, 200)
            p = (1 / (1 + np.exp(-(m[check] @ w + b)))).clip(1e-6, 1 - 1e-6)
            loss = -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
            if loss < best[0] - 1e-4:
                best = (loss, penalty)
    bias, w = _lasso(m, y, best[1])
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(bias, [rules[i][0] for i in used], [float(w[i]) for i in used])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fits on about ``sample`` labelled rows at most, chosen by a hash of doc_id, never on those whose remainder modulo 5 is 0."""
    _shared.prepare(spark)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & (remainder(5) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about ``sample`` rows of two numbers: safe to send everywhere, and no text moves
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").select((F.col("doc_id") * 2 + F.col("label")).alias("key"), "text")
    found = with_statistics(rows, "key", "long").toPandas().sort_values(["key", *FEATURES], kind="stable")  # in one order, whatever the partitions
    return fit(found[list(FEATURES)].to_numpy(float), (found["key"] % 2).to_numpy(float))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``docs``.

    A null or empty text has statistics of zero and a score like any other. A label that is neither 0 nor 1 is ignored; of labels
    that differ for one doc_id the smaller counts. Without labels every score is 0.5. A row without doc_id is held out. Repeated
    rows are scored each, other columns aren't read, an empty table gives no rows.
    """
    model = train(spark, docs, labels, sample)
    out = with_statistics(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "long").select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
