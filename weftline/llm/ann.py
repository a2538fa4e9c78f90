"""Approximate nearest neighbours by multi-index hashing.

A rotation of the principal components, learned on a bounded sample so that signs lose little (iterative quantisation), turns a vector
into BITS bits. Codes are split into bytes and each byte has an inverted index. Two codes within R bits differ in no more than R //
(BITS / 8) within some byte, so probing every byte's values that near retrieves all codes within R. They are reranked by the inner
product of the original vectors. R is the quantile RECALL of the code distances of true neighbours in the sample, which is thinner
than the table, so that neighbours there are farther.

The queries are a stated share of the rows. Blocks of rows meet blocks of queries; a block has its own index, and gives its best k
for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import _shared

BITS, SAMPLE, SAMPLE_QUERIES, RECALL = 128, 8192, 512, 0.985
ROWS, QUERIES = 16_384, 1_024
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


@dataclass
class Coder:
    """Codes are the signs of (x / |x| - mean) @ planes."""

    mean: np.ndarray
    planes: np.ndarray
    radius: int = 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.planes > 0, axis=1)


def learn(x: np.ndarray, bits: int = BITS, k: int = 20, seed: int = 11, rounds: int = 30) -> Coder:
    """Rotations of the leading components, as many as give ``bits``, and the radius that holds true neighbours of the sample."""
    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    c = unit - mean
    axes = np.linalg.svd(c, full_matrices=False)[2]
    planes, have = [], 0
    while have < bits:
        d = min(bits - have, len(axes))
        v = c @ axes[:d].T
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        planes.append(axes[:d].T @ r)
        have += d
    coder = Coder(mean, np.concatenate(planes, axis=1))
    q = rng.permutation(len(x))[:SAMPLE_QUERIES]
    codes, far = coder.codes(x), []
    for i in q:
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1))[:k]
        far += _hamming(codes[near[near != i]], codes[i]).tolist()
    coder.radius = int(np.quantile(far, RECALL)) if far else bits
    return coder


def _hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1, dtype=np.int64)


class Index:
    """Inverted lists of the codes' bytes for one block of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.orders)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within ``radius`` bits, ascending."""
        share = radius // self.codes.shape[1]
        seen = np.zeros(len(self.codes), bool)
        for j, (order, starts) in enumerate(zip(self.orders, self.starts, strict=True)):
            for value in np.flatnonzero(_DISTANCE[code[j]] <= share):
                seen[order[starts[value] : starts[value + 1]]] = True
        found = np.flatnonzero(seen)
        return found[_hamming(self.codes[found], code) <= radius]


def best(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k largest inner products with q among rows that aren't ``own``; ties to the smaller id."""
    rough = x @ q
    rough[ids == own] = -np.inf
    if len(rough) > k:  # products of equal rows may differ in their last bits here, so the margin keeps all ties
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        keep = np.flatnonzero((rough >= least - 1e-9 * max(1.0, abs(least))) & (rough > -np.inf))
    else:
        keep = np.flatnonzero(rough > -np.inf)
    score = (x[keep] * q).sum(axis=1)
    order = np.lexsort((ids[keep], -score))[:k]
    return ids[keep][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (double): rows with an id and a vector that isn't null, zero, or holds null or non-finite components, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda e: e != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    if rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(spark: SparkSession, vectors: DataFrame, modulus: int = 20, k: int = 20, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by ``modulus``, all rows being candidates.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most take no part; a repeated
    vec_id keeps its smallest vector. Where a block holds fewer than k codes within the radius all its rows are reranked, so a
    query gets k rows, or all there are. Other columns aren't read; an empty table gives no rows.
    """
    _shared.prepare(spark)
    all_rows = usable(vectors)
    n = all_rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = all_rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").toPandas()  # about SAMPLE vectors
    schema = "query_id long, vec_id long, score double"
    if len(sample) < 2:
        coder = None
    else:
        coder = learn(np.stack(sample["v"].to_numpy()), k=k)
    row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-n // (modulus * queries)))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = all_rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("row_block"), each(query_blocks).alias("query_block"), "vec_id", "v")
    asked = all_rows.where(F.pmod("vec_id", F.lit(modulus)) == 0).select(each(row_blocks).alias("row_block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), "vec_id", "v")

    def meet(block, wanted):
        import pandas as pd

        out = []
        if len(block) and len(wanted):
            block, wanted = block.sort_values("vec_id"), wanted.sort_values("vec_id")
            ids, x, q = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), np.stack(wanted["v"].to_numpy())
            if coder:
                index, codes = Index(coder.codes(x)), coder.codes(q)
            for i, own in enumerate(wanted["vec_id"].tolist()):
                near = index.within(codes[i], coder.radius) if coder else np.arange(len(ids))
                if len(near) <= k:
                    near = np.arange(len(ids))
                out.append((own, *best(ids[near], x[near], own, q[i], k)))
        many = [len(f) for _, f, _ in out]
        none = [np.zeros(0)]
        return pd.DataFrame({"query_id": np.repeat([o for o, _, _ in out], many).astype(np.int64), "vec_id": np.concatenate([f for _, f, _ in out] or none).astype(np.int64), "score": np.concatenate([s for _, _, s in out] or none)})

    cells = ["row_block", "query_block"]
    found = data.groupBy(cells).cogroup(asked.groupBy(cells)).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
