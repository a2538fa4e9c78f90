"""Harmonic packing of tokenised documents into sequences.

A document is cut into whole sequences and a rest; the rest is a piece of class k where k such pieces share a sequence, or gives a
power of two first where its class would waste more than 1/64 of it. A sequence of class k takes exactly k pieces, so a piece's
place follows from its rank in the class: ranks are counted in hash buckets, independently across workers, and the buckets'
totals shift them. The pieces that don't fill the last sequence of a class, fewer than k for each class and so bounded whatever
the input, are packed together, longest first.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import _shared, _tokens

CAPACITY = 2048
END_ID = 1
#: A rest is a piece as it is if its class wastes no more than this share of it, or if it is this short.
WASTE, SHORT = 1 / 64, 16
#: Pieces whose ranks one task counts.
BUCKET = 10_000


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest <= SHORT or capacity / k - rest <= WASTE * rest:
            return [*out, (rest, k)]
        part = 1 << (rest.bit_length() - 1)
        if capacity % part:  # for capacities that are no power of two
            return [*out, (rest, k)]
        out.append((part, capacity // part))
        rest -= part
    return out


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class: the pieces of every document, from one pass over the texts."""

    def pieces(batches):
        import pyarrow as pa

        encode = _tokens.encoder(vocabulary)
        for batch in _shared.slices(batches):
            out = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), _shared.decoded(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                start = 0
                for length, k in cut(len(ids), capacity):
                    for column, x in zip(out, (doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), k), strict=True):
                        column.append(x)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long")


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length and class. ``pieces`` is read more than once and has to be a stored table."""
    total = pieces.count()
    buckets = total // BUCKET + 1
    where = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    binned = pieces.withColumn("bucket", where)
    sizes = binned.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("many"))
    shifts = sizes.select("class", "bucket", (F.sum("many").over(Window.partitionBy("class").orderBy("bucket")) - F.col("many")).alias("shift"))
    first, classes = 0, []
    for k, n in sorted((r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()):  # at most ``capacity`` classes
        classes.append((k, n // k * k, first))
        first += n // k
    known = spark.createDataFrame(classes, "class long, filled long, first long")
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start"))
    ranked = binned.withColumn("at", rank - 1).join(shifts, ["class", "bucket"]).withColumn("at", F.col("at") + F.col("shift")).join(F.broadcast(known), "class")
    ranked = _shared.table(spark, ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "at", "filled", "first"), "ranked")
    sequence: Column = F.col("first") + F.floor(F.col("at") / F.col("class")).cast("long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.where(F.col("at") < F.col("filled")).withColumn("sequence_id", sequence).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).select(names)

    def fit(group):
        import pandas as pd

        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room, ids, offsets = np.zeros(0, np.int64), [], []
        for length in group["length"]:
            open_ = np.flatnonzero(room >= length)
            if not len(open_):
                room = np.append(room, capacity)
                open_ = [len(room) - 1]
            ids.append(first + open_[0])
            offsets.append(capacity - room[open_[0]])
            room[open_[0]] -= length
        return pd.DataFrame({n: group[n] for n in names[:5]} | {"sequence_id": np.asarray(ids, np.int64), "offset": np.asarray(offsets, np.int64)})

    rest = ranked.where(F.col("at") >= F.col("filled")).select(*names[:5], F.lit(0).alias("all")).groupBy("all").applyInPandas(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(rest)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty and give the end id alone. Repeated rows are packed each. A null doc_id stays null. Columns other than
    doc_id and text aren't read. An empty table gives no rows.
    """
    _shared.prepare(spark)
    pieces = _shared.table(spark, tokenised_pieces(docs, vocabulary or _tokens.default_vocabulary(), end_id, capacity), "pieces")
    return place(spark, pieces, capacity)
