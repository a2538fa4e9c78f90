"""Removal of repeated word windows through a compacted de Bruijn graph.

Nodes are runs of WINDOW - 1 words and edges are windows of WINDOW words. Each window belongs to the smallest-hashed k-mer of MINIMIZER
words in it; consecutive windows of one document that share that minimizer form a path without branches inside the document, and are
one row (a compacted path) from the start. A first pass counts minimizers and marks the repeated ones in a bitmap of fixed size;
paths without a marked minimizer can't repeat. Joins then find the first source of each path: later copies are removed whole. Where
one minimizer has several different paths, the graph branches: only there paths are split into their windows, and these find their
first source by a second join. Sources are coordinates (doc_id, start), and what has an earlier source is a repeated span.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _hashing, _shared

WINDOW, MINIMIZER = 20, 8
#: The bitmap has 2**BITS bits, 16 MB, whatever the input. More repeated minimizers than that only make it let more paths through.
BITS = 27
_U = np.uint64


def _paths(texts: list[bytes | None], window: int, k: int):
    """(minimizer hash, text number, start, windows, number of the first window) arrays of the paths of some texts, and the bounds and second hashes of words."""
    words, others, bounds = _hashing.word_hashes(texts, lower=False, salts=(0, 1))
    many = np.maximum(np.diff(bounds) - window + 1, 0)
    if not many.any():
        return None
    text = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(text)) - (np.cumsum(many) - many)[text]
    kmers, _ = _hashing.windows(words, np.array([0, len(words)]), k)
    # smallest by 32 bits of hash, then leftmost: the place is in the low bits
    key = (kmers & _U(0xFFFFFFFF00000000)) | np.arange(len(kmers), dtype=_U)
    span, have = window - k + 1, 1
    while 2 * have <= span:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    if span > have:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    place = (key[bounds[text] + start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return kmers[place[new]], text[new], start[new], np.diff(np.append(new, len(text))), new, bounds, others


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & _U((1 << BITS) - 1)).astype(np.int64)


def _minimizers(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Half of each path's minimizer hash, and how often (two at most) a part of a task has met it."""

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            texts = _shared.texts_of(batch.column(0))
            for a, b in _hashing.groups(texts):
                if found := _paths(texts[a:b], window, k):
                    h = np.sort(found[0].astype(np.uint32).view(np.int32))
                    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    many = np.minimum(np.diff(np.append(first, len(h))), 2).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(many)], names=["half", "many"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "half int, many int")


def _marked(spark: SparkSession, docs: DataFrame, window: int, k: int) -> np.ndarray:
    """The bitmap of repeated minimizers."""
    often = _minimizers(docs, window, k).groupBy("half").agg(F.sum("many").alias("many")).where("many > 1")
    slot = often.select(F.col("half").bitwiseAND(F.lit((1 << BITS) - 1)).alias("slot"))
    blocks = slot.groupBy(F.shiftright("slot", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767)).cast("long")).alias("bits"))
    out = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for r in blocks.collect():  # at most 2**(BITS - 15) rows of 4 KB
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def paths(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """Paths that may repeat: doc_id, body (hash of the text), minimizer, path (hash of all its words), start, windows, and the windows' own hashes."""
    marks = spark.sparkContext.broadcast(_marked(spark, docs.where("doc_id is not null"), window, k))

    def run(batches):
        import pyarrow as pa

        bits = marks.value
        for batch in _shared.slices(batches):
            ids, bodies, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _shared.texts_of(batch.column(2))
            for a, b in _hashing.groups(texts):
                found = _paths(texts[a:b], window, k)
                if not found:
                    continue
                minimizer, text, start, many, at, bounds, others = found
                slot = _slot(minimizer)
                keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                size = many[keep]
                whole = _hashing.windows(others, bounds, window)[0]
                path = _hashing.runs(whole, at[keep], size)
                inside = np.repeat(at[keep] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(whole[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text[keep]]), pa.array(bodies[a:b][text[keep]]), pa.array(minimizer[keep].view(np.int64)), pa.array(path.view(np.int64)), pa.array(start[keep].astype(np.int64)), pa.array(size.astype(np.int32)), lists], names=["doc_id", "body", "minimizer", "path", "start", "windows", "hashes"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(run, "doc_id long, body long, minimizer long, path long, start long, windows int, hashes array<long>")


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """doc_id, body, start, stop: words covered by windows that have an earlier source; spans of a document may overlap."""
    every = _shared.table(spark, paths(spark, docs, window, k), "paths")
    source = F.struct("doc_id", "start")
    firsts = every.groupBy("minimizer", "path").agg(F.min(source).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = _shared.table(spark, firsts, "firsts")
    branching = firsts.groupBy("minimizer").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("minimizer", F.lit(True).alias("branches"))
    wanted = firsts.join(branching, "minimizer", "left").where("copies > 1 or branches")
    met = every.join(wanted, ["minimizer", "path"]).withColumn("later", source > F.col("first")).where("later or branches")
    met = _shared.table(spark, met.select("doc_id", "body", "minimizer", "start", "windows", "later", F.when(~F.col("later"), F.col("hashes")).alias("hashes")), "met")
    copied = met.where("later").select("doc_id", "body", "start", (F.col("start") + F.col("windows") + F.lit(window - 1)).alias("stop"))
    single = met.where("not later").select("doc_id", "body", "minimizer", "start", F.posexplode("hashes").alias("i", "hash")).select("doc_id", "body", "minimizer", "hash", (F.col("start") + F.col("i")).alias("start"))
    first = single.groupBy("minimizer", "hash").agg(F.min(source).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("minimizer", "hash", "first")
    split = single.join(first, ["minimizer", "hash"]).where(source > F.col("first")).select("doc_id", "body", "start", (F.col("start") + F.lit(window)).alias("stop"))
    return copied.unionByName(split)


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), one row per row of ``docs``.

    Words are runs of bytes other than ASCII space, unchanged. A window of ``window`` words is removed if the same words also start
    earlier: in a smaller doc_id, or earlier in the same document; judged on the input alone. Null texts have no words. Rows that
    repeat a doc_id are compared with others like any document, but equal coordinates don't remove one another. A row without
    doc_id takes no part and keeps its words. Other columns aren't read; an empty table gives no rows.
    """
    return _cut(spark, docs, window, k, "kept string", lambda words: b" ".join(words).decode("utf-8", "replace"))


def dedup_digest(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """As dedup(), with kept_sha256 instead of the words themselves."""
    return _cut(spark, docs, window, k, "kept_sha256 string", lambda words: hashlib.sha256(b" ".join(words)).hexdigest())


def _cut(spark: SparkSession, docs: DataFrame, window: int, k: int, column: str, result) -> DataFrame:
    _shared.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spans = repeated_spans(spark, rows, window, k)
    spans = _shared.table(spark, spans.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")).select("doc_id", "body", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), "spans")
    both = rows.withColumn("body", F.xxhash64("text")).join(spans, ["doc_id", "body"], "left").select("doc_id", "text", "starts", "stops")

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            n_words, n_removed, out = [], [], []
            for text, starts, stops in zip(_shared.texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, stops, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [words[i] for i in np.flatnonzero(~gone)]
                n_removed.append(n_words[-1] - len(words))
                out.append(result(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", column.split()[0]])

    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column}")
