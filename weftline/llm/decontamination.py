"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased and bounded by space or ASCII punctuation; shingles are five words. For each item, windows of its own number of
words slide over every whole document; a document of fewer words is itself the one window. A window as similar as asked holds at least a fixed share of benchmark shingles, so windows with
fewer are passed over without loss. The others get 64-bit SimHash fingerprints, whose eight blocks find all items within RADIUS bits:
two fingerprints that differ in no more than RADIUS bits differ in no more than RADIUS // 8 within some block. What is found is
verified by the exact weighted Jaccard similarity of the shingles, weighted by how often each occurs.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _hashing, _shared

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 23
#: Bytes of benchmark text that one pass over the documents sends to the executors; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20
#: What a block's value is probed with: all bytes of RADIUS // BLOCKS bits at most.
_MASKS = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS).astype(np.uint8)
_BATCH = 1 << 22


def normalised(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower().encode("utf-8", "replace")


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start; a bit is set where at least half of them have it."""
    out = np.empty(len(starts), np.uint64)
    step = max(1, _BATCH // (64 * n))
    for i in range(0, len(starts), step):
        rows = shingles[starts[i : i + step, None] + np.arange(n)]
        bits = np.unpackbits(rows.view(np.uint8).reshape(*rows.shape, 8), axis=2).reshape(*rows.shape, 64)
        out[i : i + step] = np.packbits(2 * bits.sum(axis=1, dtype=np.int32) >= n, axis=1).view(np.uint64)[:, 0]
    return out


class Blocks:
    """Inverted lists of the codes of one length: for each block of bits and each of its values the items that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(-1, BLOCKS)
        orders = [np.argsort(parts[:, j], kind="stable") for j in range(BLOCKS)]
        self.items = np.concatenate(orders).astype(np.int32)
        self.first = np.stack([j * len(codes) + np.searchsorted(parts[o, j], np.arange(257)) for j, o in enumerate(orders)])

    def within(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``codes``, item) of all pairs within RADIUS bits, in order: each differs in RADIUS // BLOCKS bits at most in some block."""
        values = codes.view(np.uint8).reshape(-1, BLOCKS, 1) ^ _MASKS
        block = np.arange(BLOCKS)[:, None]
        low = self.first[block, values].reshape(-1)
        many = self.first[block, values.astype(np.int64) + 1].reshape(-1) - low
        who = np.repeat(np.arange(len(many)) // (BLOCKS * len(_MASKS)), many)
        item = self.items[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(who * len(self.codes) + item)
        who, item = pair // len(self.codes), pair % len(self.codes)
        near = np.bitwise_count(codes[who] ^ self.codes[item]) <= RADIUS
        return who[near], item[near]


class Index:
    """The items of one block, by their number of words."""

    def __init__(self, items: list[tuple[int, str | None]]):
        words, bounds = _hashing.word_hashes([normalised(t) for _, t in items], True, _hashing.LOOSE)
        shingles, first = _hashing.windows(words, bounds, SHINGLE)
        self.known = np.unique(shingles)
        by_length = defaultdict(list)
        for i, (item, _) in enumerate(items):
            if bounds[i + 1] > bounds[i]:
                by_length[int(bounds[i + 1] - bounds[i])].append((item, i))
        self.short = {}  # items below a shingle's length: their words have to be the same
        self.long = {}
        for m, of in sorted(by_length.items()):
            if m < SHINGLE:
                whole, _ = _hashing.windows(words, bounds, m)
                at = np.append(0, np.cumsum(np.maximum(np.diff(bounds) - m + 1, 0)))
                table = defaultdict(list)
                for item, i in of:
                    table[int(whole[at[i]])].append(item)
                self.short[m] = (np.array(sorted(table), np.uint64), dict(table))
            else:
                codes = fingerprints(shingles, first[[i for _, i in of]], m - SHINGLE + 1)
                self.long[m] = ([item for item, _ in of], Blocks(codes), [Counter(shingles[first[i] : first[i + 1]].tolist()) for _, i in of])

    def matches(self, words: np.ndarray, shingles: np.ndarray, known: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window in one document; ties to the earliest."""
        best: dict[int, tuple[float, int, int]] = {}
        bounds = np.array([0, len(words)])
        for m, (keys, table) in self.short.items():
            h, _ = _hashing.windows(words, bounds, m)
            for x in np.flatnonzero(np.isin(h, keys)):
                for item in table[int(h[x])]:
                    best.setdefault(item, (1.0, int(x), m))
        if not known.any():
            return best
        sums = np.append(0, np.cumsum(known))
        for m, (items, blocks, bags) in self.long.items():
            n = m - SHINGLE + 1
            width = min(n, len(shingles))  # of a shorter document, all
            if width < SIMILARITY * n - 1e-9:
                continue
            # weighted Jaccard s of two bags means at least s / (1 + s) of both sizes together in common
            least = int(np.ceil((n + width) * SIMILARITY / (1 + SIMILARITY) - 1e-9))
            starts = np.flatnonzero(sums[width:] - sums[:-width] >= least)
            step = max(1, _BATCH // (BLOCKS * len(_MASKS)) // max(1, len(items) // 256))
            for a in range(0, len(starts), step):
                some, last, window = starts[a : a + step], -1, None
                for i, y in zip(*(x.tolist() for x in blocks.within(fingerprints(shingles, some, width))), strict=True):
                    if i != last:
                        last, window = i, Counter(shingles[some[i] : some[i] + width].tolist())
                    shared = (window & bags[y]).total()
                    s = shared / (n + width - shared)
                    if s >= SIMILARITY and s > best.get(items[y], (0.0,))[0]:
                        best[items[y]] = (s, int(some[i]), width + SHINGLE - 1)
        return best


class Block:
    """Items as they are sent; a worker process makes their index once and keeps it for its later tasks."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items, self.made = items, None

    def index(self) -> Index:
        self.made = self.made or Index(self.items)
        return self.made


def _found(index: Index, texts: list[bytes]) -> list[dict[int, tuple[float, int, int]]]:
    """Index.matches() of each text."""
    out: list[dict] = []
    for a, b in _hashing.groups(texts):
        words, bounds = _hashing.word_hashes(texts[a:b], True, _hashing.LOOSE)
        shingles, first = _hashing.windows(words, bounds, SHINGLE)
        at = np.minimum(np.searchsorted(index.known, shingles), max(len(index.known) - 1, 0))
        known = index.known[at] == shingles if len(index.known) else np.zeros(len(shingles), bool)
        sums = np.append(0, np.cumsum(known))
        for i in range(b - a):
            wanted = index.short or sums[first[i + 1]] > sums[first[i]]
            out.append(index.matches(words[bounds[i] : bounds[i + 1]], shingles[first[i] : first[i + 1]], known[first[i] : first[i + 1]]) if wanted else {})
    return out


def _against(docs: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Block(items))

    def run(batches):
        import pyarrow as pa

        index = shared.value.index()
        for batch in _shared.slices(batches):
            ids, texts = batch.column(0).to_pylist(), [normalised(t) for t in _shared.decoded(batch.column(1))]
            out = [(i, item, s, x, m) for i, of in zip(ids, _found(index, texts), strict=True) for item, (s, x, m) in sorted(of.items())]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, similarity double, start long, n_words long")


def _without(docs: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Block(items))

    def run(batches):
        import pyarrow as pa

        index = shared.value.index()
        for batch in _shared.slices(batches):
            texts = [normalised(t) for t in _shared.decoded(batch.column(batch.schema.get_field_index("text")))]
            yield batch.filter(pa.array([not of for of in _found(index, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _blocks(spark: SparkSession, benchmark: DataFrame):
    """The benchmark's items, about BLOCK_BYTES of their texts at a time, whatever its size."""
    _shared.prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for i in range(passes):
        block = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        yield sorted(tuple(r) for r in block.collect())


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: the best window (start in words) of each item that a document holds.

    Items without words, or null ones, match nothing; rows without item_id are left out, repeated items count once. An item of
    fewer than five words matches where the same words stand. Null texts hold nothing; repeated documents give their rows each;
    a null doc_id stays null. Other columns aren't read. With an empty table on either side there are no rows.
    """
    out = None
    for items in _blocks(spark, benchmark):
        found = _against(docs, items)
        out = found if out is None else out.unionByName(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose ``text`` contaminated() finds nothing, with all their columns.

    Each row is judged by its own text, so rows without doc_id and rows that share one are treated like others. Null and empty texts
    stay. With an empty benchmark all rows do.
    """
    for items in _blocks(spark, benchmark):
        docs = _without(docs, items)
    return docs
