"""Training-order materialisation: token sequences in shards of fixed stride, in the order of a keyed permutation.

Each scan partition joins its documents' ids, each ended by ``end_id``, and cuts them into sequences of L ids. The sequences that one
of P partitions cuts go to P ranges of slots: of every P successive ones each range gets one, by a keyed permutation of 0..P-1 that
every such group has of its own. A range's sequences, in the order of their partition and place, are then permuted as a whole,
and the ranges follow each other. Both steps are a Feistel network over the least even number of bits that holds the numbers, walked
along its cycle until it falls inside; ``Order`` takes both forwards and backwards from the partitions' counts of sequences
and the key alone. Ranges differ by P sequences at most, however uneven the partitions are.

Every slot is written as a record of one stride, so slot s lies in shard s // S at byte (s % S) * stride: a reader can start
anywhere and go on sequentially. A shard that two ranges share has two files, in the order of their numbers.

The ranges need no count beforehand, so the texts are tokenised once and the ids are moved once: the shuffle that the counting job
makes is what the writing job reads (an RDD, since two jobs on one DataFrame would each make their own).

Record, little-endian: slot u64, sequence u64, ids in it u32, CRC-32 of those ids as u16 u32, L ids of u16 (zeros after the
last), and the byte 0x0A. Spark's writer commits the shards, so lost tasks leave no part of a shard behind.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _shared, _tokens
from weftline.llm._hashing import mix

LENGTH, SHARD, ROUNDS = 2048, 4096, 6
HEAD = "<QQII"
HEAD_BYTES = struct.calcsize(HEAD)


def stride(length: int = LENGTH) -> int:
    return HEAD_BYTES + 2 * length + 1


def _network(x: np.ndarray, half: int, keys: list[int], inverse: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (mix(left ^ np.uint64(key)) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ np.uint64(key)) & mask)
    return (left << np.uint64(half)) | right


def _key(key: int, *numbers) -> np.ndarray:
    """The key that belongs to numbers, each an array or one for all."""
    found = np.atleast_1d(np.asarray(key, np.uint64))
    for x in numbers:
        found = mix(found + np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return found


def permute(x, n: int, key, inverse: bool = False) -> np.ndarray:
    """The place of each number below n under the permutation of 0..n-1 that key names, or the number at a place. Each may have a key."""
    x = np.array(x, np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = np.broadcast_to(np.stack([_key(key, r) for r in range(ROUNDS)]), (ROUNDS, len(x)))
    todo = np.ones(len(x), bool)
    while todo.any():  # at least a quarter of the domain lies below n, so this ends after a few steps
        x[todo] = _network(x[todo], half, keys[:, todo], inverse)
        todo = x >= n
    return x.astype(np.int64)


def _range(part, local, parts: int, key: int) -> np.ndarray:
    """The range that each sequence goes to: groups of ``parts`` successive ones are permuted."""
    group, place = np.divmod(np.asarray(local, np.int64), parts)
    return permute(place, parts, _key(key, part, group))


def _order(sequences: list, r: int, key: int) -> tuple[list[int], np.ndarray]:
    """The range's sequences (part, local, ..) in their order: where each is in the list, and the places that they have."""
    by = sorted(range(len(sequences)), key=lambda i: sequences[i][:2])
    return by, permute(np.arange(len(by)), len(by), _key(key, r))


@dataclass
class Order:
    """Slots of sequences and sequences of slots, by how many sequences each part has. Takes parts x parts steps once, then parts for each range asked."""

    counts: np.ndarray
    key: int

    def _held(self, r: int) -> np.ndarray:
        """How many of its sequences each part has in a range."""
        counts = np.asarray(self.counts, np.int64)
        n = len(counts)
        groups, left = np.divmod(counts, n)
        return groups + (permute(np.full(n, r), n, _key(self.key, np.arange(n), groups), inverse=True) < left)

    @cached_property
    def _starts(self) -> np.ndarray:
        return np.cumsum([0, *(int(self._held(r).sum()) for r in range(len(self.counts)))])

    def slots(self, part, local) -> np.ndarray:
        part, local = np.asarray(part, np.int64), np.asarray(local, np.int64)
        ranges, out = _range(part, local, len(self.counts), self.key), np.empty(len(part), np.int64)
        for r in np.unique(ranges).tolist():
            of = ranges == r
            before = np.cumsum(self._held(r)) - self._held(r)
            place = before[part[of]] + local[of] // len(self.counts)
            out[of] = self._starts[r] + permute(place, int(self._starts[r + 1] - self._starts[r]), _key(self.key, r))
        return out

    def sequences(self, slots) -> tuple[np.ndarray, np.ndarray]:
        """(part, local) of each slot."""
        slots, n = np.asarray(slots, np.int64), len(self.counts)
        ranges = np.searchsorted(self._starts, slots, "right") - 1
        part, local = np.empty(len(slots), np.int64), np.empty(len(slots), np.int64)
        for r in np.unique(ranges).tolist():
            of = ranges == r
            place = permute(slots[of] - self._starts[r], int(self._starts[r + 1] - self._starts[r]), _key(self.key, r), inverse=True)
            ends = np.cumsum(self._held(r))
            part[of] = np.searchsorted(ends, place, "right")
            group = place - (ends - self._held(r))[part[of]]
            local[of] = group * n + permute(np.full(len(group), r), n, _key(self.key, part[of], group), inverse=True)
        return part, local


def _sequences(docs: DataFrame, vocabulary: str, end_id: int, length: int) -> DataFrame:
    """part, local, doc_id, doc_start (ids of that document before the sequence), n_ids, ids_crc32, ends (of documents in it), body (the ids, packed)."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encode, part, pack = _tokens.encoder(vocabulary, special=False), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1).compress
        held, size, first, stops, local = [], 0, [], [], 0  # ids not cut yet; (place among them, doc_id, ids before that place) of their documents; places where documents end

        def cuts(last: bool):
            nonlocal held, size, first, stops, local
            ids = np.concatenate(held)
            places, at, rows = [p for p, _, _ in first], 0, []
            while size - at >= length or (last and at < size):
                place, doc, before = first[int(np.searchsorted(places, at, "right")) - 1]
                one = ids[at : at + length]
                ends = int(np.searchsorted(stops, at + len(one), "right") - np.searchsorted(stops, at, "right"))
                rows.append((part, local, doc, before + at - place, len(one), zlib.crc32(one), ends, pack(one.tobytes())))
                local += 1
                at += length
            k = int(np.searchsorted(places, at, "right")) - 1
            place, doc, before = first[k]
            first = [(0, doc, before + at - place)] + [(p - at, d, b) for p, d, b in first[k + 1 :]]
            held, size, stops = [ids[at:]], max(0, size - at), [s - at for s in stops if s > at]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 7 + (pa.binary(),), strict=True)], names=["part", "local", "doc_id", "doc_start", "n_ids", "ids_crc32", "ends", "body"])

        for batch in _shared.slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), _shared.decoded(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u2")
                first.append((size, doc, 0))
                held.append(ids)
                size += len(ids)
                stops.append(size)
                if size >= 256 * length:
                    yield cuts(False)
        if size:
            yield cuts(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "part long, local long, doc_id long, doc_start long, n_ids long, ids_crc32 long, ends long, body binary")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, key: int, vocabulary: str | None = None, end_id: int = 50256, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Writes the shards below ``path`` and returns one row per sequence, by where it went.

    slot, shard, record (its number in the shard), part and local (where the sequence was cut), parts (how many there are), n_ids,
    ids_crc32, doc_id and doc_start: whose id comes first and how many ids of that document precede it. The order depends on the key
    and on how the input is partitioned. Null texts are empty: they give ``end_id`` alone.
    Repeated rows are written each, a null doc_id stays null, other columns aren't read. An empty table gives no shard. ids must
    be below 65536. A special token's string in a text is ordinary text, so that only ends of documents have ``end_id``.
    """
    _shared.prepare(spark)
    rows = _sequences(docs, vocabulary or _tokens.default_vocabulary(), end_id, length).rdd
    parts = max(1, rows.getNumPartitions())

    def ranged(batch):
        to = _range([r[0] for r in batch], [r[1] for r in batch], parts, key).tolist()
        return ((t, tuple(r)) for t, r in zip(to, batch, strict=True))

    def in_batches(of):
        batch = []
        for r in of:
            batch.append(r)
            if len(batch) == 4096:
                yield from ranged(batch)
                batch = []
        yield from ranged(batch)

    def placed(r, of):
        of = [x[:7] for _, x in of]
        by, places = _order(of, r, key)
        return ((r, p, *of[i]) for i, p in zip(by, places.tolist(), strict=True))

    ranges = rows.mapPartitions(in_batches).partitionBy(parts, lambda r: r)
    index = _shared.table(spark, spark.createDataFrame(ranges.mapPartitionsWithIndex(placed), "range long, place long, part long, local long, doc_id long, doc_start long, n_ids long, ids_crc32 long, ends long"), "sequences")
    shifts, total = {}, 0
    for r, n in sorted((x[0], x[1]) for x in index.groupBy("range").agg(F.count(F.lit(1))).collect()):  # a row per partition
        shifts[r] = total
        total += n

    ended, there = index.agg(F.sum("ends")).first()[0] or 0, docs.count()
    if ended != there:
        raise ValueError(f"{there} documents, but the sequences end {ended}: the input changed between jobs")

    def records(r, of):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        of = [x for _, x in of]
        by, places = _order(of, r, key)
        for slot, i in enumerate(np.asarray(by, np.int64)[np.argsort(places)].tolist(), shifts.get(r, 0)):
            part, local, _, _, n, crc, _, body = of[i]
            ids = unpack(body)
            if len(ids) != 2 * n or zlib.crc32(ids) != crc:
                raise ValueError(f"sequence {local} of partition {part} changed on its way")
            yield slot // shard, bytearray(struct.pack(HEAD, slot, local * parts + part, n, crc) + ids.ljust(2 * length, b"\0"))

    if total:
        lines = spark.createDataFrame(ranges.mapPartitionsWithIndex(records), "shard long, value binary").select("shard", F.col("value").cast("string").alias("value"))
        lines.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").mode("overwrite").text(path)
    moved = spark.createDataFrame(list(shifts.items()), "range long, shift long")
    out = index.join(F.broadcast(moved), "range").withColumn("slot", F.col("place") + F.col("shift"))
    return out.select("slot", F.floor(F.col("slot") / shard).cast("long").alias("shard"), (F.col("slot") % shard).alias("record"), "part", "local", F.lit(parts).cast("long").alias("parts"), "n_ids", "ids_crc32", "doc_id", "doc_start")


def read_slots(spark: SparkSession, path: str, start: int, stop: int, length: int = LENGTH, shard: int = SHARD):
    """(slot, number, ids) of the slots start..stop-1 in order, a shard at a time: only the shards that hold them are opened."""
    size = stride(length)
    for k in range(start // shard, -(-stop // shard)):
        files = spark.read.format("binaryFile").load(f"{path}/shard={k}").select("path", "content").collect()
        data = b"".join(bytes(content) for _, content in sorted((int(re.search(r"part-(\d+)", f[0].rsplit("/", 1)[1])[1]), f[1]) for f in files))
        for s in range(max(start, k * shard), min(stop, (k + 1) * shard)):
            at = (s - k * shard) * size
            if at >= len(data):
                return
            slot, number, n, crc = struct.unpack_from(HEAD, data, at)
            ids = np.frombuffer(data, "<u2", n, at + HEAD_BYTES)
            if slot != s or zlib.crc32(ids) != crc:
                raise ValueError(f"shard {k} is damaged at slot {s}")
            yield slot, number, ids
