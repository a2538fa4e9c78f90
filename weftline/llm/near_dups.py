"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles. Its sketch keeps the K smallest hashes. Equal sets become one node at once. Values
that two or more nodes retain make inverted lists; a pair as similar as asked shares at least T retained values, so of each
sketch only the rarest K - T + 1 values need a list, and what a third of all documents have in common lands in no list of theirs.
Every node is first paired with the most central one of its lists (that whose retained values are shared most), which joins groups
of copies with one pair per member; lists that still hold different components are then compared in blocks. Pairs whose union
sketch estimates too little similarity drop out, and the rest are confirmed on the full sets. Full sets are made from the texts
where they are wanted and meet in cells of bounded size: a centre with some of its members, or two blocks, so that a centre of
many members is sent once to each of its cells and no task holds more than a cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _hashing, _shared
from weftline.llm.components import components

#: Retained values; those that similar sets share at least. P(fewer | Jaccard 0.8) is 9.2e-10 for nested sets (binomial).
SKETCH, SHARED = 64, 30
#: Nodes, and shingles of their sets, in a block of those that are compared with one another.
BLOCK_NODES, BLOCK_SHINGLES = 512, 400_000
#: Shingles of a set that one row carries.
PART = 32_768


def _sets(texts: list[bytes | None], words: int):
    """(the set's hashes ascending, 64 bits that name it by them, 64 bits that name it by a second hash of its words) of each text."""
    for a, b in _hashing.groups(texts):
        one, two, bounds = _hashing.word_hashes(texts[a:b], lower=True, salts=(0, 1))
        h, first = _hashing.shingles(one, bounds, words)
        h, other = _hashing.positive(h), _hashing.mix(_hashing.shingles(two, bounds, words)[0])
        for i in range(b - a):
            s, at = np.unique(h[first[i] : first[i + 1]], return_index=True)
            yield s, int(_hashing.mix(s.astype(np.uint64)).sum().astype(np.int64)), int(other[first[i] + at].sum().astype(np.int64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), f1, f2 (128 bits that name the set), sketch (its SKETCH smallest hashes)."""

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            n, f1, f2, kept = [], [], [], []
            for s, x, y in _sets(_shared.texts_of(batch.column(1)), words):
                n.append(len(s))
                f1.append(x)
                f2.append(y)
                kept.append(s[:SKETCH])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], names=["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, f1, shingles: all hashes of each set, PART of them to a row."""

    def run(batches):
        import pyarrow as pa

        def batch_of(rows):
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, _, s in rows])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([s for _, _, s in rows]), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int64()), pa.array([f for _, f, _ in rows], pa.int64()), lists], names=["node", "f1", "shingles"])

        for batch in _shared.slices(batches):
            ids, rows, size = batch.column(0).to_pylist(), [], 0
            for i, (s, f, _) in enumerate(_sets(_shared.texts_of(batch.column(1)), words)):
                for at in range(0, len(s), PART):
                    rows.append((ids[i], f, s[at : at + PART]))
                    size += len(rows[-1][2])
                    if size >= 4 * PART:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).mapInArrow(run, "node long, f1 long, shingles array<long>")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """full_sets() joined to ``wanted`` (node and more, a stored table) by node; where few nodes are wanted, other texts aren't hashed."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    nodes = wanted.select(F.col("node").alias("doc_id")).distinct()
    if nodes.count() <= _shared.BROADCAST_ROWS:
        docs = docs.join(F.broadcast(nodes), "doc_id", "left_semi")
    # four numbers a row: few enough are sent, so that sets move once, into their cells
    return full_sets(docs, words).join(F.broadcast(wanted) if wanted.count() <= _shared.BROADCAST_ROWS // 4 else wanted, "node")


def _items(cell):
    """(node, first, component, set) arrays of what a cell's rows hold; the parts of a set become one again."""
    parts: dict[tuple, list] = {}
    for node, f1, first, component, s in zip(cell["node"], cell["f1"], cell["first"], cell["component"], cell["shingles"], strict=True):
        parts.setdefault((node, f1, bool(first), component), []).append(s)
    keys = list(parts)
    sets = [np.unique(np.concatenate(parts[k])) for k in keys]
    return np.array([k[0] for k in keys], np.int64), np.array([k[2] for k in keys], bool), np.array([k[3] for k in keys], np.int64), sets


def _compared(rows: DataFrame, cell: list[str], percent: int) -> DataFrame:
    """a, b: links between first and other sets of each cell whose components differ; without first ones, between all."""

    def compare(group):
        import pandas as pd

        ids, first, component, sets = _items(group)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        found = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in _links_between(sets, a if len(a) else b, b, component, percent)}
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)

    return rows.select(*cell, "node", "f1", "first", "component", "shingles").groupBy(*cell).applyInPandas(compare, "a long, b long")


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that allow the similarity."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _near_centres(spark: SparkSession, centres: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between nodes and their centres that union sketches don't rule out and full sets confirm."""
    pairs = centres.where((F.col("node") != F.col("centre")) & _alike(F.col("n"), F.col("centre_n"), percent))
    both = pairs.join(nodes.select("node", "n", "sketch"), ["node", "n"]).join(nodes.select(F.col("node").alias("centre"), F.col("n").alias("centre_n"), F.col("sketch").alias("other")), ["centre", "centre_n"])
    # of the union's smallest K values, those that both hold; K is all of them where both sets are whole
    union = F.array_sort(F.array_union("sketch", "other"))
    whole = (F.col("n") <= SKETCH) & (F.col("centre_n") <= SKETCH)
    held = F.size(F.array_intersect(F.when(whole, union).otherwise(F.slice(union, 1, SKETCH)), F.array_intersect("sketch", "other")))
    likely = F.when(whole, held * 100 >= F.size(union) * percent).otherwise(held >= F.least(F.lit(SHARED), F.floor(F.least("n", "centre_n") * SHARED / SKETCH)))
    likely = _shared.table(spark, both.where(likely).select("node", "n", "centre").distinct(), "likely")
    sizes = likely.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).alias("chunks"))
    members = likely.join(sizes, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), F.lit(False).alias("first"))
    heads = members.select(F.col("centre").alias("node"), "centre", "chunk", F.lit(True).alias("first")).distinct()
    wanted = _shared.table(spark, members.unionByName(heads).withColumn("component", F.col("node")), "cells")
    return _shared.table(spark, _compared(_wanted_sets(docs, wanted, words), ["centre", "chunk"], percent).distinct(), "links")


def link(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``.

    Words are runs of bytes other than ASCII space, A-Z lower-cased. A text of fewer words than a shingle is one shingle; a null or
    empty one, or one without words, has an empty set and no link. Documents are linked where 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable. Rows that share a doc_id are one document with all their texts. A row
    without doc_id takes no part: component_id null, kept true. Other columns aren't read; an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("SHARED is set for a similarity of 0.8 or more")
    _shared.prepare(spark)
    base = _shared.table(spark, sketches(docs, words), "sketches")
    sets = base.where("n > 0 and doc_id is not null")
    firsts = _shared.table(spark, sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "firsts")
    nodes = _shared.table(spark, sets.select(F.col("doc_id").alias("node"), "f1", "f2", "n", "sketch").join(firsts.select("node", "f1", "f2", "n"), ["node", "f1", "f2", "n"]).distinct(), "nodes")
    lists = _shared.table(spark, _lists(nodes, percent), "lists")
    centres = _shared.table(spark, _centres(lists), "centres")
    links = _near_centres(spark, centres, nodes, docs, words, percent)
    found = components(spark, links)
    now = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = now.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("value")
    open_lists = _shared.table(spark, now.join(spread, "value", "left_semi"), "open")
    if not open_lists.isEmpty():
        links = links.union(_among_blocks(spark, open_lists, centres, docs, words, percent))
    # copies follow the node of their set, so that only nodes are linked; a doc_id with several sets links them
    named = base.join(firsts.select("f1", "f2", "n", "node"), ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("doc_id")
    own = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(spark, links.union(own)).withColumnRenamed("node", "at")
    out = named.join(found, F.col("node") == F.col("at"), "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of rows linked as by link(), with all its columns: that of the smallest doc_id.

    Rows whose text is null, empty or without words stay. Where a doc_id is null or repeated, each row is a document of its own: of a
    group's rows that with the smallest doc_id stays, null after all others, ties to the row that was numbered first.
    """
    _shared.prepare(spark)
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("many")).where("many > 1 or doc_id is null")
    if odd.isEmpty():
        gone = link(spark, docs.select("doc_id", "text"), words, percent).where("not kept").select(F.col("doc_id").alias("gone"))
        key, rows = F.col("doc_id").cast("long"), docs
    else:
        name = "row"
        while name in docs.columns:
            name += "_"
        rows = _shared.table(spark, docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
        found = link(spark, rows.select(F.col(name).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("at"), "component_id")
        order = F.struct(F.col("id").isNull().alias("last"), "id", "at")
        found = _shared.table(spark, found.join(rows.select(F.col(name).alias("at"), F.col("doc_id").cast("long").alias("id")), "at"), "grouped")
        stays = found.groupBy("component_id").agg(F.min(order)["at"].alias("stays"))
        gone = found.join(stays, "component_id").where("at <> stays").select(F.col("at").alias("gone"))
        key = F.col(name)
    gone = _shared.table(spark, gone, "gone")
    # few enough are sent to the executors, so that no text moves
    out = rows.join(F.broadcast(gone) if gone.count() <= _shared.BROADCAST_ROWS else gone, key == F.col("gone"), "left_anti")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _centres(lists: DataFrame) -> DataFrame:
    """node, n, centre, centre_n: of the most central nodes of a node's lists the most central; for some that is the node itself."""
    best = lists.groupBy("value").agg(F.max_by(F.struct("central", F.col("node").alias("centre"), F.col("n").alias("centre_n")), F.struct("central", -F.col("node"))).alias("c"))
    met = lists.select("value", "node", "n").join(best, "value")
    return met.groupBy("node", "n").agg(F.max_by("c", F.struct("c.central", -F.col("c.centre"))).alias("c")).select("node", "n", "c.centre", "c.centre_n")


def _among_blocks(spark: SparkSession, open_lists: DataFrame, centres: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between nodes of different components that meet in a list.

    Nodes are put into blocks of bounded size, those of one centre together. Two blocks are compared if some list has nodes of
    both; so each pair of a list is met in one task of bounded memory, and only links leave it.
    """
    members = open_lists.select("node", "n", "component").distinct().join(centres.select("node", "centre"), "node")
    sizes = members.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).alias("chunks"))
    block = F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("chunks")))
    members = _shared.table(spark, members.join(sizes, "centre").select("node", "n", "component", block.alias("block")).distinct(), "members")
    spans = members.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    seen = open_lists.select("value", "node").join(members.select("node", "block"), "node").select("value", "block").distinct().join(spans, "block")
    x, y = (seen.select("value", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high"))) for k in "ab")
    fits = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    cells = _shared.table(spark, x.join(y, "value").where((F.col("block_a") <= F.col("block_b")) & fits).select("block_a", "block_b").distinct(), "cells")
    side = lambda mine: cells.join(members, F.col(mine) == F.col("block")).select("block_a", "block_b", F.lit(mine == "block_a").alias("first"), "node", "component")
    both = side("block_a").where("block_a <> block_b").unionByName(side("block_b").withColumn("first", F.lit(False)))
    wanted = _shared.table(spark, both, "meetings")
    return _shared.table(spark, _compared(_wanted_sets(docs, wanted, words), ["block_a", "block_b"], percent).distinct(), "block-links")


def _links_between(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, component: np.ndarray, percent: int):
    """Pairs (i of a, j of b) of different components that are similar enough: first by their sketches, then by their sets."""
    n = np.array([len(s) for s in sets])
    low = [s[:SKETCH] for s in sets]
    values, who = np.concatenate([low[j] for j in b] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(b)), [len(low[j]) for j in b])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    for i in a:
        left, right = np.searchsorted(values, low[i], "left"), np.searchsorted(values, low[i], "right")
        many = right - left
        hits = np.bincount(who[np.repeat(left - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())], minlength=len(b)) if many.any() else np.zeros(len(b), np.int64)
        least = np.minimum(np.minimum(n[i], n[b]) * SHARED // SKETCH, SHARED)
        maybe = b[(hits >= np.maximum(least, 1)) & (component[b] != component[i]) & (np.minimum(n[i], n[b]) * 100 >= np.maximum(n[i], n[b]) * percent)]
        if not len(maybe):
            continue
        every = np.concatenate([sets[j] for j in maybe])
        at = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
        inner = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.append(0, np.cumsum(n[maybe])[:-1]))
        yield from ((i, j) for j in maybe[inner * 100 >= (n[i] + n[maybe] - inner) * percent])


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """value, node, n, central: the inverted lists of the rarest retained values, by node."""
    held = nodes.select("node", "n", F.explode("sketch").alias("value"))
    often = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(often, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    # where all similar sets are whole in their sketches too, ceil(percent * n / 100) values are common; else SHARED
    need = F.when(F.col("n") * 100 <= SKETCH * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(SHARED))
    prefix = F.least("n", F.lit(SKETCH)) - need + 1
    room = prefix - (F.least("n", F.lit(SKETCH)) - F.size("values"))  # values that no other node retains come first
    cut = shared.where(room > 0).select("node", "n", F.slice("values", 1, room.cast("int")).alias("kept"), F.aggregate("values", F.lit(0.0), lambda s, v: s + F.log(v["df"].cast("double"))).alias("central"))
    return cut.select(F.explode("kept.value").alias("value"), "node", "n", "central")
