"""Language identification by interpolated Kneser-Ney models of characters.

Counts of character n-grams per language cover every training document. Lower orders use continuation counts (how many different
characters precede a shorter n-gram), each order has its own discount n1 / (n1 + 2 n2), and the lowest interpolates with the
uniform distribution. A model is a few sorted arrays of n-gram keys (sixteen bits a character; letters beyond U+FFFF share the
codes of the private use area) with one column of probabilities per language. A text gets the language of the lowest cross-entropy per character;
it is rejected if that is above what the language's own training documents have in a model of the others.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _shared

ORDER = 4
#: n-grams of the highest order, about, that are collected at a time; a model holds all there are.
COLLECTED = 2_000_000
#: Letters that count towards the confidence; more would only saturate it.
CONFIDENT = 50
#: Share of a language's documents that its limit of rejection keeps, of those that its model hasn't learnt from.
QUANTILE = 0.999
#: Nats per character to which limits are rounded up.
BIN = 0.01
UNKNOWN = "und"
_BITS, _SPACE, _PAD = 16, 32, 0
_PAD_CHAR = chr(0x10FFFF)
_CHUNK = 1 << 18
_folds: list[np.ndarray] = []
_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> sixteen bits: letters and marks in lower case, everything else a space."""
    if not _folds:
        out = np.full(0x110000, _SPACE, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] in "LM":
                x = ord(c.lower()[0])
                out[i] = x if x < 0x10000 else 0xE000 + x * 2654435761 % 0x1900
        out[0x10FFFF] = _PAD
        _folds.append(out)
    return _folds[0]


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter; a mark alone is none."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _chunks(texts: list[str]):
    """(numbers of texts, the texts) of about _CHUNK characters; longer texts are cut, each part with the same number. Accents are composed first."""
    ids, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        for at in range(0, len(text), _CHUNK):
            part = text[at : at + _CHUNK]
            if size and size + len(part) > _CHUNK:
                yield ids, parts
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield ids, parts


def _grams(parts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, number of the part each belongs to, letters by part)."""
    pad = _PAD_CHAR * (order - 1)
    codes = np.frombuffer((pad + pad.join(parts)).encode("utf-32-le", "replace"), np.uint32)
    m = _fold()[codes].astype(np.int64)
    every = part = np.repeat(np.arange(len(parts)), [len(p) + order - 1 for p in parts])
    keep = np.ones(len(m), bool)
    keep[1:] = (m[1:] != _SPACE) | (m[:-1] != _SPACE)
    m, part = m[keep], part[keep]
    key = np.zeros(len(m), np.int64)
    for i in range(order):
        key[i:] |= m[: len(m) - i] << (_BITS * i)
    real = m != _PAD
    letter = _is_letter()[codes]
    letter[codes == ord(_PAD_CHAR)] = False
    return key[real], part[real], np.bincount(every[letter], minlength=len(parts))


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over every whole text; summed within a task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        held: dict[str, list] = {}

        def flush():
            for lang, parts in held.items():
                keys, counts = _sum_by_key(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + 100_000])], names=["lang", "gram", "n"])
            held.clear()

        for batch in _shared.slices(batches):
            texts, langs = _shared.decoded(batch.column(0)), batch.column(1).to_pylist()
            for lang in set(langs):
                for _, parts in _chunks([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    keys = np.sort(_grams(parts, order)[0])
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                    mine = held.setdefault(lang, [])
                    mine.append((keys[first], np.diff(np.append(first, len(keys)))))
                    if len(mine) >= 8:
                        mine[:] = [_sum_by_key(np.concatenate([k for k, _ in mine]), np.concatenate([c for _, c in mine]))]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 1_000_000:
                yield from flush()
        yield from flush()

    one = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, gram long, n long")
    return one.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """keys[n], probabilities[n]: n-grams of order n, a row for each, a column per language. gammas[n]: the same for their contexts."""

    langs: list[str]
    order: int
    keys: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]
    uniform: float

    def probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        """P(last character | those before) in every language."""
        if not n:
            return np.full((len(keys), len(self.langs)), self.uniform, np.float32)
        at = np.minimum(np.searchsorted(self.keys[n], keys), max(len(self.keys[n]) - 1, 0))
        hit = self.keys[n][at] == keys if len(self.keys[n]) else np.zeros(len(keys), bool)
        out = self.probabilities[n][at] if len(self.keys[n]) else np.empty((len(keys), len(self.langs)), np.float32)
        if not hit.all():
            miss = keys[~hit]
            out[~hit] = self.gamma(miss >> _BITS, n) * self.probability(miss & ((1 << _BITS * (n - 1)) - 1), n - 1)
        return out

    def gamma(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """The weight of the order below after each context; 1 where a language hasn't met it."""
        if not len(self.contexts[n]):
            return np.ones((len(contexts), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.contexts[n], contexts), len(self.contexts[n]) - 1)
        return np.where((self.contexts[n][at] == contexts)[:, None], self.gammas[n][at], np.float32(1))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character by text and language, letters by text)."""
        total, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for ids, parts in _chunks(texts):
            keys, part, many = _grams(parts, self.order)
            if len(keys):
                logs = np.log(self.probability(keys, self.order))
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                who = np.asarray(ids)[part[first]]
                np.add.at(total, who, np.add.reduceat(logs, first, axis=0, dtype=np.float64))
                np.add.at(n, who, np.diff(np.append(first, len(part))))
            np.add.at(letters, ids, many)
        return -total / np.maximum(n, 1)[:, None], letters


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The model of n-gram counts: language -> (keys, counts)."""
    langs = sorted(counts)
    by_lang = {x: {order: _sum_by_key(*counts[x])} for x in langs}
    for x in langs:
        for n in range(order - 1, 0, -1):
            longer = by_lang[x][n + 1][0]
            by_lang[x][n] = _sum_by_key(longer & ((1 << _BITS * n) - 1), np.ones(len(longer), np.int64))
    symbols = np.unique(np.concatenate([by_lang[x][1][0] for x in langs] or [np.zeros(0, np.int64)]))
    model = Model(langs, order, [np.zeros(0, np.int64)] * (order + 1), [np.zeros((0, len(langs)), np.float32)] * (order + 1), [np.zeros(0, np.int64)] * (order + 1), [np.zeros((0, len(langs)), np.float32)] * (order + 1), 1 / (len(symbols) + 1))
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([by_lang[x][n][0] for x in langs] or [np.zeros(0, np.int64)]))
        contexts = np.unique(keys >> _BITS)
        gammas, own = np.ones((len(contexts), len(langs)), np.float32), np.zeros((len(keys), len(langs)), np.float32)
        for j, x in enumerate(langs):
            k, c = by_lang[x][n]
            if not len(k):
                continue
            once, twice = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, total = _sum_by_key(k >> _BITS, c)
            _, types = _sum_by_key(k >> _BITS, np.ones(len(k), np.int64))
            gammas[np.searchsorted(contexts, context), j] = discount * types / total
            own[np.searchsorted(keys, k), j] = np.maximum(c - discount, 0) / total[np.searchsorted(context, k >> _BITS)]
        model.contexts[n], model.gammas[n] = contexts, gammas
        own += model.gamma(keys >> _BITS, n) * model.probability(keys & ((1 << _BITS * (n - 1)) - 1), n - 1)
        model.keys[n], model.probabilities[n] = keys, own
    return model


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(modulus))


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER, collected: int = COLLECTED) -> Model:
    """Counts every whole text of ``docs`` that has a lang; the model holds all n-grams, collected about ``collected`` at a time."""
    _shared.prepare(spark)
    counts = _shared.table(spark, count_grams(docs.where(F.col("lang").isNotNull()), order), "grams")
    passes = max(1, -(-counts.count() // collected))
    held: dict[str, list] = {}
    for i in range(passes):
        some = counts if passes == 1 else counts.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(passes)) == i)
        for x, g in some.toPandas().groupby("lang"):
            held.setdefault(x, []).append((g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)))
    return build({x: (np.concatenate([k for k, _ in of]), np.concatenate([n for _, n in of])) for x, of in held.items()}, order)


def slack(letters: np.ndarray) -> np.ndarray:
    """Nats per character by which a text of so many letters may differ by chance."""
    return 4 / np.sqrt(np.maximum(letters, 1))


def _best(model: Model, texts: list[str]):
    """(language, score, entropy, whether there is one, letters) of each text."""
    names = np.array(model.langs, dtype=object)
    entropy, letters = model.entropies(texts)
    if not len(names):
        entropy = np.zeros((len(texts), 1))
    known = (letters > 0) & bool(len(names))
    best = entropy.argmin(axis=1) if len(texts) else np.zeros(0, np.int64)
    low = entropy[np.arange(len(texts)), best]
    weight = np.exp(-(entropy - low[:, None]) * np.minimum(letters, CONFIDENT)[:, None])
    certain = np.where(known, 1 / weight.sum(axis=1), 0.0)
    lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return lang, certain, low, known, letters


def judge(model: Model, texts: list[str], limits: dict[str, float] | None):
    """(language, score, entropy, whether there is one, rejected) of each text."""
    lang, certain, low, known, letters = _best(model, texts)
    far = ~known
    if limits is not None:
        far = far | (low > np.array([limits.get(x, np.inf) for x in lang]) + slack(letters))
    return lang, certain, low, known, far


def score(spark: SparkSession, docs: DataFrame, model: Model, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, one row per row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and rejected. Ties go to the language that sorts first.
    ``limits``: those of calibrate(); without them only ``und`` is rejected. Without a language to choose
    from everything is ``und``.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            lang, certain, low, known, far = judge(shared.value, _shared.decoded(batch.column(1)), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(certain, pa.float64()), pa.array(np.where(known, low, np.nan), pa.float64(), mask=~known), pa.array(far)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, limits: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            far = judge(shared.value, _shared.decoded(batch.column(batch.schema.get_field_index("text"))), limits)[-1]
            yield batch.filter(pa.array(~far))

    return docs.mapInArrow(run, docs.schema)


def calibrate(spark: SparkSession, docs: DataFrame, model: Model) -> dict[str, float]:
    """The limit of each language of ``model``: what its training documents have where they weren't learnt from.

    All documents with a lang are dealt to two halves by their texts, so that copies stay together, and each half is scored by the
    models of the other. The limit is the QUANTILE of entropy less slack(letters) over those recognised as what they are. A language
    with too few of them to have that quantile gets its mean plus the quantile of the distances to the means over all languages, if
    that is more. No limit is below the mean entropy, so that long texts pass where only short ones set it. A language with none has
    the largest limit of the others, or else the entropy of the uniform distribution.
    """
    known = docs.where(F.col("lang").isNotNull()).withColumn("half", F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(2)))
    shared = spark.sparkContext.broadcast([train(spark, known.where(F.col("half") != i)) for i in range(2)])

    def run(batches):
        import pyarrow as pa

        for batch in _shared.slices(batches):
            texts, langs, halves = _shared.decoded(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, other in enumerate(shared.value):
                mine = [j for j, h in enumerate(halves) if h == i]
                lang, _, low, real, letters = _best(other, [texts[j] for j in mine])
                kept = [j for j, k in enumerate(mine) if real[j] and lang[j] == langs[k]]
                yield pa.RecordBatch.from_arrays([pa.array([lang[j] for j in kept], pa.string()), pa.array(low[kept], pa.float64()), pa.array(low[kept] - slack(letters[kept]), pa.float64())], names=["lang", "entropy", "above"])

    own = known.select(F.col("text").cast("string"), F.col("lang").cast("string"), "half").mapInArrow(run, "lang string, entropy double, above double")
    bins = own.groupBy("lang", F.ceil(F.col("above") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("many"), F.sum("above").alias("total"), F.sum("entropy").alias("entropy")).collect()
    return _limits(model, [tuple(r) for r in bins])


def _limits(model: Model, bins: list[tuple[str, int, int, float, float]]) -> dict[str, float]:
    """The limits of calibrate() from (lang, bin, documents, sum of entropy less slack, sum of entropy); bins end at multiples of BIN."""

    def quantile(values: list[tuple[float, int]]) -> float:
        passed, wanted = 0, QUANTILE * sum(n for _, n in values)
        for value, n in sorted(values):
            passed += n
            if passed >= wanted:
                break
        return value

    by_lang: dict[str, list[tuple[int, int, float, float]]] = {}
    for lang, *one in bins:
        by_lang.setdefault(lang, []).append(tuple(one))
    many = {x: sum(n for _, n, *_ in of) for x, of in by_lang.items()}
    mean = {x: sum(t for _, _, t, _ in of) / many[x] for x, of in by_lang.items()}
    out = {x: quantile([(b * BIN, n) for b, n, *_ in of]) for x, of in by_lang.items()}
    if out:
        apart = quantile([(b * BIN - mean[x], n) for x, of in by_lang.items() for b, n, *_ in of])
        out = {x: max(y, mean[x] + apart) if many[x] * (1 - QUANTILE) < 1 else y for x, y in out.items()}
        out = {x: max(y, sum(e for *_, e in by_lang[x]) / many[x]) for x, y in out.items()}
    return {x: out.get(x, max(out.values(), default=-np.log(model.uniform))) for x in model.langs}


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from the documents whose remainder modulo 3 is not 1, and scores all: doc_id, held_out, lang_pred, score, entropy, rejected.

    A row without doc_id is held out. Repeated rows count and are scored each. Other columns aren't read; an empty table gives no rows.
    """
    held_out = F.coalesce(remainder(3) == 1, F.lit(True))
    learn = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(~held_out)
    model = train(spark, learn)
    return score(spark, docs, model, calibrate(spark, learn, model)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")
