"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import _shared, ann, chat_format, decontamination, language_id, near_dups, packing, quality, secret_scan, substring_dedup, training_order

LONG = " ".join(f"w{i % 977}" for i in range(200_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, kept string, start string, score string"


def rows():
    texts = [None, "", "   \n", "one", "two words", "ümläut ñandú", LONG, "repeat this sentence here " * 12, "repeat this sentence here " * 12, "tok = ퟿\U0010fffd \x00 end", "x" * 100_000]
    out = [(i, t, "en" if i % 2 else None, "s", None, "a", None, "b", None) for i, t in enumerate(texts)]
    return [*out, out[7], out[6], (None, "no id at all " * 9, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 0), (4, None, 1), (None, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")


BENCHMARK = [(0, "repeat this sentence here " * 3), (1, None), (2, ""), (3, "one"), (None, "two words"), (0, "repeat this sentence here " * 3)]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def test_scan(docs, none):
    assert secret_scan.scan(docs).count() == docs.count()
    assert secret_scan.scan(none).count() == 0
    assert secret_scan.redacted(docs).columns == docs.columns


def test_quality(spark, docs, none, labels):
    r = {x["doc_id"]: x for x in quality.classify(spark, docs, labels).collect()}
    assert all(0 <= x["score"] <= 1 for x in r.values()) and r[None]["held_out"]
    assert quality.classify(spark, none, labels).count() == 0
    assert {x["score"] for x in quality.classify(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_language(spark, docs, none):
    r = {x["doc_id"]: x for x in language_id.identify(spark, docs).collect()}
    assert len(r) == len({x[0] for x in rows()}) and {r[i]["lang_pred"] for i in (0, 1, 2)} == {"und"}
    assert r[0]["score"] == 0 and r[0]["rejected"] and r[None]["held_out"]
    assert language_id.identify(spark, none).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_near_dups(spark, docs, none):
    got = near_dups.link(spark, docs, 4).collect()
    assert len(got) == docs.count() and near_dups.link(spark, none, 4).count() == 0
    by = {x["doc_id"]: x for x in got}
    assert by[8]["component_id"] == 7 and not by[8]["kept"] and by[7]["kept"]
    assert [by[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and by[None]["component_id"] is None and by[None]["kept"]
    with pytest.raises(ValueError):
        near_dups.link(spark, docs, 4, 70)


def test_near_dups_with_several_texts_of_one_id(spark):
    """One doc_id with three texts joins their groups; an empty text of it follows."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows_ = [(9, text("a")), (9, text("b")), (9, text("c")), (9, None), (3, text("b")), (5, text("c")), (11, text("a")), (12, text("d")), (13, text("d"))]
    got = near_dups.link(spark, spark.createDataFrame(rows_, "doc_id long, text string"), 4).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(9, 3), (3, 3), (5, 3), (11, 3), (12, 12), (13, 12)}
    assert {x["doc_id"] for x in got if x["kept"]} == {3, 12} and len(got) == len(rows_)


def test_substring(spark, docs, none):
    got = substring_dedup.dedup(spark, docs).collect()
    assert len(got) == docs.count() and substring_dedup.dedup(spark, none).count() == 0
    by = {x["doc_id"]: x for x in got}
    assert by[8]["n_removed"] == 48 and by[8]["kept"] == "" and by[0]["n_words"] == 0 and by[None]["n_removed"] == 0
    assert by[7]["n_removed"] == 44  # its own first window of each rotation stays


def test_packing(spark, docs, none):
    got = packing.pack(spark, docs).collect()
    assert packing.pack(spark, none).count() == 0
    assert sum(x["length"] for x in got if x["doc_id"] == 0) == 1
    assert sum(x["doc_tokens"] for x in got if x["start"] == 0) == sum(x["length"] for x in got)


def test_shards(spark, docs, none, tmp_path):
    got = training_order.write_shards(spark, docs, str(tmp_path / "s"), 3, shard=16)
    assert sorted(x["slot"] for x in got.collect()) == list(range(got.count()))
    assert training_order.write_shards(spark, none, str(tmp_path / "n"), 3).count() == 0


def test_decontamination(spark, docs, none, benchmark):
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(spark, docs, benchmark).collect()}
    assert got == {(7, 0), (8, 0), (3, 3)}
    assert decontamination.contaminated(spark, none, benchmark).count() == 0
    assert decontamination.contaminated(spark, docs, benchmark.limit(0)).count() == 0


def test_ann(spark):
    v = [(i, [float(i % 3), 1.0, float(i)]) for i in range(45)] + [(50, None), (60, [0.0, 0.0, 0.0]), (61, [1.0, None, 0.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (120, [1.0]), (None, [1.0, 1.0, 1.0]), (20, [2.0, 1.0, 20.0]), (44, [2.0, 1.0, 44.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.search(spark, df).collect()
    assert {x["query_id"] for x in got} == {0, 20, 40} and all(x["query_id"] != x["vec_id"] for x in got)
    assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 40] == list(range(44, 40, -1)) + list(range(39, 23, -1))
    few = ann.search(spark, df.where("vec_id < 3")).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in few) == [(0, 1, 2, 1.0), (0, 2, 1, 1.0)] or sorted((x["query_id"], x["rank"], x["vec_id"]) for x in few) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(spark, df.limit(0)).count() == 0


def test_ann_ties(spark):
    df = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(60)], "vec_id long, embedding array<float>")
    got = ann.search(spark, df).collect()
    assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 20] == list(range(20))


def test_chat(spark):
    t = [(0, 0, "user", "a"), (1, 0, "user", "a"), (0, 1, "assistant", "b<|im_end|>"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (2, 0, None, None), (3, 0, None, None), (4, 5, "assistant", "solo"), (None, 0, "user", "x"), (6, None, "user", "x")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    df = df.withColumn("pair_id", F.floor(F.col("conv_id") / 2)).withColumn("side", F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected"))
    got = sorted(tuple(r) for r in chat_format.format_pairs(df).collect())
    h = len("<|im_start|>assistant\n")
    end = "<|im_end|>\n"
    assert got == sorted([
        (0, "prompt", 0, "user", f"<|im_start|>user\na{end}", 0, h - 5 + 1 + len(end), 0, 0),
        (0, "chosen", 1, "assistant", f"<|im_start|>assistant\nb< |im_end|>{end}", 0, h + 12 + len(end), h, 12 + len(end)),
        (0, "rejected", 1, "assistant", f"<|im_start|>assistant\nc{end}", 0, h + 1 + len(end), h, 1 + len(end)),
        (1, "prompt", 0, "", f"<|im_start|>\n{end}", 0, h - 9 + len(end), 0, 0),
        (2, "chosen", 5, "assistant", f"<|im_start|>assistant\nsolo{end}", 0, h + 4 + len(end), h, 4 + len(end)),
    ])
    assert chat_format.format_pairs(chat_format.pair_answers(df.limit(0))).count() == 0
    got = sorted((r["pair_id"], r["part"], r["turn"], r["piece"]) for r in chat_format.format_pairs(chat_format.pair_answers(df)).collect())
    assert got == [(0, "chosen", 1, f"<|im_start|>assistant\nb< |im_end|>{end}"), (0, "prompt", 0, f"<|im_start|>user\na{end}"), (0, "rejected", 1, f"<|im_start|>assistant\nc{end}")]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, benchmark, tmp_path, empty):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    d = none if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        new = _shared.table(spark, stage(spark, d, str(tmp_path)), "stage")
        if name != "packing":
            assert new.columns == docs.columns
        d = new
    assert d.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert empty == (d.count() == 0)


def test_every_language_has_a_limit(spark):
    """Few documents among many, and only short ones, still set a limit for their language."""
    rows_ = [(i, f"aba cada bra {i % 7} " * 3, "x") for i in range(5000)] + [(5000 + i, f"zuzu momo {w} keke", "y") for i, w in enumerate(("pipi", "titi", "didi"))] + [(6000, "wyw", "z")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = language_id.train(spark, docs)
    limits = language_id.calibrate(spark, docs, model)
    assert set(limits) == {"x", "y", "z"} and all(0 < v < 20 for v in limits.values())
    lang, *_, far = language_id.judge(model, ["zuzu momo pipi keke", "zuqv wzmk pkkq vvzz " * 20], limits)
    assert lang[0] == "y" and not far[0] and far[1]


def test_models_hold_all_grams(spark):
    """A rare language beside a frequent one stays, and how many n-grams are collected at a time changes nothing."""
    rows_ = [(i, "the cat sat on the mat and the dog ran to the man", "x") for i in range(50)] + [(99, "zuzu momo", "y")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    one, many = language_id.train(spark, docs), language_id.train(spark, docs, language_id.ORDER, 20)
    assert one.langs == many.langs == ["x", "y"]
    for n in range(1, language_id.ORDER + 1):
        assert (one.keys[n] == many.keys[n]).all() and (one.probabilities[n] == many.probabilities[n]).all() and (one.gammas[n] == many.gammas[n]).all()


def test_contents_of_stages(spark, benchmark, tmp_path):
    """Rows without doc_id, or that share one, are judged like others, and nothing else is lost."""
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    words = lambda k, n=40: " ".join(f"{'abcdefgh'[k % 8]}{i * (k + 3) % 97}" for i in range(n))
    bad = "so " + "repeat this sentence here " * 3 + "it is"
    rows_ = [(7, words(1)), (7, words(2)), (None, words(1) + " more"), (None, words(3)), (3, words(2)), (3, words(2)), (None, bad), (9, bad + " x y z u v w"), (10, None), (11, ""), (None, None), (12, "password = hunter2hunter2 " + words(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1 if t is None else len(t), None, None, None, None) for i, t in rows_], SCHEMA)
    got = _shared.table(spark, corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), "near")
    assert got.columns == docs.columns
    out = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert out == sorted([(7, words(1)), (None, words(3)), (3, words(2)), (None, bad), (9, bad + " x y z u v w"), (10, None), (11, ""), (None, None), rows_[-1]], key=str)
    got = _shared.table(spark, corpus_pipeline.drop_contaminated(spark, got, str(tmp_path)), "clean")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == [x for x in out if x[1] is None or "repeat" not in x[1]]
    got = corpus_pipeline.redact_secrets(spark, got, str(tmp_path)).where("doc_id = 12").collect()
    assert got[0]["text"] == "[SECRET] " + words(5) and got[0]["n_chars"] == len(got[0]["text"])
    kept = corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} <= {7, 3, 9, 12, None} and all(r["text"] for r in kept)


def test_redacting_a_long_text():
    text = ("x " * 50_000 + "token=abcdefgh12 ") * 3
    spans = secret_scan.ordered(secret_scan.base_spans(text) + secret_scan.confirmed_spans(text))
    assert secret_scan.redact(text, spans) == ("x " * 50_000 + "[SECRET] ") * 3


def test_a_very_long_turn(spark):
    df = spark.createDataFrame([(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 300, "assistant", LONG), (1, "rejected", 300, "assistant", "no")], "pair_id long, side string, turn long, role string, text string")
    got = {(r["part"], r["turn"]): r for r in chat_format.format_pairs(df).collect()}
    assert set(got) == {("prompt", 0), ("chosen", 300), ("rejected", 300)}
    assert LONG in got["chosen", 300]["piece"] and got["chosen", 300]["start"] == 0 and got["chosen", 300]["loss_length"] == len(LONG) + len(chat_format.CLOSE)


def test_languages_that_tie(spark):
    """Equal models: the language that sorts first."""
    df = spark.createDataFrame([(1, "aba caba", "b"), (2, "aba caba", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.score(spark, df, language_id.train(spark, df)).collect()} == {"a"}
