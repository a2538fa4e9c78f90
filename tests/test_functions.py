"""Unit vectors for expressions."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import paths, text


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(("given_", "wanted"), [("x/y/../z", "x/z"), ("./a/./b/c/../d", "a/b/d"), ("../../a", "a"), ("a/..", ""), ("", "")])
def test_fold(spark, given_, wanted):
    assert one(spark, paths.fold_path(F.lit(given_))) == wanted


def test_paths(spark):
    assert one(spark, paths.clean_component_id(F.lit("repos\\RD\\LIB\\a.cwl"))) == "RD\\LIB\\a.cwl"
    assert one(spark, paths.clean_component_id(F.lit("RD\\repos\\a"))) == "RD\\repos\\a"
    same = lambda a, b: one(spark, paths.same_repo(F.lit(a), F.lit(b)))
    assert (same("RD\\L\\a", "RD\\L\\b"), same("RD\\L\\a", "RD\\V\\a"), same("a", "a")) == (True, False, False)
    assert one(spark, paths.workflow_folder(F.lit("RD/L/wf.cwl/step/x"))) == "RD/L"
    assert one(spark, paths.workflow_folder(F.lit("RD/L/wf.cwl"))) == "RD/L"
    assert one(spark, paths.step_target(F.lit("RD/L/wf.cwl"), F.lit("s"), F.lit("../t.cwl"), F.lit(False))) == "RD/t.cwl"
    assert one(spark, paths.step_target(F.lit("RD/L/wf.cwl"), F.lit("s"), F.lit(None).cast("string"), F.lit(True))) == "RD/L/wf.cwl/s"
    assert one(spark, paths.repo_name(F.lit("https://h/g/r.git/"))) == "r"
    assert one(spark, paths.project_path(F.lit("https://h.example/g/r"), "https://h.example")) == "g/r"
    assert one(spark, paths.stem(F.lit("a/b.c.cwl"))) == "b.c" and one(spark, paths.suffix(F.lit("a/b.c.cwl"))) == ".cwl" and one(spark, paths.suffix(F.lit("a/.b"))) == ""
    assert one(spark, paths.executable(F.lit("\\usr\\local\\bin\\x\\y.py"))) == "x/y.py"
    assert one(spark, paths.executable(F.lit("/opt/x"))) is None


def test_references(spark):
    refs = lambda e: [tuple(r) for r in one(spark, text.expression_references(F.lit(e)))]
    assert refs("$(inputs.a && steps.s1.outputs.o)") == [("parameter", "a"), ("step_output", "s1/o")]
    assert refs("$(steps.s1.outputs.o || inputs.aé)") == [("parameter", "aé"), ("step_output", "s1/o")]
    assert refs('$(inputs["a"])') == [] and refs("$(inputs.1a)") == []


def test_texts(spark):
    noise = lambda m: one(spark, text.is_noise_message(F.lit(m)))
    assert [noise(m) for m in ("Merge branch 'x'", "merge lists", "update docker image", "fix step")] == [True, False, True, False]
    assert one(spark, text.type_text(F.array(F.lit("null"), F.lit("File")))) == "null OR File"
    assert one(spark, text.has_word(F.lit("run a.b\\E+c now"), F.lit("a.b\\E+c")))
    assert not one(spark, text.has_word(F.lit("run xa.b now"), F.lit("a.b")))


def test_suffix(spark):
    for inner, outer, wanted in ((["S", "A"], ["W", "S", "A"], True), (["W"], ["W", "S"], False), ([], ["x"], False), ([], [], True), (["a", "b"], ["b"], False)):
        a, b = (F.array(*map(F.lit, x)).cast("array<string>") for x in (inner, outer))
        assert one(spark, text.suffix_of(a, b)) is wanted


def test_erfc(spark):
    for x in (-3.0, -0.5, 0.0, 0.3, 1.0, 4.0):
        assert one(spark, text.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-6, abs=1e-9)
