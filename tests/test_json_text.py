"""Texts as JSON string literals."""

import json

from pyspark.sql import functions as F

from threadlens.functions.json import json_string

TEXTS = ["", "a", '"', "[x]", "]", "\\", "line\nnext\ttab\r", "é ß – 漢字 😀", '["q"]', " [ ", "x" * 5000 + "漢"]


def test_literals_are_those_of_json_dumps(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").select("t", json_string(F.col("t")).alias("j"))
    assert {r.t: r.j for r in df.collect()} == {t: json.dumps(t, ensure_ascii=False) for t in [*TEXTS, None]}
    assert df.schema["j"].dataType.simpleString() == "string"


def test_brackets_are_cut_off_without_counting_characters(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(json_string(F.col("t")).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert "char_length" not in plan and "octet_length" in plan
