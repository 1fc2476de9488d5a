"""What crosses into the generator's workers, and how often its answers are parsed."""

import pandas as pd
from pyspark.sql import functions as F

from threadlens.functions.json import objects, variant_text
from threadlens.operators.generate import StubGenerator, TextGenerator, generate
from threadlens.session import bound_arrow_batches

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prompts_of(spark, n, chars=10):
    return spark.range(n).coalesce(1).select(
        F.lit("c").alias("corpus"), F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("row_idx"),
        F.repeat(F.lit("p"), chars).alias("user_prompt"),
    )


def sizes():
    """A generator that answers with the prompts and characters of its call."""

    class Sizes(TextGenerator):
        def generate(self, batch, system_prompt):
            said = f"{len(batch)} {batch['user_prompt'].str.len().sum()}"
            return pd.DataFrame({"response": [said] * len(batch), "error": [None] * len(batch), "ts": [0.0] * len(batch)})

    return Sizes()


def test_long_prompts_come_in_batches_of_bounded_bytes(spark):
    got = generate(prompts_of(spark, 400, 100_000).withColumn("attempt", F.lit(0)), sizes(), keep=True)
    said = [tuple(map(int, r.response.split())) for r in got.select("response").collect()]
    assert len(said) == 400 and max(n for _, n in said) <= 5_000_000
    assert got.where(F.length("user_prompt") == 100_000).count() == 400


def test_a_session_with_its_own_batch_size_keeps_it(spark):
    before = spark.conf.get(SETTING)
    try:
        spark.conf.set(SETTING, "1234567b")
        bound_arrow_batches(spark)
        assert spark.conf.get(SETTING) == "1234567b"
    finally:
        spark.conf.set(SETTING, before)


def test_tries_are_the_attempts_one_by_one(spark):
    some = prompts_of(spark, 700)
    each = some.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(19))))
    one, all_ = generate(some, StubGenerator(), tries=20), generate(each, StubGenerator())
    assert one.dtypes == all_.dtypes and one.count() == 14_000
    assert one.exceptAll(all_).isEmpty() and all_.exceptAll(one).isEmpty()
    calls = generate(some, sizes(), tries=20, batch_rows=50).select("response").distinct().collect()
    assert max(int(r.response.split()[0]) for r in calls) <= 50


def test_an_answer_is_parsed_once(spark):
    texts = ['{"act":"Claim","self/reported":true}', '{"act":1} x', '{"a":1}] [{"a":2}', '[1]', None, "{}", '{"self/reported":0}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = objects(df, F.col("t"), "j").select("i", variant_text(F.col("j.`self/reported`")).alias("v"))
    assert {r.i: r.v for r in got.collect()} == {0: "True", 5: "", 6: ""}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("StructsToJsonEvaluator") == 1


def test_queries_parse_an_answer_once(spark):
    import __spark_entry__ as E

    for name in ("valid_acts", "meta_tags", "politeness_codes", "annotation_json", "parse_responses"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, name


def test_exports_are_written_by_all_ranges(spark, tmp_path):
    """A few short threads: their files come from as many tasks as there are ranges, in order."""
    import glob
    import re

    from threadlens.sources.exports import read_exports, write_exports

    rows = [("thr", "threaded", t, i, i + 1, 1, "u", f"m{t}.{i}", None, "Reply") for t in range(16) for i in range(2)]
    schema = "corpus string, layout string, thread_id long, row_idx long, msg_id long, utt_no long, user_id string, message string, reply_to string, category string"
    utt = spark.createDataFrame(rows, schema)
    seq = utt.withColumns({"layout": F.lit("sequential"), "corpus": F.lit("seq")})
    write_exports(utt.unionByName(seq), str(tmp_path))
    files = glob.glob(f"{tmp_path}/threaded/*/*/*.parquet")
    assert len({re.search(r"part-(\d+)", f)[1] for f in files}) > 4
    got = read_exports(spark, str(tmp_path)).select("corpus", "thread_id", "row_idx", "message").collect()
    assert sorted(map(tuple, got)) == sorted((c, t, i, f"m{t}.{i}") for c in ("thr", "seq") for t in range(16) for i in range(2))
