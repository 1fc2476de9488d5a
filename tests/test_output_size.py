"""What a run's output takes of the disk: its files, and the shuffles on the way there."""

import os
import time

from pyspark.sql import functions as F

from threadlens.operators.output import read_run, write_annotations
from threadlens.operators.resume import read_annotations

SYSTEM = "".join(chr(33 + i * i * 7 % 90) for i in range(15_000)).replace('"', "'")


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = store.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def table(spark, n=400):
    odd = F.element_at(F.array(*map(F.lit, ["a\nb", 'say "no"', "c,d", "", "\\ ü"])), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(n).repartition(2, "id").select(
        F.lit("c").alias("corpus"), F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("row_idx"),
        F.concat(F.lit(SYSTEM), F.col("id").cast("string"), odd).alias("raw_prompt"), odd.alias("raw_response"),
    )


def test_the_system_prompt_of_every_row_takes_little_room(spark, tmp_path):
    base = str(tmp_path)
    write_annotations(table(spark), base, "r", csv=True)
    text = 400 * len(SYSTEM)
    assert folder_bytes(f"{base}/csv") < text / 20 and folder_bytes(f"{base}/table") < text / 20
    cols = ["corpus", "row_idx", "raw_prompt", "raw_response"]
    want = sorted(tuple(map(str, r)) for r in table(spark).select(*cols).collect())
    for got in (read_run(spark, base), read_annotations(spark, f"{base}/csv/run_id=r", "csv")):
        assert sorted(tuple(map(str, r)) for r in got.select(*cols).collect()) == want


def test_shuffles_end_with_the_write(spark, tmp_path):
    from threadlens.session import shuffles_end_with_the_job

    before, conf = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    kept = spark.range(1000).repartition(5, "id")
    kept.write.parquet(f"{tmp_path}/kept")
    left = shuffle_files(spark) - before
    with shuffles_end_with_the_job(spark):
        spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{tmp_path}/gone")
    until = time.time() + 20
    while (more := shuffle_files(spark) - before - left) and time.time() < until:
        time.sleep(0.2)
    assert left and not more and spark.conf.get(conf) == was


def test_a_run_leaves_no_shuffles(spark, tmp_path):
    before = shuffle_files(spark)
    write_annotations(table(spark), str(tmp_path), "r", csv=True)
    until = time.time() + 20
    while (more := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not more and read_run(spark, str(tmp_path)).count() == 400


def csv_rows(spark, df, base):
    """What the export says, as text: null and '' differ."""
    write_annotations(df, base, "r", csv=True)
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{base}/csv/run_id=r")
    return back.columns, sorted(map(repr, back.collect()))


def test_the_export_has_the_rows_as_they_came(spark, tmp_path):
    """Corpora that look like numbers or dates keep their text, '' is not null; columns keep their order."""
    names = ["007", "1.50", "2020-01-01", "a/b c%=x", "true", None]
    for k, corpora in enumerate((names, [*names, ""])):
        rows = [(i, c, v, i / 3 if i % 2 else None) for i, (c, v) in enumerate((c, v) for c in corpora for v in ("", None, "x"))]
        df = spark.createDataFrame(rows, "row_idx long, corpus string, said string, n double")
        df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{tmp_path}/plain{k}")
        plain = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{tmp_path}/plain{k}")
        assert csv_rows(spark, df, f"{tmp_path}/{k}") == (plain.columns, sorted(map(repr, plain.collect())))


def test_a_run_is_computed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = table(spark, 40)
    write_annotations(df.mapInPandas(count, df.schema), str(tmp_path), "r", csv=True)
    assert calls.value == 40
