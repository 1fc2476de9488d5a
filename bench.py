"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line.  Each query is forced to
completion with the ``noop`` sink (every row computed, nothing collected);
one warm-up run, then the median of ``$BENCH_RUNS`` (default 3) runs.
The annotation queries start from scratch every run (fresh work folder), so
no run reuses an earlier run's ledger.  The input is the ``utterances`` table,
derived from ``conversations`` and stored once before timing starts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from threadlens.operators import context as C  # noqa: E402
from threadlens.operators.attempts import annotate  # noqa: E402
from threadlens.operators.generate import StubGenerator, generate  # noqa: E402
from threadlens.operators.output import annotated_output  # noqa: E402
from threadlens.operators.parse import parse_responses  # noqa: E402
from threadlens.operators.prompts import system_prompt_text, user_prompts  # noqa: E402
from threadlens.operators.resume import blank_annotations, resume_merge, todo_rows  # noqa: E402
from threadlens.session import local_session, scratch_path  # noqa: E402
from threadlens.sources.tables import utterances_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
REPLICATE = int(os.environ.get("BENCH_REPLICATE", "1"))
# attempts parsed per row by parse_responses; annotate and resume_merge run all tries
PARSED_ATTEMPTS = 3


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS) * 2, app="threadlens-bench")
    system = system_prompt_text(spark)
    utt = utterances_table(spark, SF_DIR)
    if REPLICATE > 1:
        span = utt.agg(F.max("thread_id")).first()[0] + 1
        copies = utt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(REPLICATE - 1))))
        copies = copies.withColumn("thread_id", F.col("thread_id") + F.col("_copy") * F.lit(span)).drop("_copy")
        path = scratch_path(spark, f"bench-x{REPLICATE}")
        copies.repartitionByRange("corpus", "thread_id", "row_idx").write.parquet(path)
        utt = spark.read.parquet(path)
    keys = C.KEY

    def q_context_sequential():
        force(C.context_sequential(utt.where(F.col("layout") != "threaded")))

    def q_context_threaded():
        force(C.context_threaded(utt.where(F.col("layout") == "threaded")))

    def q_prompts():
        force(user_prompts(utt))

    state = {}

    def q_parse_responses():
        if "asked" not in state:
            path = scratch_path(spark, "bench-prompts")
            user_prompts(utt).write.parquet(path)
            state["asked"] = spark.read.parquet(path)
        pend = state["asked"].withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(PARSED_ATTEMPTS - 1))))
        force(parse_responses(generate(pend, StubGenerator()).where(F.col("response").isNotNull())))

    def q_annotate():
        resolved, _ = annotate(user_prompts(utt), StubGenerator(), system, work_dir=scratch_path(spark, "bench-annotate"))
        force(resolved)

    def q_resume_merge():
        # a previous run's output with a quarter of the rows blanked, then resume
        if "prior" not in state:
            work = scratch_path(spark, "bench-prior")
            resolved, _ = annotate(user_prompts(utt), StubGenerator(), system, work_dir=work)
            prompts = spark.read.parquet(f"{work}/prompts")
            out = annotated_output(utt, resolved, prompts, system)
            prior_path = scratch_path(spark, "bench-prior-out")
            blank_annotations(out, (F.col("thread_id") + F.col("row_idx")) % 4 == 0).write.parquet(prior_path)
            state["prior"] = spark.read.parquet(prior_path)
            state["prompts"] = prompts
        prior = state["prior"]
        todo = todo_rows(utt, prior)
        pr = state["prompts"].join(todo.select(*keys), keys, "left_semi")
        resolved, _ = annotate(pr, StubGenerator(), system, work_dir=scratch_path(spark, "bench-resume"))
        force(resume_merge(prior, annotated_output(todo, resolved, state["prompts"], system)))

    benches = {
        "context_sequential": q_context_sequential,
        "context_threaded": q_context_threaded,
        "prompts": q_prompts,
        "parse_responses": q_parse_responses,
        "annotate": q_annotate,
        "resume_merge": q_resume_merge,
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    results = {}
    for name, fn in benches.items():
        if only and name not in only:
            continue
        fn()  # warm-up (JIT, Python workers, file listing caches)
        times = []
        for _ in range(RUNS):
            t = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t)
        results[name] = round(statistics.median(times), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": int(CPUS),
                "runs": RUNS,
                "replicate": REPLICATE,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
