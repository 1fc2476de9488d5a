"""Quality rules with risk-controlled thresholds.

Every document is measured once (words, symbols, repeated lines, repeated five-word
windows).  Fixed base rules reject the plainly broken ones.  Further rules compare
one measure with a cutoff that is chosen on labelled documents, per stratum: a cutoff
may be used only when the exact binomial upper bound for its false rejections (labelled
good, rejected) stays below the rule's share of ``risk``.  All strata, rules and
cutoffs are tested at once, so the confidence is divided by their number
(Bonferroni).  Of the certified cutoffs the one with the most rejected bad less
rejected good labelled documents is taken, the laxest among equals; without a
certified cutoff the rule is off in that stratum.

Plan: measuring is one pass without a shuffle (array functions inside each row);
its narrow result is stored once and read for the calibration and for the verdicts.
Counts per stratum are pre-aggregated, so a hot stratum is no hot task.

Defined cases: null or blank text: no words, all counts 0, fails the base rules;
null stratum: a stratum of its own; no labels: base rules only; repeated rows are
judged row by row; a document's labels given twice count twice; extra columns are kept
(names that begin with ``_``: see ``clear_names``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import clear_names, stored, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
CUTOFFS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75)
# rule name -> numerator and denominator among the measures
RULES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
}
MAX_BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Risk:
    risk: float = 0.02  # largest accepted share of good documents rejected, per stratum
    delta: float = 0.05  # chance that any certified cutoff exceeds its share


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a struct ``_m`` of the measures."""
    df = docs.withColumn("_w", words_of(F.col(text)))
    n = F.size("_w")
    at = lambda i, k: F.get("_w", i + k)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    )
    df = df.withColumn("_h", hashes)
    # a repeated window makes a repeated hash; only then are the windows compared
    suspect = F.size(F.array_distinct("_h")) < F.size("_h")
    windows = F.when(
        F.coalesce(suspect, F.lit(False)),
        F.array_sort(
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.struct(F.concat_ws(" ", *[at(i, k) for k in range(WINDOW)]).alias("w"), i.alias("i")),
            )
        ),
    )
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_s", windows).withColumn("_l", lines)

    same = lambda i, k: F.coalesce(F.get("_s", i)["w"] == F.get("_s", i + k)["w"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: same(i, -1) | same(i, 1))
    starts = F.array_sort(F.transform(twice, lambda i: F.get("_s", i)["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        starts, zero,
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
    )["n"]
    body = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    return df.select(
        *docs.columns,
        F.struct(
            long(F.size("_w")).alias("n_words"),
            long(F.length(F.array_join("_w", ""))).alias("word_chars"),
            long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
            long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
            long(F.size("_l")).alias("n_lines"),
            long(F.when(F.col("_s").isNotNull(), covered).otherwise(0)).alias("n_repeat_words"),
        ).alias("_m"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def _share(m: Column, rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(m[bottom] > 0, m[top] / m[bottom]).otherwise(0.0)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    first = n * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(a["s"], t)
        return F.struct(t.alias("t"), (top + F.log1p(F.exp(F.least(a["s"], t) - top))).alias("s"))

    walked = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step)["s"]).otherwise(first)
    return F.when(k >= n, 1.0).otherwise(F.least(F.exp(walked), F.lit(1.0)))


def calibrate(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Certified cutoffs from ``(stratum, good, _m)``: stratum, one column per rule
    (null: rule off) and the counts they rest on."""
    m = F.col("_m")
    usable = labelled.where(~base_failed(m)).withColumns({f"_{r}": _share(m, r) for r in RULES})
    sums = [F.sum(F.col("good").cast("long")).alias("n")]
    for r in RULES:
        for i, c in enumerate(CUTOFFS):
            over = F.col(f"_{r}") > c
            sums.append(F.count_if(over & F.col("good")).alias(f"{r}_{i}_k"))
            sums.append(F.count_if(over & ~F.col("good")).alias(f"{r}_{i}_b"))
    counts = usable.groupBy("stratum").agg(*sums)
    tests = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"), F.lit(c).alias("cutoff"),
                F.col(f"{r}_{i}_k").alias("k"), F.col(f"{r}_{i}_b").alias("b"),
            )
            for r in RULES
            for i, c in enumerate(CUTOFFS)
        ]
    )
    share = risk.risk / len(RULES)
    strata = max(1, counts.count())
    level = risk.delta / (strata * len(RULES) * len(CUTOFFS))
    tried = counts.select("stratum", "n", F.explode(tests).alias("t")).where(F.col("t.k") <= F.col("n") * share)
    certified = tried.where(binomial_tail(F.col("t.k"), F.col("n"), F.lit(share)) <= level)
    best = certified.where(F.col("t.b") > F.col("t.k")).groupBy("stratum", F.col("t.rule").alias("rule")).agg(
        F.max_by("t.cutoff", F.struct((F.col("t.b") - F.col("t.k")).alias("gain"), F.col("t.cutoff"))).alias("cutoff")
    )
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """``measured`` plus booleans ``_base_failed`` and ``_kept``."""
    names = {r: f"_cut_{r}" for r in RULES}
    cut = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(c) for r, c in names.items()])
    if cutoffs.count() <= MAX_BROADCAST_STRATA:
        cut = F.broadcast(cut)
    m = F.col("_m")
    over = F.lit(False)
    for r, c in names.items():
        over = over | F.coalesce(_share(m, r) > F.col(c), F.lit(False))
    df = measured.withColumn("_stratum", stratum).join(cut, "_stratum", "left")
    return df.select(*measured.columns, base_failed(m).alias("_base_failed"), (~base_failed(m) & ~over).alias("_kept"))


@clear_names
def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), text: str = "text", keep_text: bool = True
) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``) plus ``_m``,
    ``_base_failed`` and ``_kept``."""
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    # stored, so that a later filter on the verdict cannot pull the measuring into itself
    measured = measure(docs, text)
    known = stored(measured if keep_text else measured.drop(text), "measured")
    truth = labels.where(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good")
    )
    narrow = known.select(F.col("doc_id").alias("_id"), key.alias("stratum"), "_m")
    cutoffs = stored(calibrate(narrow.join(truth, "_id").select("stratum", "good", "_m"), risk), "cutoffs")
    return judge(known, cutoffs, key)
