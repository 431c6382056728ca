"""Quality rules whose cutoffs are certified on labelled documents; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import UPPER, GAP_CHARS, Scratch, join_small, read, text_of, words_of

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
RISK = 0.01
DELTA = 0.05
#: A good document lost weighs as much as so many bad ones caught when certified cutoffs are compared.
LOSS_WEIGHT = 20.0

#: Rule -> (its measure, the fixed candidate cutoffs); a document is rejected above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "dup_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    "capitals": ("n_capitals / word_chars", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "long_words": ("word_chars / n_words", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    "short_words": ("-word_chars / n_words", (-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0)),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def measured(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The counts of COUNTS, base_failed and one value per rule, beside the columns `kept`.

    Repeated windows are found inside each row: 64-bit hashes of the three-word windows, of
    which only texts with a repeated hash are sorted. Nothing is exploded or shuffled.
    """
    text = F.col("_text")
    n = F.size("_words")
    df = docs.select(*kept, text_of(F.col("text")).alias("_text"))
    df = df.withColumn("_words", words_of(text))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_tri", F.when(n >= 3, window).otherwise(none))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_tri")) < F.size("_tri"),
            F.sort_array(F.transform("_tri", lambda t, i: F.struct(t.alias("t"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<t:bigint,i:int>>")),
    )
    m = F.size("_sorted")
    at = lambda k: F.element_at("_sorted", k)
    twice = lambda k: F.when(k > 1, at(k)["t"] == at(k - 1)["t"]).otherwise(False) | F.when(
        k < m, at(k)["t"] == at(k + 1)["t"]
    ).otherwise(False)
    df = df.withColumn(
        "_starts",
        F.when(m > 0, F.transform(F.filter(F.sequence(F.lit(1), m), twice), lambda k: at(k)["i"])).otherwise(
            F.array().cast("array<int>")
        ),
    )
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2))))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    columns = {
        "n_words": n,
        "word_chars": without(GAP_CHARS),
        "n_symbols": F.length(text) - without(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.size(covered),
        "n_lines": F.size("_lines"),
        "n_capitals": F.length(text) - without(UPPER),
    }
    names = [c for c in df.columns if not c.startswith("_") or c in ("_row", "_stratum")]
    # A row number keeps filters on the verdict above this projection; pushed below it they would
    # repeat the nested array expressions.
    barrier = F.monotonically_increasing_id().alias("_row_no")
    df = df.select(*names, *[v.cast("long").alias(k) for k, v in columns.items()], barrier)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) | (F.col("_row_no") < 0)
    df = df.withColumn("base_failed", failed)
    values = {f"_v_{name}": F.when(F.col("n_words") > 0, F.expr(measure)) for name, (measure, _) in RULES.items()}
    return df.withColumns(values)


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of Binomial(n, p), and 1 where k >= n p, where no bound could pass.

    Terms are added from k downwards; below n p they shrink, and those beyond ten standard
    deviations are replaced by an upper bound, so the result never errs to the low side.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        j = k - i.cast("double") + 1
        term = acc["term"] * (j / (n - j + 1) * ((1 - p) / p))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1), steps), start, add, lambda a: a["total"] + a["term"] * (k - steps))
    total = F.when(k < 1, F.lit(1.0)).otherwise(summed)
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(top) * total)).otherwise(1.0)


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified cutoff per rule (null: none): `_stratum`, `_c_<rule>`.

    `labelled` holds every labelled document that passes the base rules: _stratum, good and the
    rules' values. A cutoff is certified if the exact binomial tail rejects "more than `risk` of
    the stratum's good documents are lost" at level delta / (strata x rules x cutoffs)
    (Bonferroni), so with probability 1 - delta no rule in any stratum loses more, whichever
    certified cutoffs are used. The candidates are fixed beforehand. Of the certified ones the
    cutoff with the most bad documents caught less LOSS_WEIGHT times good ones lost is
    taken; the most lenient on ties; none if nothing is gained.
    """
    cells = [(name, c) for name, (_, cutoffs) in RULES.items() for c in cutoffs]
    over = lambda name, c, good: F.sum(((F.col(f"_v_{name}") > c) & (F.col("good") == good)).cast("long"))
    counts = labelled.groupBy("_stratum").agg(
        F.sum((F.col("good") == 1).cast("long")).alias("_n"),
        *[over(name, c, g).alias(f"_x{i}_{g}") for i, (name, c) in enumerate(cells) for g in (0, 1)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"_x{i}_1").alias("lost"), F.col(f"_x{i}_0").alias("caught"))
            for i, (name, c) in enumerate(cells)
        ]
    )
    long = counts.select("_stratum", "_n", F.inline(rows))
    gain = F.col("caught") - LOSS_WEIGHT * F.col("lost")
    passed = (
        long.withColumn("_tests", F.count("*").over(Window.partitionBy(F.lit(0))))  # rows: strata x candidates
        .withColumn("p_value", F.when(F.col("_n") > 0, binomial_tail(F.col("lost"), F.col("_n"), risk)).otherwise(1.0))
        .where((F.col("p_value") <= delta / F.col("_tests")) & (gain > 0))
    )
    best = [
        F.max_by(F.when(F.col("rule") == name, F.col("cutoff")), F.when(F.col("rule") == name, F.struct(gain, F.col("cutoff")))).alias(f"_c_{name}")
        for name in RULES
    ]
    return passed.groupBy("_stratum").agg(*best)


def labels_of(labels: DataFrame) -> DataFrame:
    """One row per document id: good only if every label of it says so."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    )


def with_verdict(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    joined = join_small(df, cutoffs, "_stratum")
    broken = [F.coalesce(F.col(f"_v_{name}") > F.col(f"_c_{name}"), F.lit(False)) for name in RULES]
    rejected = F.array_compact(F.array(*[F.when(b, F.lit(name)) for b, name in zip(broken, RULES)]))
    return (
        joined.withColumn("rejected_by", rejected)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("_row_no", *[f"_c_{name}" for name in RULES], *[f"_v_{name}" for name in RULES])
    )


def labelled_of(scored: DataFrame, labels: DataFrame) -> DataFrame:
    return scored.where(~F.col("base_failed")).join(labels_of(labels), "doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Judge every document; one row each: doc_id, the counts, base_failed, rejected_by, kept.

    Strata are the values of `stratum`, null being one of them. Null and empty texts have no
    words and fail the base rules. Repeated rows and repeated ids are judged each; a label
    counts for all rows of its id. Strata without enough labels, and all of them when
    `labels` is empty, keep whatever passes the base rules. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    scored = scratch.keep(measured(docs, [F.col("doc_id"), F.col(stratum).alias("_stratum")]), "measures")
    cutoffs = scratch.keep(certified_cutoffs(labelled_of(scored, labels)).coalesce(1), "cutoffs")
    return with_verdict(scored, cutoffs).withColumnRenamed("_stratum", "stratum")


def drop_rejected(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns.

    Cutoffs come from one narrow pass; the verdict is then computed where the rows are read, so
    texts are never shuffled.
    """
    cutoffs = Scratch(docs.sparkSession).keep(
        certified_cutoffs(
            labelled_of(measured(docs, [F.col("doc_id"), F.col(stratum).alias("_stratum")]), labels)
        ).coalesce(1),
        "cutoffs",
    )
    rows = measured(docs, [F.struct("*").alias("_row"), F.col(stratum).alias("_stratum")])
    return with_verdict(rows, cutoffs).where("kept").select("_row.*")


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )
