"""Experiment tables: run counts, accuracies, flips, bands, costs and arm contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.contracts import BANDS, GRADE_REASONS, check_bands

# What a cached read and a cache write weigh in input tokens, and the
# prices' unit.
CACHE_WRITE_WEIGHT = 2
PER_TOKEN = 1e-6


def run_counts(planned: DataFrame, made: DataFrame) -> DataFrame:
    """Per configuration: runs, passed, failed calls, error causes, harness errors, not made.

    ``planned`` (configuration, run_key); ``made`` (run_key, passed, failed_calls,
    error_cause, harness_error). Causes are counted before they become a map, so the map
    holds one entry per cause.
    """
    joined = planned.join(made.withColumn("_made", F.lit(True)), "run_key", "left")
    causes = (
        joined.where(F.col("error_cause").isNotNull())
        .groupBy("configuration", "error_cause")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("configuration")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_cause", "n")))).alias(
                "error_causes"
            )
        )
    )
    counts = joined.groupBy("configuration").agg(
        F.count("_made").alias("runs"),
        F.count_if(F.col("passed")).alias("passed"),
        F.coalesce(F.sum("failed_calls"), F.lit(0)).cast("bigint").alias("failed_calls"),
        F.count("harness_error").alias("harness_errors"),
        F.count_if(F.col("_made").isNull()).alias("not_made"),
    )
    return counts.join(causes, "configuration", "left").withColumn(
        "error_causes", F.coalesce("error_causes", F.create_map().cast("map<string,bigint>"))
    )


def regrade_counts(runs: DataFrame, questions: DataFrame, regraded: DataFrame) -> DataFrame:
    """Per configuration: passed and graded now, and runs asked another text.

    ``runs`` (configuration, run_key, qid, asked, recorded_passed, has_rows,
    harness_error); ``questions`` (qid, text); ``regraded`` (run_key, passed). A run with
    no stored rows keeps its recorded grade; one with a harness error counts as failed.
    """
    current = runs.join(questions.select("qid", "text"), "qid", "left").join(
        regraded.select("run_key", F.col("passed").alias("_again")), "run_key", "left"
    )
    same_text = F.coalesce(F.col("asked") == F.col("text"), F.lit(False))
    passed = F.when(F.col("harness_error"), False).otherwise(
        F.when(F.col("has_rows"), F.col("_again")).otherwise(F.col("recorded_passed"))
    )
    return current.groupBy("configuration").agg(
        F.count_if(same_text & F.coalesce(passed, F.lit(False))).alias("passed"),
        F.count_if(same_text).alias("graded"),
        F.count_if(~same_text).alias("other_text"),
    )


def question_scores(grades: DataFrame) -> DataFrame:
    """Each question's pass rate over its repetitions, per arm."""
    return grades.groupBy("arm", "qid").agg(
        F.avg(F.col("passed").cast("double")).alias("score"),
        F.count(F.lit(1)).alias("repetitions"),
    )


def accuracy(scores: DataFrame, parts: DataFrame) -> DataFrame:
    """The mean question score per arm and split part."""
    return (
        scores.join(parts, "qid")
        .groupBy("arm", "part")
        .agg(F.avg("score").alias("accuracy"), F.count(F.lit(1)).alias("questions"))
    )


def eligibility(
    accuracies: DataFrame, low: float = 0.5, high: float = 0.9, min_gap: float = 0.15
) -> DataFrame:
    """Per model: the gap of full over no documentation, and whether it may be chosen.

    ``accuracies``: model, no_docs, all_docs.
    """
    gap = F.col("all_docs") - F.col("no_docs")
    return accuracies.select(
        "model",
        gap.alias("gap"),
        (F.col("all_docs").between(low, high) & (F.round(gap, 12) >= min_gap)).alias("eligible"),
    )


def score_differences(scores: DataFrame, better: str, base: str) -> DataFrame:
    """Per question: one arm's score minus another's, in one pass over the scores."""
    return (
        scores.where(F.col("arm").isin(better, base))
        .groupBy("qid")
        .agg(
            (
                F.max(F.when(F.col("arm") == better, F.col("score")))
                - F.max(F.when(F.col("arm") == base, F.col("score")))
            ).alias("d")
        )
        .where(F.col("d").isNotNull())
    )


def flips(grades: DataFrame, baseline: str) -> DataFrame:
    """Per arm and question against a baseline arm: repetitions won and lost."""
    base = grades.where(F.col("arm") == baseline).select(
        "qid", "repetition", F.col("passed").alias("_base")
    )
    return (
        grades.where(F.col("arm") != baseline)
        .join(base, ["qid", "repetition"])
        .groupBy("arm", "qid")
        .agg(
            F.count_if(F.col("passed") & ~F.col("_base")).alias("fail_to_pass"),
            F.count_if(~F.col("passed") & F.col("_base")).alias("pass_to_fail"),
        )
        .where((F.col("fail_to_pass") > 0) | (F.col("pass_to_fail") > 0))
    )


def reason_counts(grades: DataFrame) -> DataFrame:
    """Grade reasons and infrastructure failures per arm, one column per reason."""
    return grades.groupBy("arm").agg(
        *[
            F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r)
            for r in GRADE_REASONS
        ],
        F.count_if(F.coalesce(F.col("error_cause") == "infrastructure", F.lit(False))).alias(
            "infrastructure"
        ),
    )


def call_cost(prices_in: Column, prices_out: Column) -> Column:
    """A call's cost: cached reads at the input rate, cache writes at twice it."""
    tokens = (
        F.col("input_tokens")
        + F.coalesce("cache_read_tokens", F.lit(0))
        + F.lit(CACHE_WRITE_WEIGHT) * F.coalesce("cache_write_tokens", F.lit(0))
    )
    return (tokens * prices_in + F.col("output_tokens") * prices_out) * F.lit(PER_TOKEN)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, cache hits and misses, tokens and spend per run and stage.

    ``prices`` (model, input, output) are rates per million tokens.
    """
    priced = calls.join(prices, "model", "left").withColumn(
        "cost",
        F.when(F.col("cache") == "hit", F.lit(0.0)).otherwise(
            call_cost(F.col("input"), F.col("output"))
        ),
    )
    return priced.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cache") == "hit").alias("hits"),
        F.count_if(F.col("cache") != "hit").alias("misses"),
        F.sum("cost").alias("spend_usd"),
    )


def unpriced_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models called that have no price, so their spend can't be counted."""
    return calls.select("model").distinct().join(prices.select("model"), "model", "left_anti")


def band(
    probability: Column,
    failure: Column,
    ready_min: float = 0.8,
    confirm_min: float = 0.5,
    merge: bool = False,
) -> Column:
    """The band of a draft: ready, confirm or flagged; a failure is always flagged.

    ``merge`` is the two-band fallback: ready and confirm become one.
    """
    check_bands(ready_min, confirm_min)
    return (
        F.when(failure.isNotNull() | probability.isNull(), "flagged")
        .when(probability >= (confirm_min if merge else ready_min), "ready")
        .when(probability >= confirm_min, "confirm")
        .otherwise("flagged")
    )


def band_delivery(gated: DataFrame) -> DataFrame:
    """Per arm and band: chosen columns, those given a draft, and drafts labeled correct.

    ``gated``: arm, fqn, band, correct (null without a label).
    """
    return gated.groupBy("arm", "band").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("band") != "flagged").alias("delivered"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def monotone_bands(delivered: DataFrame) -> DataFrame:
    """Per arm: whether accuracy rises from flagged over confirm to ready."""
    by_band = delivered.groupBy("arm").agg(
        *[F.max(F.when(F.col("band") == b, F.col("accuracy"))).alias(b) for b in BANDS]
    )
    return by_band.select(
        "arm",
        F.coalesce(
            (F.col("ready") >= F.col("confirm")) & (F.col("confirm") >= F.col("flagged")),
            F.lit(False),
        ).alias("monotone"),
    )


def edit_rates(decisions: DataFrame) -> DataFrame:
    """Shares of accepted, edited and rejected drafts.

    The total comes from the three counts, so the decisions are read once.
    """
    counts = decisions.agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "edited", "rejected")],
        F.count(F.lit(1)).alias("total"),
    )
    each = F.array(
        *[
            F.struct(
                F.lit(d).alias("decision"),
                F.col(d).alias("drafts"),
                F.try_divide(F.col(d), F.col("total")).alias("share"),
            )
            for d in ("accepted", "edited", "rejected")
        ]
    )
    return counts.select(F.inline(each))


def confusion_pairs(run_columns: DataFrame, gold_columns: DataFrame) -> DataFrame:
    """Columns only the run read or only its gold read: (run_key, fqn, side).

    ``run_columns`` (run_key, qid, fqn); ``gold_columns`` (qid, fqn). Each side is one
    anti-join on (qid, fqn) or (run, fqn), so a question's columns are never paired. The
    runs' columns grow with the runs, so the driver never gathers them for a broadcast.
    """
    run = run_columns.select("run_key", "qid", "fqn").distinct()
    only_run = run.join(gold_columns.select("qid", "fqn"), ["qid", "fqn"], "left_anti")
    wanted = run.select("run_key", "qid").distinct().join(gold_columns, "qid")
    only_gold = wanted.join(run.select("run_key", "fqn").hint("merge"), ["run_key", "fqn"], "left_anti")
    return only_run.select("run_key", "fqn", F.lit("run").alias("side")).unionByName(
        only_gold.select("run_key", "fqn", F.lit("gold").alias("side"))
    )


def attribution_agreement(attributed: DataFrame, pairs: DataFrame) -> DataFrame:
    """How often the attributed column is one of the run's confusion columns."""
    confused = pairs.select("run_key", "fqn").distinct().withColumn("_hit", F.lit(True))
    return (
        attributed.join(confused, ["run_key", "fqn"], "left")
        .agg(
            F.count(F.lit(1)).alias("attributed"),
            F.count("_hit").alias("agreed"),
        )
        .withColumn("rate", F.try_divide(F.col("agreed"), F.col("attributed")))
    )


def confused_attributions(attributed: DataFrame, run_columns: DataFrame, gold_columns: DataFrame) -> DataFrame:
    """``attribution_agreement`` with the ``confusion_pairs`` of these columns, none of which is made.

    A run's attributed column is one of its pairs if either the run or its question's gold
    read it, not both: one look-up a side for each attributed column.
    """
    run = run_columns.select("run_key", "qid", "fqn").distinct()
    asked = attributed.select("run_key", "fqn").join(run.select("run_key", "qid").distinct().hint("merge"), "run_key", "left")
    looked_up = asked.join(
        run.withColumn("_run", F.lit(True)).hint("merge"), ["run_key", "qid", "fqn"], "left"
    ).join(gold_columns.select("qid", "fqn").distinct().withColumn("_gold", F.lit(True)), ["qid", "fqn"], "left")
    confused = F.col("_run").isNotNull() != F.col("_gold").isNotNull()
    return (
        looked_up.groupBy("run_key", "fqn")
        .agg(F.bool_or(confused).alias("_hit"))
        .agg(F.count(F.lit(1)).alias("attributed"), F.count_if("_hit").alias("agreed"))
        .withColumn("rate", F.try_divide(F.col("agreed"), F.col("attributed")))
    )


def arm_texts(
    catalog: DataFrame, baseline: DataFrame, drafts: DataFrame, chosen: DataFrame
) -> DataFrame:
    """What an arm's readers see: the locked baseline texts plus the drafts of the chosen
    columns in the ready and confirm bands. A flagged column gets none.

    ``baseline`` (fqn, text), ``drafts`` (fqn, description, band), ``chosen`` (fqn).
    """
    delivered = (
        drafts.join(chosen.select("fqn"), "fqn", "left_semi")
        .where(F.col("band").isin("ready", "confirm"))
        .select("fqn", F.col("description").alias("text"))
    )
    locked = baseline.select("fqn", "text")
    both = locked.unionByName(delivered.join(locked, "fqn", "left_anti"))
    return catalog.select("fqn").join(both, "fqn", "left")


def ceiling_texts(catalog: DataFrame, dictionary: DataFrame) -> DataFrame:
    """What the ceiling arm's readers see: every column with its dictionary's text, null where that has none.

    ``dictionary`` (column_name, text), a row per name; columns of one name share it.
    """
    return catalog.select("fqn", "column_name").join(dictionary.select("column_name", "text"), "column_name", "left").select("fqn", "text")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: the sizes of two sets and how many they share, by one grouping."""
    tagged = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_key = tagged.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return per_key.agg(
        F.sum("in_a").cast("bigint").alias("left_size"),
        F.sum("in_b").cast("bigint").alias("right_size"),
        F.sum(F.col("in_a") * F.col("in_b")).cast("bigint").alias("shared"),
    )
