"""Scoring of predicted settings: label pairs, counters, reports, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.catalog import is_legacy, renamed
from tunelake.constants import N_BUCKETS
from tunelake.functions.labels import label_bucket, range_bucket
from tunelake.functions.scaling import abs_qps, decode_bucket, improvement_pct, ratio
from tunelake.functions.text import bind, extract_json_object
from tunelake.operators.history import with_limits
from tunelake.operators.skew import ROWS_PER_SALT, matched, salted_join


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Adds the maps `truth` (from truth_text) and `pred` (from answer_text); null if unreadable."""
    return answers.withColumn("truth", extract_json_object(F.col("truth_text"))).withColumn(
        "pred", extract_json_object(F.col("answer_text"))
    )


def _is_valid(pred: Column) -> Column:
    return F.coalesce(F.size(pred) > 0, F.lit(False))


def answer_counters(parsed: DataFrame) -> DataFrame:
    """One row: readable answers and parse errors; an empty object counts as an error.

    The conditions sit in the aggregates: a filter would be pushed below the parsing
    and parse every text twice.
    """
    usable, valid = F.col("truth").isNotNull(), _is_valid(F.col("pred"))
    return parsed.agg(
        F.count_if(usable & valid).alias("valid_samples"),
        F.count_if(usable & ~valid).alias("parse_errors"),
    )


def knob_labels(parsed: DataFrame) -> DataFrame:
    """(sample, knob, truth_label, pred_label) for each knob of the truth of readable answers.

    A missing prediction is null. Truth and prediction stand in the same row, so the
    pairing needs no shuffle; the outer generator keeps the parsing from running twice.
    """

    def pairs(row):
        paired = F.transform(
            F.map_entries(row["truth"]),
            lambda e: F.struct(
                e["key"].alias("knob"),
                e["value"].alias("truth_label"),
                F.try_element_at(row["pred"], e["key"]).alias("pred_label"),
            ),
        )
        return F.when(_is_valid(row["pred"]), paired)

    return parsed.select("sample", F.inline_outer(bind(F.struct("truth", "pred"), pairs))).filter(
        F.col("knob").isNotNull()
    )


def paired_labels(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Inner pairs of two long tables (sample, knob, label); a pair key is unique on both sides."""
    left = truth.select("sample", "knob", F.col("label").alias("truth_label"))
    right = pred.select("sample", "knob", F.col("label").alias("pred_label"))
    return left.join(right, ["sample", "knob"])


def missing_predictions(parsed: DataFrame) -> DataFrame:
    """Knobs of the truth without a prediction, under readable answers only, as (sample, knob)."""
    return knob_labels(parsed).filter(F.col("pred_label").isNull()).select("sample", "knob")


def comparable(pairs: DataFrame) -> DataFrame:
    """Pairs with a plain range label on both sides, as deciles y_true and y_pred."""
    return (
        pairs.withColumn("y_true", range_bucket(F.col("truth_label")))
        .withColumn("y_pred", range_bucket(F.col("pred_label")))
        .filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    )


def confusion_counts(scored: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): at most one row per label pair, the base of all reports."""
    return scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: compared pairs, hits and accuracy over all knobs."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    counts = scored.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct"))
    return counts.withColumn("accuracy", ratio(F.col("correct").cast("double"), F.col("compared")))


def label_set(scored: DataFrame) -> DataFrame:
    """Sorted labels found in truth or prediction."""
    sides = F.explode(F.array("y_true", "y_pred")).alias("label")
    return confusion_counts(scored).select(sides).distinct().orderBy("label")


def confusion_matrix(scored: DataFrame, n_labels: int = N_BUCKETS) -> DataFrame:
    """One row per label of truth or prediction, one column `pred_i` per label of the scale.

    Labels from `n_labels` on are rows too, but have no column; pass the size of a larger scale.

    Every counted pair adds its cell to the row of its truth and an empty cell to the
    row of its prediction, so both kinds of labels come out of one pass.
    """
    cell = F.struct(F.col("y_true").alias("label"), F.col("y_pred").alias("pred"), F.col("n"))
    other = F.struct(F.col("y_pred").alias("label"), F.col("y_pred").alias("pred"), F.lit(0).cast("long").alias("n"))
    cells = confusion_counts(scored).select(F.inline(F.array(cell, other)))
    columns = [
        F.sum(F.when(F.col("pred") == i, F.col("n")).otherwise(0)).alias(f"pred_{i}")
        for i in range(n_labels)
    ]
    return cells.groupBy("label").agg(*columns)


def label_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; ratios without a base are 0."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(none)
    truth = F.struct(F.col("y_true").alias("label"), hit.alias("tp"), n.alias("support"), none.alias("predicted"))
    guess = F.struct(F.col("y_pred").alias("label"), none.alias("tp"), none.alias("support"), n.alias("predicted"))
    sums = (
        confusion_counts(scored)
        .select(F.inline(F.array(truth, guess)))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )

    def rate(num, den):
        return F.coalesce(ratio(num, den), F.lit(0.0))

    hits, p, r = F.col("tp").cast("double"), F.col("precision"), F.col("recall")
    return (
        sums.withColumn("precision", rate(hits, F.col("predicted")))
        .withColumn("recall", rate(hits, F.col("support")))
        .withColumn("f1", rate(2 * p * r, p + r))
        .select("label", "precision", "recall", "f1", "support")
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a label report."""
    measures = ["precision", "recall", "f1"]
    weight = F.col("support")
    total = F.sum(weight)
    row = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * weight), total).alias(f"weighted_{m}") for m in measures],
        total.alias("support"),
    )
    return row


def key_coverage(catalog_keys: DataFrame, answer_keys: DataFrame, key: str) -> DataFrame:
    """Keys of either side with a `status`: both, missing (catalog only) or extra (answer only)."""
    left = catalog_keys.select(key).distinct().withColumn("_c", F.lit(True))
    right = answer_keys.select(key).distinct().withColumn("_r", F.lit(True))
    status = (
        F.when(F.col("_c") & F.col("_r"), "both").when(F.col("_c"), "missing").otherwise("extra")
    )
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """One row: sizes, missing and extra keys, coverage percent of the catalog."""

    def n(*states):
        return F.count_if(F.col("status").isin(*states))

    covered = ratio(n("both") * 100.0, n("both", "missing"))
    return coverage.agg(
        n("both", "missing").alias("n_catalog"),
        n("both", "extra").alias("n_answer"),
        n("missing").alias("n_missing"),
        n("extra").alias("n_extra"),
        covered.alias("coverage_pct"),
    )


def decode_answers(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """(…, knob, label, value) with labels decoded to knob values.

    Legacy names are renamed and unknown knobs skipped; of a knob under both names the
    legacy one's label counts. All columns but knob and label tell the answers apart. A label
    outside the scale on a knob with a range is an error: its `value` is null and
    `rejected` is true.
    """
    answer = [c for c in labels.columns if c not in ("knob", "label")]
    legacy = F.when(is_legacy(F.col("knob")), F.col("label")).alias("_old")
    current = labels.select("*", legacy, renamed(F.col("knob")).alias("_new")).drop("knob").withColumnRenamed("_new", "knob")
    single = current.groupBy(*answer, "knob").agg(F.coalesce(F.max("_old"), F.max("label")).alias("label"))
    known = with_limits(single, catalog, "inner")
    value = decode_bucket(label_bucket(F.col("label")), F.col("min"), F.col("max"), F.col("default"), F.col("type"))
    return (
        known.withColumn("value", value)
        .withColumn("rejected", F.col("value").isNull())
        .drop("type", "min", "max", "default")
    )


def compare_runs(
    results: DataFrame, default_name: str = "default", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Results (run, name, qps) against the default of the same run: percent change of |qps|.

    Of repeated defaults the best counts. A run may hold many results, hence the salted join.
    """
    qps = abs_qps(F.col("qps"))
    base = results.filter(F.col("name") == default_name).groupBy("run").agg(F.max(qps).alias("default_qps"))
    tried = results.filter(F.col("name") != default_name).select("run", "name", qps.alias("qps"))
    return salted_join(tried, base, ["run"], ["name"], rows_per_salt=rows_per_salt).withColumn(
        "improvement_pct", improvement_pct(F.col("qps"), F.col("default_qps"))
    )


def ranked_runs(results: DataFrame) -> DataFrame:
    """Adds `rank`: 1 for the largest |qps| of a run, ties share a rank.

    The results of a run are the lines of one result file, which bounds the window.
    """
    order = Window.partitionBy("run").orderBy(abs_qps(F.col("qps")).desc_nulls_last())
    return results.withColumn("rank", F.rank().over(order))


def best_against_default(results: DataFrame, default_name: str = "default") -> DataFrame:
    """Per run: the first best answer by |qps|, the default and the gap between them.

    Aggregates of fixed width find both; only the few answers that share the best |qps| of
    their run are looked at by name.
    """
    is_default = F.col("name") == default_name
    qps = abs_qps(F.col("qps"))
    top = F.max(F.when(~is_default, qps)).alias("best_qps")
    runs = results.groupBy("run").agg(top, F.max(F.when(is_default, qps)).alias("default_qps"))
    tried = results.filter(~is_default).select("run", "name", qps.alias("_qps"))
    ties = matched(tried, runs.select("run", "best_qps"), ["run"], "inner").filter("_qps = best_qps")
    names = ties.groupBy("run").agg(F.min("name").alias("best_name"))
    return matched(runs, names, ["run"], "left").select(
        "run",
        "best_name",
        "best_qps",
        "default_qps",
        (F.col("best_qps") - F.col("default_qps")).alias("gap"),
        improvement_pct(F.col("best_qps"), F.col("default_qps")).alias("improvement_pct"),
    )


def r2(rows: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """R² = 1 - SSE / SST per group from one pass of partial sums; a flat truth gives null."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("sse"),
        F.var_pop(y).alias("_var"),
    ]
    grouped = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    sst = F.col("_var") * F.col("n")
    return grouped.withColumn("r2", F.lit(1.0) - ratio(F.col("sse"), sst)).drop("_var")


def score_summary(scores: DataFrame, score: str = "r2") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(
        F.count(score).alias("n_folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")
    )
