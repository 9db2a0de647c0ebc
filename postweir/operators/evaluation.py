"""Classification metrics of many runs at once, all derived from the confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_correct(label: Column, prediction: Column) -> Column:
    return F.coalesce(label == prediction, F.lit(False))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(run, label, prediction, n)"""
    return df.groupBy("run", F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per (run, label), over the labels seen on either side."""
    sides = F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    rows = confusion.select("run", hit.alias("hit"), F.posexplode(sides).alias("side", "c"))
    totals = rows.groupBy("run", F.col("c.label").alias("label")).agg(
        F.sum(F.when(F.col("side") == 0, F.col("hit")).otherwise(0)).alias("tp"),
        F.sum("c.support").alias("support"),
        F.sum("c.predicted").alias("predicted"),
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return totals.withColumns({
        "precision": _ratio(tp, predicted),
        "recall": _ratio(tp, support),
        "f1": _ratio(2 * tp, support + predicted),
    })


def run_metrics(classes: DataFrame) -> DataFrame:
    """One row per run with the averaged metrics, Matthews correlation and Cohen's kappa."""
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")
    sums = classes.groupBy("run").agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum(support).alias("s"),
        F.sum(support * predicted).alias("tp_pk"),
        F.sum(support * support).alias("tk2"),
        F.sum(predicted * predicted).alias("pk2"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * support) / F.sum(support)).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )
    c, s = F.col("c"), F.col("s")
    norm = F.sqrt((s * s - F.col("pk2")) * (s * s - F.col("tk2")))
    chance = F.col("tp_pk") / (s * s)
    accuracy = c / s
    return sums.select(
        "run",
        accuracy.alias("accuracy"),
        *[accuracy.alias(f"{m}_micro") for m in ("precision", "recall", "f1")],
        *[f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted")],
        _ratio(c * s - F.col("tp_pk"), norm).alias("matthews_corrcoef"),
        F.when(chance != 1, (accuracy - chance) / (1 - chance)).otherwise(F.lit(float("nan"))).alias("cohen_kappa"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: str = "1",
                          averaging: list[str] | None = None, label_mapping: dict[str, str] | None = None,
                          metrics: list[str] | None = None) -> DataFrame:
    """(run, metric, label, value) of every run in the column `run`; `label` is NULL for averages.

    A run with at most two labels, one of them `positive`, also gets the `_binary` metrics of that label. `averaging` keeps
    some of micro, macro, weighted and binary; `metrics` keeps some of accuracy, precision, recall, f1, matthews_corrcoef and cohen_kappa;
    `label_mapping` replaces labels on both sides before they are compared, others stay.
    """
    if label_mapping:
        pairs = F.create_map(*[F.lit(x) for pair in label_mapping.items() for x in pair])
        df = df.withColumns({c: F.coalesce(F.try_element_at(pairs, F.col(c).cast("string")), F.col(c).cast("string")) for c in (label, prediction)})
    classes = class_metrics(confusion_matrix(df, label, prediction))
    names = ("precision", "recall", "f1")
    # one row per (run, label): a few numbers per class, wide enough to be reused
    sizes = classes.groupBy("run").agg(F.count(F.lit(1)).alias("_labels"))
    per_class = classes.join(sizes, "run")
    binary = (F.col("_labels") <= 2) & (F.col("label").cast("string") == positive)
    text = F.col("label").cast("string")
    entries = [F.struct(F.lit(m).alias("metric"), text.alias("label"), F.col(m).alias("value")) for m in names]
    entries += [
        F.struct(F.when(binary, F.lit(f"{m}_binary")).alias("metric"), F.lit(None).cast("string").alias("label"), F.col(m).alias("value"))
        for m in names
    ]
    by_label = per_class.select("run", F.explode(F.array(*entries)).alias("e")).select("run", "e.*").filter("metric is not null")
    wide = run_metrics(classes)
    averages = wide.unpivot(["run"], [c for c in wide.columns if c != "run"], "metric", "value")
    averages = averages.select("run", "metric", F.lit(None).cast("string").alias("label"), "value")
    report = averages.unionByName(by_label)
    if averaging is not None:
        unwanted = [a for a in ("micro", "macro", "weighted", "binary") if a not in averaging]
        report = report.filter(~F.substring_index("metric", "_", -1).isin(unwanted))
    if metrics is not None:
        family = F.regexp_replace("metric", "_(micro|macro|weighted|binary)$", "")
        report = report.filter(family.isin(metrics))
    return report
