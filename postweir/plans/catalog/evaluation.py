"""Significance tests and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.operators import evaluation, significance
from postweir.plans import adapters as A
from postweir.plans.run_report import run_test_report
from postweir.session import scratch_path
from postweir.sources.tables import write_labelled_csv


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(A.table(spark, sf, "labels"), "doc_id")


def _tested(df: DataFrame, group: str, success: str, alternative: str) -> DataFrame:
    return significance.group_significance(df, group, success, alternative).withColumns({
        "fraction": F.round("fraction", 6), "p_value": F.round("p_value", 6),
    })


def binom_two_sided(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rated(spark, sf).withColumn("ok", evaluation.is_correct(F.col("quality"), F.lit(1)))
    return _tested(rows, "lang", "ok", "two-sided")


def binom_greater(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rated(spark, sf).select(
        F.when(F.col("source") != "src0", F.col("source")).alias("grp"), evaluation.is_correct(F.col("quality"), F.lit(1)).alias("ok")
    )
    return _tested(rows, "grp", "ok", "greater")


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return significance.value_counts(A.table(spark, sf, "documents"), "lang")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    vectors = A.table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("run"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 10).cast("int").alias("prediction")
    )
    labels = A.table(spark, sf, "labels").select(
        F.lit("labels").alias("run"), F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("prediction")
    )
    return vectors.unionByName(labels)


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion_matrix(_runs(spark, sf))


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.classification_report(_runs(spark, sf)).withColumn("value", F.round("value", 6))


def positional_report(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled CSV and keyless prediction lines in the same order, glued by position; labels 1 and 2 count as one."""
    root = scratch_path(spark, "positional")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 10).cast("string").alias("guess"))
    ordered = rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    write_labelled_csv(ordered.select(F.concat(F.lit("text "), "vec_id").alias("text"), "label"), f"{root}/test")
    ordered.select(F.col("guess").alias("label")).write.json(f"{root}/predictions")
    report = run_test_report(spark, f"{root}/test", f"{root}/predictions", "run", f"{root}/out", averaging=["macro"], label_mapping={"2": "1"}, metrics=["accuracy", "f1"])
    return report.withColumn("value", F.round("value", 6))


QUERIES = {
    "binom_two_sided": binom_two_sided,
    "binom_greater": binom_greater,
    "value_counts": value_counts,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "positional_report": positional_report,
}


def _binomial_sql(group: str, alternative: str) -> str:
    extreme = "k >= x" if alternative == "greater" else "pmf <= pmf_x * (1 + 1e-7)"
    return f"""
WITH d AS (SELECT {group} AS grp, CAST(quality = 1 AS INTEGER) AS ok FROM documents JOIN labels USING (doc_id)),
p AS (SELECT avg(ok) AS p FROM d),
g AS (SELECT grp, sum(ok) AS x, count(*) AS n FROM d WHERE grp IS NOT NULL GROUP BY grp),
t AS (SELECT grp, x, n, p, unnest(range(0, n + 1)) AS k FROM g, p),
logf AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(greatest(i, 1)) END) OVER (ORDER BY i) AS lf
         FROM range(0, (SELECT max(n) + 1 FROM g)) r(i)),
f AS (
  SELECT t.*, exp(a.lf - b.lf - c.lf + k * ln(p) + (n - k) * ln(1 - p)) AS pmf
  FROM t JOIN logf a ON a.i = n JOIN logf b ON b.i = k JOIN logf c ON c.i = n - k),
x AS (SELECT grp, pmf AS pmf_x FROM f WHERE k = x),
s AS (SELECT f.grp, any_value(f.x) AS x, any_value(n) AS n, least(1, sum(pmf) FILTER (WHERE {extreme})) AS p_value FROM f JOIN x ON f.grp = x.grp GROUP BY f.grp)
SELECT grp, CAST(x AS BIGINT) AS successes, n AS trials, round(x / n, 6) AS fraction, round(p_value, 6) AS p_value,
       p_value < 0.05 / (SELECT count(*) FROM g) AS is_sig
FROM s"""


_RUNS = """runs AS (
  SELECT 'embeddings' AS run, CAST(label AS INTEGER) AS y, CAST(vec_id % 10 AS INTEGER) AS z FROM embeddings
  UNION ALL SELECT 'labels', CAST(quality AS INTEGER), CAST(toxic AS INTEGER) FROM labels)"""
ORACLES = {
    "binom_two_sided": _binomial_sql("lang", "two-sided"),
    "binom_greater": _binomial_sql("CASE WHEN source <> 'src0' THEN source END", "greater"),
    "positional_report": """
WITH r AS (
  SELECT CASE WHEN label = 2 THEN '1' ELSE CAST(label AS VARCHAR) END AS y, CASE WHEN vec_id % 10 = 2 THEN '1' ELSE CAST(vec_id % 10 AS VARCHAR) END AS z FROM embeddings),
names AS (SELECT y AS c FROM r UNION SELECT z FROM r),
m AS (
  SELECT c, 2 * count(*) FILTER (WHERE y = c AND z = c) / (count(*) FILTER (WHERE y = c) + count(*) FILTER (WHERE z = c)) AS f1
  FROM names, LATERAL (SELECT y, z FROM r WHERE y = c OR z = c) GROUP BY c)
SELECT 'run' AS run, 'accuracy' AS metric, CAST(NULL AS VARCHAR) AS label, round((SELECT avg(CAST(y = z AS INTEGER)) FROM r), 6) AS value
UNION ALL SELECT 'run', 'f1_macro', NULL, round((SELECT avg(f1) FROM m), 6)
UNION ALL SELECT 'run', 'f1', c, round(f1, 6) FROM m""",
    "value_counts": "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "confusion_matrix": f"WITH {_RUNS} SELECT run, y AS label, z AS prediction, count(*) AS n FROM runs GROUP BY ALL",
    "classification_report": f"""
WITH {_RUNS},
names AS (SELECT run, y AS c FROM runs UNION SELECT run, z FROM runs),
k AS (
  SELECT names.run, c, count(*) FILTER (WHERE y = c AND z = c) AS tp, count(*) FILTER (WHERE y = c) AS sup,
         count(*) FILTER (WHERE z = c) AS pre
  FROM names JOIN runs ON names.run = runs.run GROUP BY ALL),
m AS (
  SELECT *, CASE WHEN pre = 0 THEN 0 ELSE tp / pre END AS precision, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS recall,
         CASE WHEN sup + pre = 0 THEN 0 ELSE 2 * tp / (sup + pre) END AS f1, count(*) OVER (PARTITION BY run) AS labels
  FROM k),
r AS (
  SELECT run, sum(tp)::DOUBLE AS c, sum(sup)::DOUBLE AS s, sum(sup * pre)::DOUBLE AS pt, sum(sup * sup)::DOUBLE AS tt, sum(pre * pre)::DOUBLE AS pp,
         avg(precision) AS ap, avg(recall) AS ar, avg(f1) AS af,
         sum(precision * sup) / sum(sup) AS wp, sum(recall * sup) / sum(sup) AS wr, sum(f1 * sup) / sum(sup) AS wf
  FROM m GROUP BY run),
o AS (
  SELECT run, unnest([
    {{'metric': 'accuracy', 'value': c / s}}, {{'metric': 'precision_micro', 'value': c / s}},
    {{'metric': 'recall_micro', 'value': c / s}}, {{'metric': 'f1_micro', 'value': c / s}},
    {{'metric': 'precision_macro', 'value': ap}}, {{'metric': 'recall_macro', 'value': ar}}, {{'metric': 'f1_macro', 'value': af}},
    {{'metric': 'precision_weighted', 'value': wp}}, {{'metric': 'recall_weighted', 'value': wr}}, {{'metric': 'f1_weighted', 'value': wf}},
    {{'metric': 'matthews_corrcoef', 'value': (c * s - pt) / sqrt((s * s - pp) * (s * s - tt))}},
    {{'metric': 'cohen_kappa', 'value': (c / s - pt / (s * s)) / (1 - pt / (s * s))}}]) AS e
  FROM r),
l AS (
  SELECT run, c, labels, unnest([{{'metric': 'precision', 'value': precision}}, {{'metric': 'recall', 'value': recall}},
                         {{'metric': 'f1', 'value': f1}}]) AS e
  FROM m)
SELECT run, e.metric AS metric, NULL AS label, round(e.value, 6) AS value FROM o
UNION ALL SELECT run, e.metric, CAST(c AS VARCHAR), round(e.value, 6) FROM l
UNION ALL SELECT run, e.metric || '_binary', NULL, round(e.value, 6) FROM l WHERE labels <= 2 AND c = 1""",
}
