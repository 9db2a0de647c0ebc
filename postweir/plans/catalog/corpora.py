"""Bio corpora and language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.operators import corpus, language, predictions
from postweir.operators.keyed import positional_split, with_row_index
from postweir.operators.totals import RowTotals
from postweir.plans import adapters as A
from postweir.plans.catalog.text import sql_normalize
from postweir.session import scratch_path, stage


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = F.explode(F.array(F.lit("doc"), F.lit("conv")))
    return A.table(spark, sf, "labels").select("doc_id", prefixes.alias("p")).select(
        F.concat("p", F.col("doc_id").cast("string")).alias("user_screen_name")
    )


def _pretrain(spark: SparkSession, sf: str, language: str | None) -> DataFrame:
    return corpus.pretrain_corpus(A.bios(spark, sf), _annotated(spark, sf), ["seq"], language=language)


def bio_corpus_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    order = ["source", "user_id", "seq"]
    rows = stage(_pretrain(spark, sf, None).select(*order, F.md5("user_description").alias("digest")), "corpus")
    return with_row_index(positional_split(rows, order), order).select("user_id", "source", "digest", "row_index", "split")


def bio_corpus_english(spark: SparkSession, sf: str) -> DataFrame:
    return _pretrain(spark, sf, "en").select("user_id", "source", F.md5("user_description").alias("digest"))


def bio_corpus_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.prediction_corpus(A.bios(spark, sf), ["seq"])
    return rows.select("user_id", "source", F.md5("user_description").alias("digest"))


def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.texts(spark, sf)
    return language.detect_lang(docs, language.train_profiles(docs), ["doc_id"])


def merge_by_key(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = A.table(spark, sf, "documents"), A.table(spark, sf, "labels")
    types = labels.select("doc_id", F.col("quality").alias("type_label"))
    categories = labels.filter("toxic = 0").select("doc_id", F.col("toxic").alias("category_label"))
    languages = docs.filter("lang <> 'fr'").select("doc_id", F.col("lang").alias("userbio_lang"))
    return predictions.merge_predictions(docs, [types, categories, languages], "doc_id")


def row_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left after each step of the prediction corpus, observed while it is written."""
    totals = RowTotals()
    rows = corpus.prediction_corpus(A.bios(spark, sf), ["seq"], watch=totals)
    rows.select("user_id").write.parquet(scratch_path(spark, "corpus"))
    return spark.createDataFrame(list(totals.rows().items()), "step string, n bigint")


QUERIES = {
    "merge_predictions": merge_by_key,
    "row_totals": row_totals,
    "bio_corpus_pretrain": bio_corpus_pretrain,
    "bio_corpus_english": bio_corpus_english,
    "bio_corpus_predict": bio_corpus_predict,
    "lang_detect": lang_detect,
}

_BIOS = """bios AS (
  SELECT 0 AS source, CAST(doc_id AS VARCHAR) AS user_id, 'doc' || doc_id AS name,
         CASE WHEN source <> 'src3' THEN text END AS bio, lang, 0 AS seq FROM documents
  UNION ALL
  SELECT 1, CAST(conv_id AS VARCHAR), CASE WHEN role <> 'assistant' THEN 'conv' || conv_id END, text, 'en', turn FROM conversations)"""


def _pretrain_sql(where: str) -> str:
    return f"""
WITH {_BIOS},
pairs AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, bio ORDER BY source, seq) AS r FROM bios WHERE {where}),
kept AS (
  SELECT source, user_id, seq, {sql_normalize('bio')} AS bio FROM pairs
  WHERE r = 1 AND bio IS NOT NULL
    AND (name IS NULL OR name NOT IN (SELECT 'doc' || doc_id FROM labels UNION ALL SELECT 'conv' || doc_id FROM labels))),
corpus AS (SELECT * FROM kept WHERE length(bio) > 3)"""


ORACLES = {
    "merge_predictions": """
SELECT d.doc_id, quality AS type_label, CASE WHEN toxic = 0 THEN toxic END AS category_label,
       CASE WHEN lang <> 'fr' THEN lang END AS userbio_lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "row_totals": f"""
WITH {_BIOS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, seq) AS r FROM bios)
SELECT 'read' AS step, count(*) AS n FROM firsts
UNION ALL SELECT 'distinct', count(*) FROM firsts WHERE r = 1
UNION ALL SELECT 'with bio', count(*) FROM firsts WHERE r = 1 AND bio IS NOT NULL
UNION ALL SELECT 'long enough', count(*) FROM firsts WHERE r = 1 AND length({sql_normalize('bio')}) >= 3 AND bio IS NOT NULL""",
    "bio_corpus_pretrain": f"""{_pretrain_sql('true')},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source, user_id, seq) - 1 AS row_index, count(*) OVER () AS n FROM corpus)
SELECT user_id, source, md5(bio) AS digest, row_index,
       CASE WHEN row_index < greatest(floor(0.8 * n), n - 200000) THEN 'train' ELSE 'dev' END AS split
FROM numbered""",
    "bio_corpus_english": f"{_pretrain_sql('''lang = 'en' ''')} SELECT user_id, source, md5(bio) AS digest FROM corpus",
    "bio_corpus_predict": f"""
WITH {_BIOS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, seq) AS r FROM bios),
clean AS (SELECT user_id, source, {sql_normalize('bio')} AS bio FROM firsts WHERE r = 1 AND bio IS NOT NULL)
SELECT user_id, source, md5(bio) AS digest FROM clean WHERE length(bio) >= 3""",
    "lang_detect": r"""
WITH letters AS (
  SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g')) AS s FROM documents),
chars AS (SELECT doc_id, lang, string_split(' ' || s || ' ', '') AS c FROM letters WHERE s <> ''),
grams AS (SELECT doc_id, lang, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g FROM chars),
profile AS (SELECT lang, g, count(*) AS n FROM grams WHERE lang IS NOT NULL GROUP BY ALL),
base AS (SELECT lang, -ln(sum(n) + (SELECT count(DISTINCT g) FROM profile)) AS b FROM profile GROUP BY lang),
docs AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
seen AS (
  SELECT doc_id, p.lang, sum(ln(p.n + 1.0)) AS s FROM grams JOIN profile p USING (g) GROUP BY doc_id, p.lang),
scores AS (
  SELECT docs.doc_id, base.lang, coalesce(s, 0) + docs.n * b AS score
  FROM docs CROSS JOIN base LEFT JOIN seen ON seen.doc_id = docs.doc_id AND seen.lang = base.lang),
best AS (SELECT doc_id, arg_max(lang, score) AS detected FROM scores GROUP BY doc_id)
SELECT doc_id, detected FROM documents LEFT JOIN best USING (doc_id)""",
}
