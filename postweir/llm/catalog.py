"""The operators of this package as queries over the driver's tables, and SQL of the same result where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.llm import chat, leaks, mixing, packing, pages, partenum, pii, quality, ranking, records, repeats, spelling, toxicity
from postweir.llm.tokens import tokenizer_path
from postweir.session import remove_path, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.chat_digests(chat.format_chats(rows.unionByName(both)))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_path(), end=2)
    index = records.read_index(spark, path).select("file", "offset", "start", "n_tokens")
    read = records.read_records(spark, path, with_ids=False)
    return read.join(index, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_partition_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


def op6_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


#: The chain: low or high quality first, then toxic or not.
CATEGORIES = ["quality", "toxic"]


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its probabilities and the verdict."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, model, CATEGORIES, keep=["doc_id"]).withColumn("toxic", F.col("p_toxic") > toxicity.THRESHOLD)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    numbers = [F.size(F.array_remove("base.kind", k)).alias(f"n_{k}") for k in pii.KINDS]
    numbers = [(F.size("base") - n).cast("bigint").alias(f"n_{k}") for k, n in zip(pii.KINDS, numbers, strict=True)]
    digest = F.sha2(pii.span_list(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *numbers, digest.alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "measured")
    quality.measure(table(spark, sf_dir, "documents"), "lang").write.parquet(path)
    measured = spark.read.parquet(path)
    cutoffs = quality.fit_cutoffs(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    ranking.build_index(table(spark, sf_dir, "documents"), path)
    found = ranking.search(spark, path, table(spark, sf_dir, "benchmark"))
    remove_path(spark, path)
    return found


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("bigint").alias("taken"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"))
    return spelling.group_spellings(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_suffix_repeats, op3_token_records, op4_partition_signatures, op5_page_differencing, op6_edit_decontamination, op7_toxicity_chain, op8_personal_data,
    op9_pattern_packing, op10_quality_rules, op11_lexical_search, op12_source_mixing, op13_spelling_variants,
)}
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
ORACLES: dict[str, str] = {
    "op1_chat_formatting": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
m AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[>]', '', 'g'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) + length(regexp_replace(role, '[^\\<\[>]', '', 'g')) END AS chars
  FROM r),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {_ORDER}) AS turns,
         coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '') AS lost, CAST(sum(chars) AS BIGINT) AS formatted_chars,
         string_agg(role || ' ', '' {_ORDER}) AS roles
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, '(system )?(user assistant )+') AS valid
FROM c""",
    "op4_partition_signatures": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_lexical_search": r"""
WITH words AS (
  SELECT doc_id, rowid AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
tf AS (SELECT doc_id, r, term, count(*) AS tf FROM words GROUP BY ALL),
doc AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM doc),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS k FROM benchmark)),
scored AS (
  SELECT item_id, k, doc_id, r, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN doc USING (r) CROSS JOIN whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
