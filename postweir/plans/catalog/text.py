"""Text columns over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.functions import text as X
from postweir.plans import adapters as A

_STOP = ["the", "and", "of", "to", "in", "La", "de", "que", "el", "der", "die", "und", "le", "les"]
_KEYWORDS = ["the", "THE", "ention", "eau", "Eau", "und der", "ción", "the", "&&&", "zzzz", "benchmark", "é"]

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NONSPACE = _SPACE.replace("[", "[^", 1)
_URL = rf"(www\.{_NONSPACE}+)|(https?://{_NONSPACE}+)|(http?://{_NONSPACE}+)"
_W = r"\p{L}\p{N}_"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def sql_unescape(c: str) -> str:
    """The entities that occur in the tables, '&amp;' last."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def sql_normalize(c: str) -> str:
    c = f"replace(replace(coalesce({c}, ''), '&#13;', ''), '&#10;', '')"
    return f"trim(regexp_replace({sql_collapse(sql_unescape(c))}, '\\p{{C}}+', '', 'g'))"


def sql_mask(c: str, pattern: str, filler: str) -> str:
    return sql_collapse(f"replace(regexp_replace({c}, '{pattern}', '{filler}', 'g'), '{filler}', ' {filler} ')")


def sql_mask_urls(c: str) -> str:
    return sql_mask(c, _URL, "<url>")


def sql_mask_users(c: str) -> str:
    # the appended handles are ASCII and end at a boundary that RE2 can express
    return sql_mask(c, rf"(^|[^@{_W}])@([A-Za-z0-9_]{{1,15}})\b", "@user")


def sql_mask_email(c: str) -> str:
    return sql_mask(c, rf"[{_W}.\-]+@[{_W}.\-]+(\.[{_W}]+)+", "@email")


def sql_preprocess(c: str) -> str:
    c = f"regexp_replace({c}, '#([{_W}]+)#([{_W}]+)', ' #\\1 #\\2 ', 'g')"
    c = f"regexp_replace(regexp_replace({sql_unescape(c)}, '[\\r\\n\\t]+', ' ', 'g'), '\\p{{C}}+', '', 'g')"
    c = f"nfc_normalize({c})"
    c = f"replace(replace({sql_mask_urls(c)}, '@ ', '@'), '# ', '#')"
    return sql_collapse(sql_mask_email(sql_mask_users(c)))


# what the documents lack: tags, handles, links and addresses, different for each document
def _suffixed(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    docs = A.texts(spark, sf)
    return docs.select("doc_id", F.concat(
        "text", F.lit(" #tag"), d, F.lit("#more#x see https://ex.org/p?q="), d, F.lit(" or www.site"), d,
        F.lit(".org, by @name"), d, F.lit(" (@bob) @@twice @ spaced # tag a.b-c"), d, F.lit("@mail.ex-"), d, F.lit(".com!"),
    ).alias("t"))


_SUFFIXED = (
    "(SELECT doc_id, text || ' #tag' || doc_id || '#more#x see https://ex.org/p?q=' || doc_id || ' or www.site' || doc_id ||"
    " '.org, by @name' || doc_id || ' (@bob) @@twice @ spaced # tag a.b-c' || doc_id || '@mail.ex-' || doc_id || '.com!' AS t"
    " FROM documents)"
)


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.texts(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("k"), F.col("text").alias("t"))
    pages = A.texts(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("k"), F.col("html").alias("t"))
    return docs.unionByName(pages).select("kind", "k", X.normalize_text(F.col("t")).alias("normalized"))


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return _suffixed(spark, sf).select("doc_id", X.token_count(F.col("t"), _STOP).alias("tokens"))


def match_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.texts(spark, sf)
    return docs.select(
        "doc_id",
        F.array_join(X.match_keywords(F.col("text"), _KEYWORDS), ",").alias("matched"),
        F.array_join(X.match_keywords(F.col("text"), _KEYWORDS, case_insensitive=True), ",").alias("matched_ci"),
    )


#: As many keywords as the list of the study has.
_LIST = 590


def match_keyword_list(spark: SparkSession, sf: str) -> DataFrame:
    """A list of hundreds of keywords: words of the benchmark, every tenth in upper case."""
    words = A.texts(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").distinct()
    listed = [r["w"] for r in words.orderBy(F.md5("w"), "w").limit(_LIST).collect()]
    keywords = [w.upper() if i % 10 == 0 else w for i, w in enumerate(listed)]
    docs = A.texts(spark, sf)
    return docs.select("doc_id", F.array_join(X.match_keywords(F.col("text"), keywords), ",").alias("matched"))


def de_emojize(spark: SparkSession, sf: str) -> DataFrame:
    """Emoji spans around the text of every second source; texts with bare '<' or '&' stay out of the markup."""
    docs = A.texts(spark, sf).withColumn("safe", F.translate("text", "<>&", "()+"))
    span = F.lit('<span class="emoji" data-emoji-bytes="[240, 159, 152, 128]">x</span>')
    marked = F.when(F.col("lang") == "en", F.concat(span, "safe", F.lit(" <b>bold</b> "), span)).otherwise(F.col("text"))
    return docs.select("doc_id", X.de_emojize(marked).alias("clean"))


def separate_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return _suffixed(spark, sf).select("doc_id", X.separate_hashtags(F.col("t")).alias("separated"))


def mask_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = _suffixed(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("k"), "t")
    pages = A.texts(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("k"), F.col("html").alias("t"))
    return rows.unionByName(pages).select("kind", "k", X.mask_urls(F.col("t")).alias("masked"))


def mask_users(spark: SparkSession, sf: str) -> DataFrame:
    return _suffixed(spark, sf).select("doc_id", X.mask_users(X.repair_marks(F.col("t"))).alias("masked"))


def mask_email(spark: SparkSession, sf: str) -> DataFrame:
    docs = _suffixed(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("k"), "t")
    pages = A.texts(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("k"), F.col("html").alias("t"))
    return docs.unionByName(pages).select("kind", "k", X.mask_email(F.col("t")).alias("masked"))


def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return _suffixed(spark, sf).select("doc_id", X.preprocess(F.col("t")).alias("clean"))


def compose_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "customer")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return rows.select("c_custkey", X.compose_text(F.col("c_name"), segment, F.col("c_nationkey").cast("string")).alias("composed"))


QUERIES = {
    "normalize_text": normalize_text,
    "token_count": token_count,
    "match_keywords": match_keywords,
    "match_keyword_list": match_keyword_list,
    "de_emojize": de_emojize,
    "separate_hashtags": separate_hashtags,
    "mask_urls": mask_urls,
    "mask_users": mask_users,
    "mask_email": mask_email,
    "preprocess": preprocess,
    "compose_text": compose_text,
}

_STOP_SQL = ", ".join(f"'{w.lower()}'" for w in _STOP)
_DOCS_AND_PAGES = "(SELECT 'doc' AS kind, doc_id AS k, text AS t FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)"
_SUFFIXED_AND_PAGES = f"(SELECT 'doc' AS kind, doc_id AS k, t FROM {_SUFFIXED} UNION ALL SELECT 'page', page_id, html FROM pages)"


def _matches(text: str) -> str:
    tests = ", ".join(f"CASE WHEN contains({text}, '{k.lower()}') THEN '{i}' END" for i, k in enumerate(_KEYWORDS))
    return f"concat_ws(',', {tests})"


_EMOJI = "chr(128512)"
ORACLES = {
    "normalize_text": f"SELECT kind, k, {sql_normalize('t')} AS normalized FROM {_DOCS_AND_PAGES}",
    "token_count": f"""
SELECT doc_id, CAST(len([x FOR x IN string_split_regex(
         regexp_replace(regexp_replace(t, '{_URL}', '', 'g'), '@{_NONSPACE}+', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')
       IF regexp_matches(x, '^\\p{{L}}+$') AND lower(x) NOT IN ({_STOP_SQL})]) AS BIGINT) AS tokens
FROM {_SUFFIXED}""",
    "match_keywords": f"SELECT doc_id, {_matches('text')} AS matched, {_matches('lower(text)')} AS matched_ci FROM documents",
    "match_keyword_list": f"""
WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''),
k AS (SELECT row_number() OVER (ORDER BY md5(w), w) - 1 AS i, w FROM words ORDER BY i LIMIT {_LIST}),
hit AS (
  SELECT doc_id, i FROM documents JOIN k ON contains(text, lower(w)))
SELECT doc_id, coalesce(string_agg(i, ',' ORDER BY i), '') AS matched FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id""",
    "de_emojize": f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {_EMOJI} || translate(text, '<>&', '()+') || ' bold ' || {_EMOJI} ELSE text END AS clean
FROM documents""",
    "separate_hashtags": f"SELECT doc_id, regexp_replace(t, '#([{_W}]+)#([{_W}]+)', ' #\\1 #\\2 ', 'g') AS separated FROM {_SUFFIXED}",
    "mask_urls": f"SELECT kind, k, {sql_mask_urls('t')} AS masked FROM {_SUFFIXED_AND_PAGES}",
    "mask_users": f"""SELECT doc_id, {sql_mask_users("replace(replace(t, '@ ', '@'), '# ', '#')")} AS masked FROM {_SUFFIXED}""",
    "mask_email": f"SELECT kind, k, {sql_mask_email('t')} AS masked FROM {_SUFFIXED_AND_PAGES}",
    "preprocess": f"SELECT doc_id, {sql_preprocess('t')} AS clean FROM {_SUFFIXED}",
    "compose_text": """
SELECT c_custkey, c_name || ' ' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END || ' ' || c_nationkey AS composed
FROM customer""",
}
