"""Personal data: spans of fixed formats, and more of them found by bootstrapped context patterns; DataFrame functions only.

Spans of the fixed formats are the seeds. A pattern is the two words before a token that has a digit. Patterns and tokens form a graph:
a pattern is as good as the tokens it precedes, a token as good as the patterns that precede it. The scores are iterated from the
seeds, and tokens behind patterns of high confidence are added as spans of the seeds' kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.session import ensure_checkpoint_dir, remove_path, scratch_path

KINDS = ("email", "ip", "card", "phone")
#: Fixed formats, written so that no run of characters is tried twice from within: each begins where its run begins or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match, so the pattern isn't tried.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": "\\+[0-9]"}
NUMBERED = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Distinct seed tokens a pattern needs, the score it needs, and the rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.9, 3
#: Characters before a token in which its two words are looked for.
CONTEXT_CHARS = 64

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    figures = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substr(turned, i, F.lit(1)).cast("int").alias("d")))

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when(x["i"] % 2 == 1, x["d"]).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(figures, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<before, value, start>> of all matches; start counts code points."""
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda before, value: F.struct(before.alias("before"), value.alias("value")),
    )
    pieces = F.filter(pieces, lambda p: p["value"].isNotNull())
    steps = F.transform(pieces, lambda p: F.struct(F.length(p["before"]).alias("b"), F.length(p["value"]).alias("v")))
    ends = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, s: F.struct((a["at"] + s["b"] + s["v"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["b"])).alias("starts")),
        lambda a: a["starts"],
    )
    return F.zip_with(pieces, ends, lambda p, s: F.struct(p["before"].alias("before"), p["value"].alias("value"), s.alias("start")))


def _spans_of(placed: Column, kind: str, rank: int) -> Column:
    return F.transform(F.filter(placed, lambda m: _valid(kind, m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind"),
    ))


def base_spans(text: Column) -> Column:
    """Spans of the fixed formats by start, then in the order of KINDS; matches that fail their test are dropped."""
    found = []
    for rank, kind in enumerate(KINDS):
        spans = _spans_of(_placed(text, PATTERNS[kind]), kind, rank)
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPANS)))
    return F.array_sort(F.concat(*found))


def candidates(text: Column) -> Column:
    """array<struct<left, token, start, end>>: tokens with a digit, without marks around them, and the two words before them."""
    def one(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], "^[^A-Za-z0-9]*", 0))
        token = F.regexp_extract(m["value"], "[A-Za-z0-9](?:.*[A-Za-z0-9])?", 0)
        tail = F.regexp_extract(F.lower(F.right(m["before"], F.lit(CONTEXT_CHARS))), r"(?:^|\s)(\S+\s+\S+)\s+$", 1)
        start = m["start"] + lead
        return F.struct(tail.alias("left"), token.alias("token"), start.alias("start"), (start + F.length(token)).alias("end"))

    placed = F.filter(F.transform(_placed(text, NUMBERED), one), lambda c: c["left"] != "")
    return F.when(text.rlike("[0-9]"), placed).otherwise(F.array().cast("array<struct<left:string,token:string,start:int,end:int>>"))


def learn_patterns(found: DataFrame) -> DataFrame:
    """(left, kind, rank, score) of the patterns with enough confidence, from rows with `base` and `cands`."""
    ensure_checkpoint_dir(found.sparkSession)
    each = found.select("base", F.explode("cands").alias("c"))
    over = F.get(F.filter("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start"))), F.lit(0))
    edges = each.select(F.col("c.left").alias("left"), F.col("c.token").alias("token"), over["kind"].alias("kind"), over["rank"].alias("rank"))
    edges = edges.groupBy("left", "token").agg(F.min(F.struct("rank", "kind")).alias("seed"))
    edges = edges.withColumn("kind", F.col("seed.kind")).withColumn("rank", F.col("seed.rank")).drop("seed")
    # patterns that precede too few seeds can't pass, whatever the scores
    seeded = edges.groupBy("left").agg(F.count("kind").alias("seeds"), F.mode("kind").alias("of"), F.min("rank").alias("rank_of")).where(F.col("seeds") >= SUPPORT)
    edges = edges.join(seeded.select("left", "of", F.lit(0).alias("_")), "left").drop("_").checkpoint()
    scores = edges.select("left", "token", F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0).alias("good"))
    for _ in range(ROUNDS):
        patterns = scores.groupBy("left").agg((F.sum("good") / (F.count(F.lit(1)) + 0.1)).alias("score"))
        scored = edges.join(patterns, "left")
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))
        tokens = scored.groupBy("token", "of").agg((1 - F.exp(doubt)).alias("by_patterns"))
        scores = edges.join(tokens, ["token", "of"]).select(
            "left", "token", F.when(F.col("kind") == F.col("of"), 1.0).when(F.col("kind").isNotNull(), 0.0).otherwise(F.col("by_patterns")).alias("good"),
        ).checkpoint()
    final = scores.groupBy("left").agg((F.sum("good") / (F.count(F.lit(1)) + 0.1)).alias("score")).where(F.col("score") >= CONFIDENCE)
    ranks = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("of")).cast("int") - 1
    return final.join(seeded, "left").select("left", F.col("of").alias("kind"), ranks.alias("rank"), "score")


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, stage: str | None = None) -> DataFrame:
    """The columns `keep` of each row with `base` and `spans`: arrays of (start, rank, end, kind) over the whole text (null: empty).

    `spans` has the base spans and those of the learned patterns that overlap none of them, by start, then rank. Rows may repeat; columns `base` and `spans` of `docs` are replaced. The
    rows are written once with what was found in them (to `stage`, else a scratch folder), so that they are scanned once.
    """
    spark = docs.sparkSession
    keep = list(keep or docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    path = stage or scratch_path(spark, "personal")
    docs.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), base_spans(text).alias("base"), candidates(text).alias("cands"),
    ).write.parquet(path)
    found = spark.read.parquet(path)
    patterns = learn_patterns(found.where(F.size("cands") > 0).select("base", "cands"))
    # a pattern's tokens meet it by hash of both, so that a common one isn't handled by one task
    hits = (
        found.where(F.size("cands") > 0).select("_row", "base", F.explode("cands").alias("c")).withColumn("left", F.col("c.left"))
        .where(~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start"))))
        .join(patterns, "left")
    )
    more = hits.groupBy("_row").agg(F.collect_list(F.struct(
        F.col("c.start").alias("start"), F.col("rank"), F.col("c.end").alias("end"), F.col("kind"),
    )).alias("more"))
    rows = found.join(more, "_row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("more"), F.array().cast(SPANS))))
    kept = [F.col(f"_kept.`{c}`").alias(c) for c in keep if c not in ("base", "spans")]
    return rows.select(*kept, "base", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with [KIND] in the place of each span; where spans overlap, the later ones only hide what is left of them."""
    state = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["parts"], F.array(
                F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                F.when(s["end"] > a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
            )).alias("parts"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(state["parts"], ""), F.substr(text, state["at"] + 1)))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns, with [KIND] in the place of personal data; n_chars, where there is such a column, follows the text.

    Texts are not staged: their spans are found and kept by a digest of the text, and meet the texts again in one join. Equal texts have equal
    spans, so rows may repeat, and a null text stays null. Other columns may have any name. The join is a merge join whatever the size, as its small side grows with the texts.
    """
    spark = docs.sparkSession
    code = F.sha2(F.col("text").cast("binary"), 256)
    found_at, spans_at = scratch_path(spark, "personal"), scratch_path(spark, "spans")
    found = find_personal_data(docs.select("text", code.alias("_code")), ["_code"], found_at).where(F.size("spans") > 0)
    found.groupBy("_code").agg(F.first("spans").alias("_spans")).write.parquet(spans_at)
    remove_path(spark, found_at)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), code.alias("_code")).join(spark.read.parquet(spans_at).hint("merge"), "_code", "left")
    hit = F.col("_spans").isNotNull()
    masked = rows.select("row", F.when(hit, mask(F.col("row.text"), F.col("_spans"))).otherwise(F.col("row.text")).alias("masked"), hit.alias("hit"))
    changed = {"text": F.col("masked"), "n_chars": F.when(F.col("hit"), F.length("masked").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return masked.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
