"""Text columns: normalising, masking, token counts and keyword tags.

Everything runs inside the JVM except keyword tags, HTML entities, NFKC and emoji spans, for which Spark has
no built-in. The last three go through Arrow functions that receive NULL for rows they would not
change, so only the affected texts cross to Python.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import lru_cache
from html.parser import HTMLParser

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters for which str.isspace() holds, and the word characters of
# Python's re module (Java's \s and \w are narrower).
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"

# Patterns and fillers of the masking step.
URL = rf"(www\.[^{SPACE}]+)|(https?://[^{SPACE}]+)|(http?://[^{SPACE}]+)"
HANDLE = rf"(^|[^@{WORD}])@([{WORD}]{{1,15}})(?![{WORD}])"
# anchored to the start of a run of address characters (or the end of the previous match) so a
# long run without "@" is walked once
EMAIL = rf"(?:\G|(?<![{WORD}.\-]))[{WORD}.\-]++@[{WORD}.\-]+(?:\.[{WORD}]+)+"
URL_FILLER, USER_FILLER, EMAIL_FILLER = "<url>", "@user", "@email"


def collapse_spaces(c: Column) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    # single plain spaces, the common case, do not match
    return F.trim(F.regexp_replace(c, f" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " "))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def normalize_text(c: Column) -> Column:
    """Unescape, collapse whitespace, drop control characters, trim; NULL becomes ''.

    Control characters go after the whitespace was collapsed, so a zero-width character
    between two spaces leaves both spaces behind.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.replace(F.replace(c, F.lit("&#13;"), F.lit("")), F.lit("&#10;"), F.lit(""))
    c = collapse_spaces(unescape_html(c))
    return F.trim(F.regexp_replace(c, r"\p{C}+", ""))


def default_stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    """Spark ML's own stop list."""
    from pyspark.ml.feature import StopWordsRemover

    return [w for w in StopWordsRemover.loadDefaultStopWords(language)]


def token_count(c: Column, stop_words: list[str]) -> Column:
    """Number of purely alphabetic tokens that are no stop words, URLs and handles left out."""
    bare = F.regexp_replace(F.regexp_replace(c, URL, ""), f"@[^{SPACE}]+", "")
    tokens = F.split(bare, r"[^\p{L}\p{M}\p{N}]+")
    stop = sorted({w.lower() for w in stop_words})
    kept = F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$") & ~F.lower(t).isin(stop))
    return F.size(kept).cast("bigint")


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton for all words, each with its positions in the list; built once in a Python worker."""
    places: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        if word:
            places.setdefault(word, []).append(i)
    found = ahocorasick.Automaton()
    for word, at in places.items():
        found.add_word(word, tuple(at))
    found.make_automaton()
    return found


def match_keywords(c: Column, keywords: list[str], case_insensitive: bool = False) -> Column:
    """Positions (ascending) of the keywords that occur in the text as substrings; none for NULL.

    Keywords are lower-cased, the text is not, unless `case_insensitive`. A keyword that is
    listed twice is reported twice, an empty one never. All keywords are looked for in one pass over the text, by an automaton of them.
    """
    words = tuple(k.lower() for k in keywords)
    if not any(words):
        return F.array().cast("array<int>")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def matched(texts: pa.Array) -> pa.Array:
        search = _automaton(words).iter
        return pa.array([sorted({i for at in {at for _, at in search(text)} for i in at}) if text else [] for text in texts.to_pylist()], pa.list_(pa.int32()))

    return matched(F.lower(c) if case_insensitive else c)


class _EmojiText(HTMLParser):
    """Text of a fragment; an emoji span is replaced by the bytes it declares."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0
        self.spans = 0

    def handle_starttag(self, tag, attrs):
        if tag != "span":
            return
        self.spans += 1
        if self.depth:
            self.depth += 1
            return
        raw = dict(attrs).get("data-emoji-bytes")
        if raw is not None:
            self.out.append(bytes(json.loads(raw)).decode("utf-8"))
            self.depth = 1

    def handle_endtag(self, tag):
        if tag == "span" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def _emoji_spans_to_text(text: str) -> str:
    parser = _EmojiText()
    parser.feed(text)
    parser.close()
    return "".join(parser.out) if parser.spans else text


@F.pandas_udf(T.StringType())
def _de_emojize(texts: pd.Series) -> pd.Series:
    return texts.map(_emoji_spans_to_text, na_action="ignore")


def de_emojize(c: Column) -> Column:
    """Emoji spans become the characters they encode, other markup goes; without a span nothing changes."""
    return F.coalesce(_de_emojize(F.when(F.lower(c).contains("<span"), c)), c)


def separate_hashtags(c: Column) -> Column:
    return F.regexp_replace(c, f"#([{WORD}]+)#([{WORD}]+)", " #$1 #$2 ")


_BREAKS = re.compile(r"[\r\n\t]+")


def _standardize_one(text: str) -> str:
    text = _BREAKS.sub(" ", html.unescape(text))
    # printable text holds no control characters
    if not text.isprintable():
        text = "".join(ch for ch in text if unicodedata.category(ch)[0] != "C")
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def _standardize(texts: pd.Series) -> pd.Series:
    return texts.map(_standardize_one, na_action="ignore")


def standardize(c: Column) -> Column:
    """Unescape, line breaks and tabs to a space, drop control characters, NFKC."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), r"[\x00-\x1f\x7f]+", "")
    return F.coalesce(_standardize(F.when(c.rlike(r"[&\x80-\x{10FFFF}]"), c)), plain)


def _fill(c: Column, pattern: str, filler: str) -> Column:
    masked = F.regexp_replace(c, pattern, filler)
    return F.replace(masked, F.lit(filler), F.lit(f" {filler} "))


def mask_urls(c: Column) -> Column:
    return collapse_spaces(_fill(c, URL, URL_FILLER))


def mask_users(c: Column) -> Column:
    """Mask handles of up to 15 characters; the character in front of the '@' is lost with them."""
    return collapse_spaces(_fill(c, HANDLE, USER_FILLER))


def repair_marks(c: Column) -> Column:
    """'@ x' to '@x', '# x' to '#x'."""
    return F.replace(F.replace(c, F.lit("@ "), F.lit("@")), F.lit("# "), F.lit("#"))


def mask_email(c: Column) -> Column:
    return collapse_spaces(_fill(c, EMAIL, EMAIL_FILLER))


def anonymize(c: Column) -> Column:
    """URLs, then handles, then addresses; spaces are collapsed where the next step depends on it."""
    return mask_email(_fill(repair_marks(mask_urls(c)), HANDLE, USER_FILLER))


def preprocess(c: Column) -> Column:
    """Clean an annotation text: emoji, hashtags, characters, masks, spaces; NULL becomes ''."""
    return anonymize(standardize(separate_hashtags(de_emojize(F.coalesce(c, F.lit(""))))))


def longer_than(c: Column, n: int) -> Column:
    """More than n code points."""
    return F.length(c) > n


def compose_text(*parts: Column) -> Column:
    """Parts separated by single spaces; a missing part keeps its separator."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
