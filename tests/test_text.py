from __future__ import annotations

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postweir.functions import text as X

PIECES = [
    "a", "B", "é", "ß", "東京", "نص", "ｆｕｌｌ", "ﬁ", "😀", "1", "_", "-", ".", ",", "!", "(", ")", "@", "#", "&", "<", ">", "\\", "$1",
    " ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x1f", "\x85", "\u200b", "\u200d", "\ufeff", "\x00", "\x07",
    "&amp;", "&#13;", "&#10;", "&lt;", "&#128512;", "&copy", "&nosuch;", "@bob", "@averyveryverylongname", "@@x", "#tag", "#a#b#c",
    "https://ex.org/p?q=1", "http://x", "htt://y", "www.site.org", "www.", "me@mail.com", "a.b-c@d-e.co.uk", "x@y", "<url>", "@user", "@ x", "# y",
]


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def collapsed(s: str) -> str:
    return " ".join(s.split())


def printable(s: str) -> str:
    return "".join(ch for ch in s if not unicodedata.category(ch).startswith("C"))


def filled(pattern: str, filler: str, s: str) -> str:
    return collapsed(re.sub(pattern, filler, s).replace(filler, f" {filler} "))


PLAIN_URL = r"www\.\S+|https?://\S+|http?://\S+"
PLAIN_HANDLE = r"(?:^|[^@\w])@\w{1,15}\b"
PLAIN_EMAIL = r"[\w.-]+@[\w.-]+(?:\.\w+)+"


def test_normalize_text_equals_plain_python(texts):
    values = random_texts(1, 3000)

    def plain(s):
        s = html.unescape(s.replace("&#13;", "").replace("&#10;", ""))
        return printable(collapsed(re.sub(r"[\r\n\t]+", " ", s))).strip()

    assert texts(X.normalize_text, values) == [plain(v) for v in values]


def test_zero_width_character_between_spaces_leaves_both(texts):
    assert texts(X.normalize_text, ["a \u200b b", None, "", " \n"]) == ["a  b", "", "", ""]


@pytest.mark.parametrize(("function", "pattern", "filler"), [
    (X.mask_urls, PLAIN_URL, "<url>"), (X.mask_users, PLAIN_HANDLE, "@user"), (X.mask_email, PLAIN_EMAIL, "@email"),
])
def test_masks_equal_plain_python(texts, function, pattern, filler):
    values = [v.replace("\x00", "") for v in random_texts(2, 3000)]
    assert texts(function, values) == [filled(pattern, filler, v) for v in values]


def test_mask_users_eats_the_character_before(texts):
    assert texts(X.mask_users, ["(@bob) hi", "@bob", "x@bob", "@@bob", "@" + "a" * 16]) == [
        "@user ) hi", "@user", "x@bob", "@@bob", "@" + "a" * 16
    ]


def test_adjacent_addresses(texts):
    assert texts(X.mask_email, ["a@b.c@d.e", "a@b.c-@x.y"]) == [filled(PLAIN_EMAIL, "@email", v) for v in ["a@b.c@d.e", "a@b.c-@x.y"]]


def test_standardize_equals_plain_python(texts):
    values = random_texts(3, 3000)
    expected = [
        unicodedata.normalize("NFKC", printable(re.sub(r"[\r\n\t]+", " ", html.unescape(v)))) for v in values
    ]
    assert texts(X.standardize, values) == expected


def test_preprocess_equals_plain_python(texts):
    values = random_texts(4, 3000)

    def plain(s):
        s = re.sub(r"#(\w+)#(\w+)", r" #\1 #\2 ", s)
        s = unicodedata.normalize("NFKC", printable(re.sub(r"[\r\n\t]+", " ", html.unescape(s))))
        s = filled(PLAIN_URL, "<url>", s).replace("@ ", "@").replace("# ", "#")
        return filled(PLAIN_EMAIL, "@email", filled(PLAIN_HANDLE, "@user", s))

    assert texts(X.preprocess, [*values, None]) == [*[plain(v) for v in values], ""]


def test_hashtag_pairs_are_consumed(texts):
    assert texts(X.separate_hashtags, ["#x#y#z", "#a #b", "#é#ü"]) == [" #x #y #z", "#a #b", " #é #ü "]


def test_de_emojize(texts):
    span = '<span class="e" data-emoji-bytes="[240, 159, 152, 128]"><i>x</i></span>'
    assert texts(X.de_emojize, [f"hi {span} <b>you</b> &amp;", "no <b>span</b> &amp;", None, "<SPAN>a</SPAN><br>"]) == [
        "hi 😀 you &", "no <b>span</b> &amp;", None, "a"
    ]


def test_token_count(texts):
    values = ["The cat sat on a mat", "see https://x.org/the-cat @cat www.cat.org now", "don't 4you x2 नमस्ते ok", "", "THE the"]
    assert texts(lambda c: X.token_count(c, ["the", "a", "on"]), values) == [3, 2, 3, 0, 0]


def test_keywords_are_lowered_but_the_text_is_not(texts):
    words = ["Corona", "#corona", "corona", "covid 19", "É"]
    assert texts(lambda c: X.match_keywords(c, words), ["#corona é", "CORONA", "covid 19", "", None]) == [[0, 1, 2, 4], [], [3], [], []]
    assert texts(lambda c: X.match_keywords(c, words, True), ["CORONA"]) == [[0, 2]]
    assert texts(lambda c: X.match_keywords(c, []), ["x"]) == [[]]


def test_many_keywords(texts):
    words = [f"word{i:03d}" for i in range(590)]
    assert texts(lambda c: X.match_keywords(c, words), [" ".join(reversed(words)), "word58"]) == [list(range(590)), []]


def test_lengths_count_code_points(texts):
    assert texts(lambda c: X.longer_than(c, 3), ["😀😀😀", "😀😀😀😀"]) == [False, True]


def test_compose_text_keeps_separators(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(X.compose_text(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "a  c"


def test_default_stop_words(spark):
    assert "the" in X.default_stop_words(spark)
