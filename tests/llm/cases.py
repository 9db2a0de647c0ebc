"""Small inputs with nulls, empty and very long texts, repeated rows and extra columns."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, length long, start long"


def odd_texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = [rng.choice("aeiou") + "".join(rng.choice("bcdfghé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    body = " ".join(rng.choice(words) for _ in range(120))
    return [
        None, "", " \n\t ", "one", "a b c d", "x" * 5000, "aa " * 800, long, body, body, body.upper(), body + " one more end", "new " + body,
        body.replace(" ", "  "), "line\nline\nline\n\nother\nline", "Ünï ΣΑς <|endoftext|> \x1c\x85 \U0001f600 </s>[INST] \\0 <s>",
        "mail a.b@c.de, x@y@z.org ip 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (212) 555-0123 .",
    ]


def documents(spark, extra: list[str | None] = (), sf: bool = True):
    """The smallest table and the odd texts behind it; a third of the odd ones has no language. Columns clash with those of operators."""
    rows = [r[:5] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()] if sf else []
    for i, text in enumerate([*odd_texts(), *extra]):
        rows.append((100_000 + i, text, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None))
    return spark.createDataFrame([(*r, 7, 9) for r in rows], COLUMNS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
