"""Chats, token records, packing and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweir.llm import chat, packing, quality, records
from postweir.llm.catalog import op1_chat_formatting
from postweir.llm.tokens import WordEncoder, tokenizer_path
from postweir.session import scratch_path
from tests.llm import cases


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_come_back(spark):
    rows = [r for r in spark.read.parquet(f"{cases.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, role, text or ""))
    got = {r.conv_id: r for r in op1_chat_formatting(spark, cases.SF).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        lost = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(turns))))
        assert (r.loss_chars, r.loss_sha256) == (len(lost), sha(lost))


def test_odd_chats(spark):
    odd = ["", "\\", "\\0\\1<s>", "<role=x>", "a[/INST]b", "<<SYS>>", None, "é\U0001f600\n]>", "\\\\2["]
    rows = [(1, i, r, t, "clash") for i, (r, t) in enumerate(zip(["user", "assistant", "tool>", None, "sys<tem", "user", "assistant", "user", "x"], odd, strict=True))]
    rows += [(2, None, "assistant", "first", "x"), (2, 1, "user", "u", "x"), (2, 1, "user", "u", "x"), (None, 0, "user", None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).withColumn("read", chat.read_chats(F.col("formatted"))).collect()
    got = {r.conv_id: r for r in out}
    assert [(t.role, t.text, t.loss) for t in got[1].read] == [(r or "", t or "", r == "assistant") for _, _, r, t, _ in rows[:9]]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [t.text for t in got[2].read] == ["first", "u", "u"] and not got[2].valid and got[2].wrong_turn == 0
    assert [t.text for t in got[None].read] == [""]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_role_machine(spark):
    talks = {1: "system user assistant", 2: "user assistant user", 3: "user assistant user assistant", 4: "user user", 5: "assistant"}
    df = spark.createDataFrame([(c, i, r, "t") for c, x in talks.items() for i, r in enumerate(x.split())], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.wrong_turn) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (True, None), 4: (False, 1), 5: (False, 0)}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_encode_like_texts(tokenizer):
    rng = np.random.default_rng(3)
    alphabet = list("ab Aé\n\ṫΣΑς'st12\x1c\x85　.!\U0001f600\x0bàÿßÞ×÷Ø#") + ["<|endoftext|>", "'ll"]
    words = WordEncoder(tokenizer_path())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 25)))
        assert words.encode(text, 7).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 7]


def ids_of(tokenizer, text: str | None, end: int) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_records(spark, tokenizer):
    docs = cases.documents(spark)
    path = scratch_path(spark, "records-test")
    records.write_records(docs, path, tokenizer_path(), end=2)
    index = {r.doc_id: r for r in records.read_index(spark, path).collect()}
    read = {r.doc_id: r for r in records.read_records(spark, path).collect()}
    start = 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = ids_of(tokenizer, text, 2)
        assert read[doc_id].ids == ids and read[doc_id].ids_crc32 == crc(ids)
        assert (index[doc_id].start, index[doc_id].n_tokens) == (start, len(ids))
        start += len(ids)
    some = records.read_index(spark, path).where("doc_id % 7 = 3")
    assert {r.doc_id: r.ids for r in records.read_records(spark, path, some).collect()} == {d: r.ids for d, r in read.items() if d % 7 == 3}


def test_broken_record_is_noticed():
    whole = records.frame(5, np.arange(4, dtype="<u4"), True) + b"\n"
    assert [x[2:] for x in records.frames(memoryview(whole))] == [(5, 4)]
    assert records.payload_ids(memoryview(whole), 0).tolist() == [0, 1, 2, 3]
    for at in (0, 3, 9):
        with pytest.raises(ValueError):
            list(records.frames(memoryview(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])))
    with pytest.raises(ValueError):
        records.payload_ids(memoryview(whole[:30] + bytes([whole[30] ^ 1]) + whole[31:]), 0)


def test_records_of_nothing(spark):
    path = scratch_path(spark, "records-empty")
    records.write_records(cases.empty(spark), path, tokenizer_path(), end=2)
    assert records.read_records(spark, path).count() == 0 and records.read_index(spark, path).count() == 0


def check_packing(pieces, capacity):
    rows = defaultdict(list)
    for r in pieces:
        rows[r.sequence_id].append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rows), -(-sum(r.length for r in pieces) // capacity)


def test_packing(spark, tokenizer):
    docs = cases.documents(spark)
    got = packing.pack(docs, tokenizer_path(), end=1).collect()
    want = {}
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text, 1)
        want |= {(r.doc_id, i // 4096): (i, len(ids[i : i + 4096]), crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    made, least = check_packing(got, 4096)
    assert made <= least + 1
    packed = packing.sequences(docs, packing.pack(docs, tokenizer_path(), end=1), tokenizer_path(), end=1).collect()
    assert sum(len(r.ids) for r in packed) == sum(x[1] for x in want.values())
    assert packing.pack(cases.empty(spark), tokenizer_path(), end=1).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(3.5 + seed / 3, 1, 40_000).astype(int) + 1, 256)
    counts = np.bincount(lengths, minlength=257)
    plan = packing.plan_sequences(counts, 256)
    room = Counter()
    for length, part in plan.groupby("length"):
        ends = [*part["rank"].tolist()[1:], int(counts[length])]
        for rank, end, first in zip(part["rank"], ends, part["sequence_id"], strict=True):
            for k in range(end - rank):
                room[first + k] += length
    assert max(room.values()) <= 256 and sum(room.values()) == lengths.sum()
    assert len(room) <= -(-lengths.sum() // 256) * 1.02 + 1


WORD = re.compile("[^\x20\x09-\x0d]+")


def counted(text: str) -> tuple:
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: r for r in quality.judge(quality.measure(docs, "lang"), {("en", "symbols"): 0.1}).collect()}
    for r in docs.collect():
        g, want = got[r.doc_id], counted(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, r.doc_id
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert g.base_failed == failed and g.kept == (not failed and not (r.lang == "en" and want[2] > 0.1 * want[1]))
    assert quality.measure(cases.empty(spark), "lang").count() == 0


def test_binomial_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.1), (30, 30, 0.5), (200, 7, 0.05)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_keep_their_promise(spark):
    measured = quality.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "lang").cache()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    cutoffs = quality.fit_cutoffs(measured, labels.where(half), limit=0.02)
    assert cutoffs
    judged = quality.judge(measured, cutoffs).join(labels.where(~half), "doc_id").where("NOT base_failed")
    shares = {r.quality: r.rejected for r in judged.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("rejected")).collect()}
    assert shares[1] < 0.03 and shares[0] > 0.3
    assert quality.fit_cutoffs(measured, labels.limit(0)) == {}
