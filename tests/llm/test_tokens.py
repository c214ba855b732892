import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from broadsheet.llm import packing, token_counts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, WORDS = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BPE)
COUNTER, ENCODER = token_counts.PrefixCounter(PIECES), packing.WordEncoder(BPE)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t▁abctheing.,'!?0123456789é<>|s/")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_every_prefix_is_counted(text):
    assert COUNTER.prefix_counts(text).tolist() == [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    ids = np.frombuffer(ENCODER.encode_all([text])[0], "<u4").tolist()
    assert ids == WORDS.encode(text, add_special_tokens=False).ids


def test_a_column_of_texts_is_encoded_by_its_different_words():
    texts = [None, "  said one, said two", "", " \t\n", "said two said\u00a0one \u0130said", *["said one"] * 50]
    known = packing.WordEncoder(BPE)
    ids, at = known.encode_column(pa.array(["before", *texts]).slice(1))
    want = [WORDS.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [ids[lo:hi].tolist() for lo, hi in zip(at, at[1:])] == want
    assert set(known.words) == {"said", "one,", "two", "one", "said\u00a0one", "\u0130said"}
    assert known.encode_column(pa.array([None, ""]))[1].tolist() == [0, 0, 0]


def test_report(clashing, rows):
    got = token_counts.token_report(clashing, PIECES, limit=50).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(LIBRARY.encode(r[1] or "")), len(LIBRARY.encode(r[1] or "")) > 50) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_budget_from_stored_counts(spark):
    df = spark.createDataFrame([("the cat sat on the mat",), ("",), (None,)], "text string")
    stored = df.select("text", token_counts.prefix_counts(F.col("text"), PIECES).alias("c"))
    for row in stored.select("text", token_counts.fits_budget(F.col("c"), 3).alias("n")).collect():
        text = row["text"] or ""
        assert row["n"] == max(i for i in range(len(text) + 1) if len(LIBRARY.encode(text[:i])) <= 3)


def test_report_empty(empty):
    assert token_counts.token_report(empty, PIECES).count() == 0


@pytest.mark.parametrize("histogram", [{1: 5000}, {2048: 3, 1: 1}, {700: 10, 650: 7, 3: 40, 2048: 2}, {1025: 5}, {}])
def test_patterns_use_every_length(histogram):
    patterns = packing.shortest_pack_first(histogram)
    placed = Counter()
    for p in patterns:
        assert sum(p.lengths) <= packing.ROOM
        for length in p.lengths:
            placed[length] += p.count
    assert placed == Counter(histogram)
    if histogram == {1: 5000}:
        assert sum(p.count for p in patterns) == 3


def test_packed_documents(clashing, rows):
    got = packing.pack_documents(clashing, BPE).collect()
    ids = {r: [*WORDS.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in set(rows)}
    want = Counter()
    for r in rows:
        n = len(ids[r])
        for s in range(0, n, packing.ROOM):
            data = np.asarray(ids[r][s : s + packing.ROOM], "<u4").tobytes()
            want[(r[0], s, len(data) // 4, zlib.crc32(data), n)] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.ROOM
    assert sorted(by) == list(range(len(by)))
    total = sum(r["length"] for r in got)
    assert len(by) <= total / packing.ROOM + 2


def test_packing_empty(empty):
    assert packing.pack_documents(empty, BPE).count() == 0
