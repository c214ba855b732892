"""Operator 8: exact token counts at every prefix of a text by dynamic programming.

The encoding of a prefix is the encoding of a shorter prefix followed by one piece, and it is the one whose last two
pieces stay apart when encoded together. So one pass over a text finds, for each prefix, its last piece and its count,
and truncation and budget questions are answered without encoding again.

Pieces never hold white space after other characters, so a text falls apart into words whose tables are independent;
the table of a word is computed once and kept while the worker lives.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import claim, keeps

#: Words whose tables a worker keeps at most; then it starts anew.
KEPT_WORDS = 300_000
#: Pairs of pieces of which a worker remembers whether they stay apart; then it starts anew.
KEPT_PAIRS = 500_000
#: Texts that are split into words at a time.
BATCH = 1000
MARK = "▁"


class PrefixCounter:
    """Token counts of prefixes under a sentencepiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb

        model = model_pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model must be BPE with identity normalisation, a leading space mark and white space kept")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in self.rank) or any("\n" in p for p in self.rank):
            raise ValueError("the model has pieces that cross words")
        self.longest = max(map(len, self.rank))
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}  # by piece of the vocabulary, so it holds no more than that
        self._totals: dict[str, int] = {}
        self._firsts: dict[str, int] = {}

    def merge(self, text: str) -> list[str]:
        """Encode by merging the best pair again and again; used on two pieces at most."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: str, piece: str) -> bool:
        key = (before, piece)
        found = self._apart.get(key)
        if found is None:
            found = self._apart[key] = self.merge(before + piece) == [before, piece]
        return found

    def _stands(self, piece: str) -> bool:
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = self.merge(piece) == [piece]
        return found

    def table(self, word: str, last: list[str] | None = None, counts: list[int] | None = None) -> list[int]:
        """counts[i]: tokens of the first i characters of a word, for every i.

        last and counts may hold the entries of a prefix of the word already; they are continued in place.
        """
        rank, whole, apart, longest = self.rank, self._whole, self._apart, self.longest
        last = [""] if last is None else last
        counts = [0] if counts is None else counts
        for end in range(len(counts), len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = word[start:end]
                if piece in rank:
                    if start:
                        key = (last[start], piece)
                        fits = apart.get(key)
                        if fits is None:
                            fits = apart[key] = self.merge(key[0] + piece) == [*key]
                    else:
                        fits = whole.get(piece)
                        if fits is None:
                            fits = whole[piece] = self.merge(piece) == [piece]
                    if fits:
                        last.append(piece)
                        counts.append(counts[start] + 1)
                        break
                elif start == end - 1:  # no piece of the vocabulary: one token a byte
                    last.append(piece)
                    counts.append(counts[start] + len(piece.encode("utf-8", "replace")))
            if len(counts) == end:
                raise AssertionError(f"no encoding for {word!r}")
        return counts

    def learn(self, words: Iterable[str], mark: str, totals: dict[str, int]) -> None:
        """Fill totals for words in sorted order, so that each table goes on from the prefix it shares with the last."""
        before, last, counts = "", [""], [0]
        for w in sorted(words):
            word = mark + w
            n = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], counts[n + 1 :]
            before = word
            totals[w] = self.table(word, last, counts)[-1]

    def words(self, text: str) -> list[str]:
        """The independent words of a text with their space marks; a line feed is a word of its own."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        return re.findall(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+", marked)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to its length: whole words first, then the table of the last."""
        out, total = [np.zeros(1, dtype=np.int64)], 0
        for word in self.words(text):
            counts = np.asarray(self.table(word), dtype=np.int64)
            out.append(total + counts[1:])
            total += int(counts[-1])
        joined = np.concatenate(out)
        # the leading mark is no character of the text: an empty prefix has no tokens
        return np.concatenate([joined[:1], joined[2:]]) if text else joined

    def count_all(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each whole text."""
        split, spaced, heads = [], set(), set()
        for text in texts:
            if not text or MARK in text or "  " in text or text[0] == " ":
                split.append(text)
                continue
            # the first word of a later line has no space mark before it
            first, *rest = text.split("\n")
            lines = [(None, first.split(" "))]
            for line in rest:
                head, *words = line.split(" ")
                lines.append((head, words))
                heads.add(head)
            for _, words in lines:
                spaced.update(words)
            split.append(lines)
        totals, firsts = self._totals, self._firsts
        if len(totals) > KEPT_WORDS:
            totals.clear()
        if len(firsts) > KEPT_WORDS:
            firsts.clear()
        if len(self._apart) > KEPT_PAIRS:
            self._apart.clear()
        self.learn([w for w in spaced if w not in totals], MARK, totals)
        self.learn([w for w in heads if w not in firsts], "", firsts)
        feed, out = self.table("\n")[-1], []
        for item in split:
            if item is None or isinstance(item, str):
                out.append(sum(self.table(w)[-1] for w in self.words(item)) if item else 0)
            else:
                get = totals.__getitem__
                out.append((len(item) - 1) * feed + sum(sum(map(get, words)) + (firsts[head] if head else 0) for head, words in item))
        return out

    def count(self, text: str) -> int:
        """Tokens of one whole text."""
        return self.count_all([text])[0]


_counters: dict[str, PrefixCounter] = {}
keeps("token_counts", _counters.clear)


def counter(path: str) -> PrefixCounter:
    """The worker's own counter for a model file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of each whole text; null counts as empty and has none."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("token_counts")
        c = counter(path)
        for texts in batches:
            counts: list[int] = []
            for at in range(0, len(texts), BATCH):
                counts += c.count_all(texts.iloc[at : at + BATCH])
            yield pd.Series(counts, dtype="int64")

    return count(text)


def prefix_counts(text: Column, path: str) -> Column:
    """The exact token count at every prefix, by characters, as an array: element i is for the first i characters."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.prefix_counts(t or "") for t in texts])

    return count(text)


def fits_budget(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix within a budget of tokens, from the stored counts."""
    places = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(places)


def token_report(df: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit, which replace columns of these names; other columns stay.

    Null texts count as empty. Repeated rows are counted each; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = df.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", count_tokens(text, path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
