"""Operator 6: packing token sequences by shortest-pack-first over the histogram of lengths.

Documents become pieces of at most 2048 ids. Their lengths are counted; lengths are placed longest first, each into the
shortest packs that still have room, which only changes the counts of packing patterns. The work of planning follows
the 2048 lengths, not the documents. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, keeps, materialize, release

ROOM = 2048
#: Words, and parts of words, whose ids a worker keeps in each of two generations.
KEPT_WORDS = 100_000
#: Texts that are split into words at a time.
BATCH = 2000
#: Rows in a bucket of the ranks.
BUCKET_ROWS = 4096
END_ID = 1


class Kept(dict):
    """A table that keeps what is in use: full, it starts anew and takes over what is asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def lacks(self, keys) -> list:
        """The keys that are in neither table; those of the old one move over."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        missing, old = [k for k in keys if k not in self], self.old
        if not old:
            return missing
        self.update([(k, old[k]) for k in missing if k in old])
        return [k for k in missing if k not in old]


class WordEncoder:
    """Ids of texts under a tokenizer whose tokens never hold white space, by way of the ids of their words."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.pieces = Kept(kept_words), Kept(kept_words)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4") for e in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Each part is one word to the tokenizer, and its last id alone is one that ends words."""
        if not parts:
            return []
        ids = np.concatenate(self._encode([" ".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]))
        at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(at) != len(parts) + 1:
            raise AssertionError("a part is not one word to the tokenizer")
        data = ids.tobytes()
        return [data[lo:hi] for lo, hi in zip(at, at[1:])]

    def learn(self, words: list[str]) -> None:
        """Plain Latin words are split as the tokenizer splits them, and their parts looked up; others it encodes whole."""
        whole, parted, parts, split = [], [], set(), self.parts.findall
        single, lower = [], []
        for w in words:
            # below U+0130 each letter is composed already and has a lower case of one letter
            if w.isascii() or max(w) < "İ":
                if w.isalpha():
                    single.append(w)
                    lower.append(w.lower())
                    continue
                if "<|" not in w:
                    text = w.lower()
                    # most other words end in one mark
                    own = [text[:-1], text[-1]] if text[-1] in ".,;:!?" and text[:-1].isalpha() else split(text)
                    parted.append((w, own))
                    parts.update(own)
                    continue
            whole.append(w)
        parts.update(lower)
        new = sorted(self.pieces.lacks(parts))
        self.pieces.update(zip(new, self._encode_parts(new)))
        get = self.pieces.__getitem__
        self.words.update(zip(single, map(get, lower)))
        self.words.update([(w, b"".join(map(get, own))) for w, own in parted])
        self.words.update(zip(whole, (ids.tobytes() for ids in self._encode(whole))))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts in one row, and where each text's begin (and the last's end); null counts as empty.

        Only the different words are looked at one by one; a text's ids are put together by its words' numbers.
        """
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # makes no scalar of each
        collects = gc.isenabled()
        gc.disable()  # none of the many lists and tuples here is a cycle
        try:
            self.learn(self.words.lacks(filter(None, words)))  # white space at the ends leaves an empty word
            known = pa.array([self.words[w] if w else b"" for w in words], pa.large_binary())
        finally:
            if collects:
                gc.enable()
        # Arrow copies the ids of each word to its places: its buffer is the row of ids, its offsets are where words end
        told = known.take(coded.indices)
        _, at, data = told.buffers()
        ends = np.frombuffer(at, np.int64, len(told) + 1) // 4 if len(told) else np.zeros(1, dtype=np.int64)
        ids = np.frombuffer(data, "<u4", ends[-1]) if ends[-1] else np.zeros(0, dtype="<u4")
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each whole text; null counts as empty."""
        plain = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        ids, at = self.encode_column(pa.array(plain, pa.binary()).cast(pa.string()))
        data = ids.tobytes()
        return [data[4 * lo : 4 * hi] for lo, hi in zip(at, at[1:])]


_encoders: dict[tuple[str, int], WordEncoder] = {}
keeps("packing", _encoders.clear)


def encoder(path: str, kept_words: int) -> WordEncoder:
    """The worker's own encoder for a file."""
    key = (path, kept_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(path, kept_words)
    return _encoders[key]


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of whole documents: id, start, length, ids_crc32, doc_tokens. Every document ends with END_ID."""
    kind = df.schema[id_col].dataType.simpleString()
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        e = encoder(path, kept_words)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                ids, texts = (c.slice(at, BATCH) for c in batch.columns)
                row, start, length, crc, total = [], [], [], [], []
                found, begins = e.encode_column(texts)
                whole = found.tobytes()
                for i, (lo, hi) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                    data = whole[4 * lo : 4 * hi] + end
                    n = len(data) // 4
                    for s in range(0, n, room):
                        row.append(i)
                        start.append(s)
                        length.append(min(room, n - s))
                        crc.append(zlib.crc32(data[4 * s : 4 * (s + room)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass(frozen=True)
class Pattern:
    """count packs that hold the same lengths."""

    lengths: tuple[int, ...]
    count: int


def shortest_pack_first(histogram: dict[int, int], room: int = ROOM) -> list[Pattern]:
    """Place lengths longest first, each into the packs with the most room left; open packs only if none has room."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(room, length - 1, -1):
            while left and packs.get(free):
                held, n = packs[free].pop()
                used = min(n, left)
                packs[free - length].append((held + (length,), used))
                if n > used:
                    packs[free].append((held, n - used))
                left -= used
            if not left:
                break
        if left:  # each new pack is the shortest until it is full
            most = room // length
            if left // most:
                packs[room - most * length].append(((length,) * most, left // most))
            if left % most:
                packs[room - left % most * length].append(((length,) * (left % most), 1))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for group in packs.values():
        for held, n in group:
            merged[held] += n
    return [Pattern(held, n) for held, n in sorted(merged.items()) if n]


def seats(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length the ranges of ranks that each place of each pattern takes.

    Columns: length, first_rank, count, first_sequence, offset. Ranks first_rank + i go to sequence first_sequence + i.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for p in patterns:
        at = 0
        for length in p.lengths:
            rows.append((length, taken[length], p.count, sequence, at))
            taken[length] += p.count
            at += length
        sequence += p.count
    return pd.DataFrame(rows, columns=["length", "first_rank", "count", "first_sequence", "offset"], dtype="int64")


def pack(cut: DataFrame, room: int = ROOM, seed: int = 42) -> DataFrame:
    """Pieces with sequence_id and offset: gapless from 0 in a sequence of at most room ids.

    cut must be stable (written): it is read three times. Repeated rows are pieces of their own; an empty table gives
    no rows.
    """
    spark = cut.sparkSession
    lengths = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `room` rows
    table = seats(shortest_pack_first({r["length"]: r["n"] for r in lengths}, room))
    total = sum(r["n"] for r in lengths)
    # the patterns follow the lengths (a few steps each, at most `room` places a pattern), not the documents
    shared = spark.sparkContext.broadcast({k: g.to_numpy() for k, g in table.groupby("length")})

    keyed = cut.withColumn("_key", F.xxhash64(F.lit(seed), "id", "start", "ids_crc32")).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(max(1, total // BUCKET_ROWS))))
    entries = keyed.groupBy("length", "_bucket", "_key", "id", "start", "ids_crc32", "doc_tokens").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "_bucket").orderBy("_key", "id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = entries.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(starts.drop("_n"), ["length", "_bucket"])
    ranked = ranked.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("_m") - 1).cast("int"))))
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_start") + F.col("_in") + F.col("_i")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = shared.value
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            ranks = batch["rank"].to_numpy()
            for length, at in batch.groupby("length").indices.items():
                t = by_length[length]
                row = np.searchsorted(t[:, 1], ranks[at], side="right") - 1
                sequence[at] = t[row, 3] + ranks[at] - t[row, 1]
                offset[at] = t[row, 4]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kind = cut.schema["id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Whole documents packed into sequences of at most room ids: one row a piece (see pieces and pack).

    kept_words bounds the words that a Python worker remembers, and so its memory. Null texts count as empty and hold
    END_ID alone. Ids may be null; rows with the same id and text are apart.
    """
    return pack(materialize(pieces(df, path, id_col, text_col, room, kept_words), "pieces"), room)
