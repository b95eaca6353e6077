"""Packing of token sequences by minimum bin slack.

Documents are encoded, ended and, only if longer than a sequence, cut into pieces. A
sequence is filled as follows: the longest piece left goes in, and a subset-sum dynamic
program over the lengths left, one bit per sum, finds the fullest combination for the
rest; of several, the one with the longest pieces. The combination is then removed.

Only the number of pieces per length matters for that, a table of as many rows as a
sequence has tokens, whatever the size of the corpus. As long as there are enough
pieces, the same combination is the fullest again, so it is taken as often as it fits
at once. The plan says which numbers among the pieces of a length go to which sequence;
pieces are numbered within their length by a range shuffle, and find their place.

Texts are encoded word by word, as no token crosses white space, and a worker keeps the
ids of words it has seen.

Defined cases: a NULL text is an empty one, a piece of one id, the end. Pieces that
agree in everything are put in any order. NULL ids are packed like others. Further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.alignment import byte_of_symbol
from planar.llm.ranks import ranked
from planar.llm.scratch import written
from planar.llm.words import slices, split_words

CAPACITY = 4096
END_ID = 1
# What a worker remembers.
_MOST_WORDS, _MOST_PARTS = 1_000_000, 300_000
_ID_BYTES = 4


# --- encoding ------------------------------------------------------------------


# The parts of a lower-cased word of ASCII and Latin-1 letters, digits and signs, as the
# vocabulary's own pattern has them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# What a vocabulary must do before its model for these to hold.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Vocabulary:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Words are known by a 64-bit hash. Most are of plain characters; their parts are given
    to the tokenizer's model directly, as its preparation takes most of the time, and
    kept. Other words, and all words of a vocabulary that prepares texts otherwise, are
    encoded by the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        self.parts: dict[str, list[int]] = {}
        settings = json.loads(self.tokenizer.to_str())
        split, level = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.special = [t["content"] for t in settings["added_tokens"]]
        self.plain = (
            (settings["normalizer"] or {}).get("normalizers") == _NORMALIZER
            and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and split.get("behavior") == "Removed"
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex"))
        self.symbol = {b: c for c, b in byte_of_symbol().items()}

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _part(self, part: str) -> list[int]:
        symbols = part.encode().decode("latin-1").translate(self.symbol)
        ids = [t.id for t in self.tokenizer.model.tokenize(symbols)]
        if len(self.parts) >= _MOST_PARTS:
            self.parts = {}
        self.parts[part] = ids
        return ids

    def _words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for text in words:
            if self.plain and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                ids: list[int] = []
                for part in _PARTS.findall(text.lower()):
                    ids += self.parts.get(part) or self._part(part)
                out.append(ids)
            else:
                out.append(None)
        rest = [w for w, ids in zip(words, out) if ids is None]
        found = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [next(found).ids if ids is None else ids for ids in out]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, and where each text's end. White space is dropped and
        splits words, so their words are encoded instead."""
        words = split_words(texts)
        which, hashes = pd.factorize(words.hashes())
        if len(self.number) + len(hashes) > _MOST_WORDS:
            self._forget()
        hashes = hashes.tolist()
        row = np.array([self.number.get(h, -1) for h in hashes], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            at = np.empty(len(hashes), np.int64)
            at[which[::-1]] = np.arange(len(which))[::-1]
            text, starts, ends = words.data.tobytes(), words.start[at[new]].tolist(), words.end[at[new]].tolist()
            found = self._words([text[a:b].decode() for a, b in zip(starts, ends)])
            row[new] = len(self.number) + np.arange(len(new))
            self.number.update(zip([hashes[i] for i in new.tolist()], row[new].tolist()))
            self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), "<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in found])])
        row = row[which]
        begin, count = self.ends[row], self.ends[row + 1] - self.ends[row]
        upto = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], count)]
        return ids, upto[words.first[1:]]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for ``doc_id, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        end = np.array([end_id], "<u4").tobytes()
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                ids, ends = vocabulary.encode(part.column("text"))
                begin = 0
                for i, stop in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    own = ids[begin:stop].tobytes() + end
                    begin = stop
                    for n, at in enumerate(range(0, len(own), capacity * _ID_BYTES)):
                        cut = own[at : at + capacity * _ID_BYTES]
                        out.append((i, n, n * capacity, len(cut) // _ID_BYTES, zlib.crc32(cut)))
                columns = zip(*out) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.mapInArrow(scan, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


# --- plan ----------------------------------------------------------------------


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """``length, times`` of a combination of the lengths, no more of each than there
    are, with the largest sum that fits ``room``. Long pieces are preferred: a length is
    looked at only if the longer ones do not fill the room, and used as little as can be."""
    mask = (1 << (room + 1)) - 1
    reach, before, lengths = 1, [], sorted((x for x in counts if x <= room), reverse=True)
    for length in lengths:
        before.append(reach)
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for length, reach in zip(reversed(lengths[: len(before)]), reversed(before)):
        times = 0
        while not reach >> (total - times * length) & 1:
            times += 1
        if times:
            out.append((length, times))
            total -= times * length
    return out


@dataclass
class Plan:
    """Entries by length and number: pieces ``first`` and on of a length go, ``times``
    each, to sequences ``sequence`` and on, from ``offset``."""

    key: np.ndarray  # length and first, in one integer
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, _key(length, pos), "right") - 1
        pos = pos - (self.key[at] & _FIRST)
        nth, within = np.divmod(pos, self.times[at]) if len(pos) else (pos, pos)
        return self.sequence[at] + nth, self.offset[at] + within * length


_SHIFT = 44
_FIRST = np.int64((1 << _SHIFT) - 1)


def _key(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (np.asarray(length, np.int64) << _SHIFT) | np.asarray(first, np.int64)


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """Where the pieces of each length go, and how many sequences there are."""
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = {longest: 1}
        for length, times in fullest({x: n for x, n in left.items() if n}, capacity - longest):
            chosen[length] = chosen.get(length, 0) + times
        left[longest] += 1
        again = min(left[x] // times for x, times in chosen.items())
        offset = 0
        for length, times in chosen.items():
            rows.append((length, used[length], times, sequence, offset))
            offset += times * length
            used[length] += times * again
            left[length] -= times * again
            if not left[length]:
                del left[length]
        sequence += again
    rows.sort()
    length, first, times, at, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
    return Plan(_key(length, first), times, at, offset), sequence


def pack(
    docs: DataFrame, text: str = "text", id: str = "doc_id", path: str | None = None,  # noqa: A002
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    given = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    cut = written(spark, pieces(given, path, capacity, end_id), "pieces")
    # One row per length, of which there are ``capacity`` at most.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_sequences(counts, capacity)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, pos: pa.Array) -> pa.Array:
        sequence, offset = plan.place(length.to_numpy(), pos.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], "ranked-pieces").withColumn("at", place("length", "pos"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
