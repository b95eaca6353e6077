"""Alignment of two tokenizers' ids over the same text, by byte offsets.

Both tokenizers encode a text; the running byte lengths of their tokens are offsets
at which tokens end. Dictionaries lead from such an end to the token's index, the ends
that both dictionaries have, sorted, slice both id lists into groups, and every token
of one side in a group is linked with every token of the other.

Neither tokenizer has a token across a place where a printable character is followed by a
space, or a letter by a digit or sign, so both have a token end there. Texts are cut
at these places; a worker encodes and aligns the pieces it has not seen, all
at once, and keeps what it found. That the tokens' bytes spell a piece is tested, and a
text with a piece that fails is done again as a whole. A vocabulary with other habits is
never cut (``Pair.cuts``).

A task turns some megabytes of texts into one row, a chunk: the documents' figures,
the distinct id pairs among them, with the number of documents that hold each, and
which documents hold which pairs. Pairs are counted over all chunks, so that a pair
that every document holds is one row per chunk, and a chunk gets the counts of its own
pairs back to sum them up per document.

Defined cases: texts that are NULL or empty, or that the tokens' bytes do not spell,
have no tokens. Repeated rows count as documents each, NULL ids too. Further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written
from planar.llm.words import slices

CHUNK_BYTES = 4 << 20
# What a worker remembers: so many pieces, and beside them those of one chunk.
_MOST_PIECES = 300_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = r"!-@\[-`{-~"
_CUT = re.compile(rf"(?<=[!-~\w])(?= )|(?<=[{_LETTER}])(?=[{_SIGN}])")
# Plain pieces, and their parts as the byte-level vocabulary's own pattern has them.
_PLAIN = re.compile(rf" ?[{_LETTER}{_SIGN}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ 0-9{_LETTER}]+")
_MOST_LINKS = 10_000
_SPACE_MARK = "▁"
# Breaks off the space that B adds; no piece has one.
_SENTINEL = "\n"
_DOCS = (
    "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>")
_CHUNK = f"chunk bigint, docs {_DOCS}, ends binary, which binary, times binary, pairs array<bigint>, holders array<bigint>"

def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes, in
    order, as the characters from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def slice_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side lie before the ends that both sides have."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return np.array([at_a[e] for e in common], np.int64), np.array([at_b[e] for e in common], np.int64)


def expand_links(
    a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair and times of the links in each slice ``a[first_a:][:n_a]`` with
    ``b[first_b:][:n_b]``; equal pairs of a long slice come once."""
    long = n_a * n_b > _MOST_LINKS
    small = np.flatnonzero(~long)
    count = (n_a * n_b)[small]
    group = np.repeat(small, count)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    x, y = np.divmod(nth, n_b[group]) if len(nth) else (nth, nth)
    groups, pairs = [group], [a[first_a[group] + x] * size_b + b[first_b[group] + y]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(long):
        x, m = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, n = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs.append((x[:, None] * size_b + y[None]).ravel())
        times.append((m[:, None] * n[None]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


class Pair:
    """A byte-level vocabulary (A) and a sentence-piece one (B), and what is known of
    pieces so far: by number, whether the tokens spell it, its figures, its groups as
    text, and its id pairs."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        symbols = byte_of_symbol()
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        entries = (self.a.id_to_token(i) or "" for i in range(size_a))
        self.bytes_a = [bytes(symbols[c] for c in e) if all(c in symbols for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(i) for i in range(n)] for n in (size_a, self.size_b))
        self.symbol = {b: c for c, b in symbols.items()}
        splitter = json.loads(self.a.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        joins = re.compile(rf"[^{_SPACE_MARK}]{_SPACE_MARK}|[{_LETTER}][{_SIGN}]|{_SENTINEL}")
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = (
            splitter["normalizer"] is None
            and byte_level.items() <= (splitter["pre_tokenizer"] or {}).items()
            and not any(joins.search(p) for p in plain)
            and self.bytes_b[self.b.encode(_SENTINEL)[-1]] == _SENTINEL.encode())
        self._parts: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.right: list[bool] = []
        self.groups: list[str] = []
        self._figures: list[np.ndarray] = []
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _ids_a(self, string: str) -> list[int]:
        if not (self.cuts and _PLAIN.fullmatch(string)):
            return self.a.encode(string, add_special_tokens=False).ids
        out = []
        for part in _PARTS.findall(string):
            ids = self._parts.get(part)
            if ids is None:
                symbols = part.encode().decode("latin-1").translate(self.symbol)
                if len(self._parts) > _MOST_PIECES:
                    self._parts = {}
                ids = self._parts[part] = [t.id for t in self.a.model.tokenize(symbols)]
            out += ids
        return out

    def _ids_b(self, strings: list[str]) -> list[list[int]]:
        """Without the space that B adds, which whole texts already start with."""
        if self.cuts:
            head = len(self.b.encode(_SENTINEL))
            return [ids[head:] for ids in self.b.encode([_SENTINEL + s for s in strings], num_threads=1)]
        return self.b.encode([s[1:] for s in strings], num_threads=1)

    def add(self, strings: list[str]) -> None:
        """Encode and align strings, as the next numbers."""
        ids_a, ids_b = [self._ids_a(s) for s in strings], self._ids_b(strings)
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        right = [
            (given := s.encode()) == b"".join(map(spell_a, x)) and given == b"".join(map(spell_b, y))
            for s, x, y in zip(strings, ids_a, ids_b)]
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, right)] for ids in (ids_a, ids_b))
        size_a, size_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        # All strings in one line: each ends where both sides have an end.
        cut_a, cut_b = slice_ends(np.cumsum(self.length_a[a]).tolist(), np.cumsum(self.length_b[b]).tolist())
        first_a, first_b = np.append(0, cut_a)[:-1], np.append(0, cut_b)[:-1]
        owner = np.searchsorted(np.cumsum(size_a), first_a, "right")
        n_a, n_b = cut_a - first_a, cut_b - first_b
        group, pairs, times = expand_links(a, b, first_a, first_b, n_a, n_b, self.size_b)
        owned = owner[group]
        if len(owned) and (np.diff(owned) < 0).any():
            order = np.argsort(owned, kind="stable")
            owned, pairs, times = owned[order], pairs[order], times[order]
        n = len(strings)
        links = np.bincount(owned, weights=times, minlength=n).astype(np.int64)
        groups = np.bincount(owner, minlength=n)
        self._figures.append(np.stack([size_a, size_b, groups, links], 1))
        self._pairs.append((np.bincount(owned, minlength=n), pairs, times))
        self.right += right
        forms = self._forms(a.tolist(), b.tolist(), first_a.tolist(), first_b.tolist(), n_a, n_b)
        at = 0
        for m in groups.tolist():
            self.groups.append(";".join(forms[at : at + m]))
            at += m

    def _forms(self, a, b, first_a, first_b, n_a, n_b) -> list[str]:
        text_a, text_b = self.text_a, self.text_b
        out = [f"{text_a[a[i]]}|{text_b[b[j]]}" for i, j in zip(first_a, first_b)]
        for g in np.flatnonzero((n_a != 1) | (n_b != 1)).tolist():
            x, y = a[first_a[g] : first_a[g] + int(n_a[g])], b[first_b[g] : first_b[g] + int(n_b[g])]
            out[g] = ",".join([text_a[i] for i in x]) + "|" + ",".join([text_b[i] for i in y])
        return out

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's pieces, after all are known."""
        if len(self.right) > _MOST_PIECES:
            self._forget()
        next_, own, new = len(self.right), [], []
        number = self.number
        for text in texts:
            places = []
            for p in () if not text else _CUT.split(" " + text) if self.cuts else (" " + text,):
                i = number.get(p)
                if i is None:
                    i = number[p] = next_ + len(new)
                    new.append(p)
                places.append(i)
            own.append(places)
        if new:
            self.add(new)
        wrong = {i for i, ok in enumerate(self.right) if not ok}
        if wrong and self.cuts:
            # The whole text decides, and is then a piece of its own.
            again = [i for i, places in enumerate(own) if not wrong.isdisjoint(places)]
            first = len(self.right)
            if again:
                self.add([" " + texts[i] for i in again])
            for nth, i in enumerate(again):
                own[i] = [first + nth]
        return own

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By number: figures; and how many pairs; and the pairs and their times."""
        if len(self._figures) > 1:
            self._figures = [np.concatenate(self._figures)]
            self._pairs = [tuple(np.concatenate(c) for c in zip(*self._pairs))]
        empty = np.zeros(0, np.int64)
        return (self._figures[0] if self._figures else np.zeros((0, 4), np.int64), *(self._pairs[0] if self._pairs else (empty,) * 3))


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _align_texts(pair: Pair, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Per text its figures; and, for all texts, ``owner, pair, times`` of what it holds."""
    own = pair.numbers(texts)
    tallies, held, known_pairs, known_times = pair.found()
    size = np.array([len(places) for places in own], np.int64)
    place = np.fromiter((p for places in own for p in places), np.int64, int(size.sum()))
    owner = np.repeat(np.arange(len(own)), size)
    sums = np.stack([
        np.bincount(owner, weights=tallies[place, c], minlength=len(own)).astype(np.int64) for c in range(4)], 1)
    figures = []
    for row, places in zip(sums.tolist(), own):
        groups = ";".join([g for p in places if (g := pair.groups[p])])
        figures.append((*row, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    # The pairs of each text's pieces, equal ones summed.
    begin = np.cumsum(held) - held
    count = held[place]
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first - begin[place], count)
    pairs, times, owner = known_pairs[at], known_times[at], np.repeat(owner, count)
    distinct, which = np.unique(pairs, return_inverse=True)
    key, spot = np.unique(owner * max(1, len(distinct)) + which, return_inverse=True)
    total = np.bincount(spot, weights=times, minlength=len(key)).astype(np.int64)
    return figures, key // max(1, len(distinct)), distinct[key % max(1, len(distinct))], total


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, text`` to one row per chunk of texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                figures, owner, pairs, times = _align_texts(pair, part.column("text").to_pylist())
                distinct, which, holders = np.unique(pairs, return_inverse=True, return_counts=True)
                ends = np.searchsorted(owner, np.arange(part.num_rows), "right")
                names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                rows = [dict(zip(names, row), doc_id=i) for row, i in zip(figures, part.column("doc_id").to_pylist())]
                yield pa.RecordBatch.from_pylist([{
                    "chunk": number, "docs": rows, "ends": _packed(ends), "which": _packed(which), "times": _packed(times),
                    "pairs": distinct, "holders": holders}], _chunk_schema())
                number += 1

    return docs.mapInArrow(scan, _CHUNK)


def _chunk_schema() -> pa.Schema:
    long = pa.int64()
    doc = [("doc_id", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", pa.string())]
    return pa.schema([
        ("chunk", long), ("docs", pa.list_(pa.struct(doc))), ("ends", pa.binary()), ("which", pa.binary()),
        ("times", pa.binary()), ("pairs", pa.list_(long)), ("holders", pa.list_(long))])


def _summed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk, with sums over their links."""
    answers = answers.sort_by("pair")
    n, best = answers.column("n").to_numpy(), answers.column("best").to_numpy().astype(bool)
    rows = []
    for row in chunk.to_pylist():
        which, times, ends = _unpacked(row["which"]), _unpacked(row["times"]), _unpacked(row["ends"])
        running = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[which], times * n[which])]
        first = np.concatenate([[0], ends[:-1]])
        for i, doc in enumerate(row["docs"]):
            doc["n_best"], doc["count_sum"] = (int(r[ends[i]] - r[first[i]]) for r in running)
            rows.append(doc)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return pa.Table.from_pylist(rows, pa.schema([(c, pa.int64()) for c in names] + [("groups_sha256", pa.string())]))


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """``pair, n`` (documents that hold it linked) ``, best``: no pair of its A id has more."""
    held = parts.select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    # An A id has as many pairs as B has ids, at most.
    same_a = Window.partitionBy(F.floor(F.col("pair") / size_b))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(same_a)).alias("best"))


def align(
    docs: DataFrame, text: str = "text", id: str = "doc_id",  # noqa: A002
    path_a: str | None = None, path_b: str | None = None,
) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``; the vocabularies are files that every executor can open."""
    spark = docs.sparkSession
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    given = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = written(spark, chunks(given, path_a, path_b), "chunks")
    counts = written(spark, pair_counts(parts, load(path_a, path_b).size_b), "pair-counts")
    asked = parts.select(F.col("chunk").alias("asker"), F.explode("pairs").alias("pair"))
    answers = attach(asked, counts, "pair", "inner")
    return parts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(
        _summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
        "count_sum bigint, groups_sha256 string")
