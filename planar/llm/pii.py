"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns with their checks give the base spans. The CRF is trained on a small
table of lines labelled by them: a line whose matches all pass is a labelled line,
a line with a match that failed its check has no sure label and is left out. It
knows words only by their shape (``aA9`` classes, runs shortened), so it also
finds what has the form but fails a check, or stands in a form that the patterns
do not cover. Its spans are added where they touch no base span.

Defined cases: a NULL text is an empty one and has no spans; without any labelled
line the CRF adds nothing. Rows are scanned one by one; repeated rows and further
columns stay as they are. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.spans import SPANS, Span, apart, span_array
from planar.llm.words import Words, hash_runs, split_words

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base scan. An email is found from its @, the
# others start where a run of their first class starts.
_LOCAL = "A-Za-z0-9._%+-"
_LOCAL_BACK = re.compile(f"[{_LOCAL}]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Training table: at most this many lines, from at most this many documents.
TRAIN_LINES = 2_000
TRAIN_DOCS = 4_000
_LINE_WORDS = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterable[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_BACK.match(text[done:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield "email", at - len(local[0]), domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans that passed their checks, and those that failed."""
    good, bad = list(_emails(text)), []
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        # Leading zeros may make a part long, not large.
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
        (good if fits else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            (good if _luhn(digits) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (good if 8 <= n <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


# --- word shapes ---------------------------------------------------------------

# One label for the first and one for the further words of each kind, 0 outside.
_FIRST = {kind: 1 + 2 * i for i, kind in enumerate(KINDS)}
N_LABELS = 1 + 2 * len(KINDS)

_PUNCTUATION = """!"#$%&'*,.:;<=>?[]`{|}~"""
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_REPEATED = re.compile(r"(.)\1+")
# Runs are cut to this length: digits hardly ever, anything else after three.
_DIGIT_RUN, _OTHER_RUN = 20, 3


def word_shapes(words: Words) -> tuple[list[str], np.ndarray]:
    """The distinct shapes in a batch, and which one each word has."""
    if not len(words.start):
        return [], np.zeros(0, np.int64)
    classes = _CLASS[words.data]
    fresh = np.ones(len(classes), bool)
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[words.start] = True
    began = np.maximum.accumulate(np.where(fresh, np.arange(len(classes)), 0))
    run = np.arange(len(classes)) - began
    keep = run < np.where(classes == ord("9"), _DIGIT_RUN, _OTHER_RUN)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    kept = classes[keep]
    start, end = kept_before[words.start], kept_before[words.end]
    _, sample, which = np.unique(hash_runs(kept, start, end), return_index=True, return_inverse=True)
    return [kept[start[i] : end[i]].tobytes().decode("ascii") for i in sample], which


def features(shape: str) -> list[str]:
    bare = shape.strip(_PUNCTUATION)
    digits = bare.count("9")
    found = ["any", f"shape={bare}", "brief=" + _REPEATED.sub(r"\1", bare), f"digits={digits}"]
    found += [f"has={c}" for c in "@+.()-" if c in bare]
    if not digits:
        found.append("no digit")
    elif "a" in bare or "A" in bare:
        found.append("mixed" if "@" not in bare else "mixed @")
    return found


# --- the model -----------------------------------------------------------------


@dataclass
class Crf:
    """``weights[f, o, y]``: feature ``f`` of the word before (o = 0), the word
    itself or the word after, for label ``y``; ``steps[a, b]``: label b after a."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def matrix(self, shapes: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(shapes), len(self.vocabulary)), np.float32)
        for i, shape in enumerate(shapes):
            out[i, [self.vocabulary[f] for f in features(shape) if f in self.vocabulary]] = 1
        return out

    def emissions(self, shapes: Sequence[str], which: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Score of every label for every word; neighbours count within a line."""
        parts = np.einsum("sf,foy->osy", self.matrix(shapes), self.weights)
        out = parts[1][which]
        joined = (line[1:] == line[:-1])[:, None]
        out[1:] += np.where(joined, parts[0][which[:-1]], 0)
        out[:-1] += np.where(joined, parts[2][which[1:]], 0)
        return out

    def decode(self, shapes: Sequence[str], which: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Viterbi over all lines at once, a step per place in the line."""
        scores = self.emissions(shapes, which, line)
        if not len(scores):
            return np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        length = np.diff(np.concatenate([begin, [len(line)]]))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # lines with a word at each place
        back = np.zeros((len(line), N_LABELS), np.int8)
        best = scores[begin].copy()
        for t in range(1, length[0]):
            n = live[t]
            reach = best[:n, :, None] + self.steps
            at = begin[:n] + t
            back[at] = reach.argmax(1)
            best[:n] = reach.max(1) + scores[at]
        labels = np.zeros(len(line), np.int64)
        label = best.argmax(1)
        for t in range(length[0] - 1, -1, -1):
            n = live[t]
            at = begin[:n] + t
            labels[at] = label[:n]
            label[:n] = back[at, label[:n]]
        return labels


def fit(lines: Sequence[tuple[Sequence[str], Sequence[int]]], rounds: int = 80, l2: float = 0.002) -> Crf:
    """Maximum likelihood by forward-backward and Adagrad, on ``(shapes, labels)``."""
    shapes = sorted({s for line, _ in lines for s in line})
    index = {s: i for i, s in enumerate(shapes)}
    names = sorted({f for s in shapes for f in features(s)})
    crf = Crf({f: i for i, f in enumerate(names)}, np.zeros((len(names), 3, N_LABELS), np.float32),
              np.zeros((N_LABELS, N_LABELS), np.float32))
    if not lines:
        return crf
    n, longest = len(lines), max(len(s) for s, _ in lines)
    which, gold = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, (line, labels) in enumerate(lines):
        which[i, : len(line)] = [index[s] for s in line]
        gold[i, : len(line)] = labels
        real[i, : len(line)] = True
    x = crf.matrix(shapes)
    hot = np.eye(N_LABELS, dtype=np.float32)[gold] * real[:, :, None]
    both = real[:, 1:] & real[:, :-1]
    seen_steps = np.einsum("ntb,ntc->bc", hot[:, :-1] * both[:, :, None], hot[:, 1:])
    sums = [np.full(crf.weights.shape, 1e-6, np.float32), np.full(crf.steps.shape, 1e-6, np.float32)]
    for _ in range(rounds):
        parts = np.einsum("sf,foy->osy", x, crf.weights)
        e = parts[1][which]
        e[:, 1:] += np.where(both[:, :, None], parts[0][which[:, :-1]], 0)
        e[:, :-1] += np.where(both[:, :, None], parts[2][which[:, 1:]], 0)
        push = np.exp(crf.steps)
        e = np.exp(e - e.max(2, keepdims=True))
        ahead, behind = np.zeros_like(e), np.ones_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            a = (ahead[:, t - 1] @ push) * e[:, t]
            ahead[:, t] = np.where(real[:, t, None], a / a.sum(1, keepdims=True), ahead[:, t - 1])
        pairs = np.zeros_like(crf.steps)
        for t in range(longest - 2, -1, -1):
            b = e[:, t + 1] * behind[:, t + 1]
            joint = ahead[:, t, :, None] * push * b[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += (joint * both[:, t, None, None]).sum(0)
            b = b @ push.T
            behind[:, t] = np.where(both[:, t, None], b / b.sum(1, keepdims=True), 1)
        p = ahead * behind
        gap = hot - p / p.sum(2, keepdims=True) * real[:, :, None]
        grad = np.zeros((3, len(shapes), N_LABELS), np.float32)
        np.add.at(grad[1], which[real], gap[real])
        np.add.at(grad[0], which[:, :-1][both], gap[:, 1:][both])
        np.add.at(grad[2], which[:, 1:][both], gap[:, :-1][both])
        steps = [np.einsum("sf,osy->foy", x, grad) / n - l2 * crf.weights, (seen_steps - pairs) / n - l2 * crf.steps]
        for value, total, step in zip((crf.weights, crf.steps), sums, steps):
            total += step * step
            value += 0.5 * step / np.sqrt(total)
    return crf


# --- between texts and the model -----------------------------------------------


def _lines(words: Words) -> np.ndarray:
    """A number for the line of each word; a line ends with its text, too."""
    ends = np.concatenate([[0], np.cumsum(words.data == ord("\n"))])
    return ends[words.start] + words.text


def labelled_lines(texts: pa.Array, negatives: int = 1) -> list[list[tuple[str, int]]]:
    """``(shape, label)`` of the words around base spans, for lines that are sure,
    around digits that are none, and of some other lines."""
    out = []
    for text in texts.to_pylist():
        for line in (text or "").split("\n"):
            good, bad = candidates(line)
            digit = re.search("[0-9]", line)
            if bad or not (good or digit or len(line) % 16 < negatives):
                continue
            words = split_words(pa.array([line]))
            shapes, which = word_shapes(words)
            at = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            start, end = at[words.start], at[words.end]
            labels = np.zeros(len(start), np.int64)
            for kind, s, e in good:
                inside = np.flatnonzero((start < e) & (end > s))
                labels[inside] = _FIRST[kind] + 1
                labels[inside[:1]] = _FIRST[kind]
            at = good[0][1] if good else digit.start() if digit else 0
            first = int(np.searchsorted(end, at, "right"))
            span = slice(max(0, first - _LINE_WORDS // 2), first + _LINE_WORDS // 2)
            out.append([(shapes[w], int(y)) for w, y in zip(which[span], labels[span])])
    return out


def train(docs: DataFrame, text: str = "text", lines: int = TRAIN_LINES, sample: int = TRAIN_DOCS) -> Crf:
    """A model from at most ``lines`` lines out of about ``sample`` documents, both
    chosen by hash; bounded, so the driver can hold them."""

    @F.arrow_udf("array<array<struct<shape:string,label:bigint>>>")
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("shape", pa.string()), ("label", pa.int64())])))
        return pa.array(
            [[[{"shape": s, "label": y} for s, y in line] for line in labelled_lines(pa.array([t], pa.string()))]
             for t in texts.to_pylist()], kind)

    n = max(1, docs.count())
    chosen = docs.select(F.col(f"`{text}`").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(n)) < sample)
    rows = chosen.distinct().select(F.explode(cut("t")).alias("line")).distinct()
    rows = rows.orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    return fit([([w.shape for w in r.line], [w.label for w in r.line]) for r in rows if r.line])


def _added(texts: list[str], array: pa.Array, crf: Crf) -> list[list[Span]]:
    """What the model finds in each text."""
    words = split_words(array)
    shapes, which = word_shapes(words)
    labels = crf.decode(shapes, which, _lines(words))
    found: list[list[Span]] = [[] for _ in texts]
    hits = np.flatnonzero(labels)
    owner = np.searchsorted(words.first, hits, "right") - 1
    runs: list[list[int]] = []
    for i, w in enumerate(hits):
        y = labels[w]
        if y % 2 == 0 and runs and runs[-1][1] == w - 1 and runs[-1][0] == owner[i] and labels[w - 1] in (y, y - 1):
            runs[-1][1] = int(w)
        else:
            runs.append([int(owner[i]), int(w), int(w), int((y - 1) // 2)])
    for text, last, first, kind in runs:
        base = words.text_at[text]
        raw = words.data[base : words.end[last]].tobytes()
        s = len(raw[: words.start[first] - base].decode())
        piece = raw[words.start[first] - base :].decode()
        left = len(piece) - len(piece.lstrip(_PUNCTUATION))
        right = len(piece.rstrip(_PUNCTUATION))
        if left < right:
            found[text].append((KINDS[kind], s + left, s + right))
    return found


def personal_spans(text: str | Column, crf: Crf) -> Column:
    """Array of ``kind, start, end``: base spans with ``base`` true and the spans
    that the model adds, by kind as listed, then start."""

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def scan(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        values = [t or "" for t in texts.to_pylist()]
        base_spans, all_spans = [], []
        for begin, part in _parts(values):
            more = _added(part, texts.slice(begin, len(part)), crf)
            for t, extra in zip(part, more):
                base = candidates(t)[0]
                extra = list(apart(sorted(extra, key=lambda s: s[1]), base))
                base_spans.append(ordered(base))
                all_spans.append(ordered(base + extra))
        return pa.StructArray.from_arrays([span_array(base_spans), span_array(all_spans)], names=["base", "spans"])

    return scan(text)


def _parts(values: list[str], most: int = 2 << 20) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts with about ``most`` characters, which bounds the arrays."""
    begin, size = 0, 0
    for i, value in enumerate(values):
        if size and size + len(value) > most:
            yield begin, values[begin:i]
            begin, size = i, 0
        size += len(value)
    if values:
        yield begin, values[begin:]
