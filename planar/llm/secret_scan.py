"""Secret scan: fixed patterns, and runs that a tokenizer spends many tokens on.

A byte-pair vocabulary takes few tokens for the kind of text it was made from,
and many for random strings. A run of key-like characters with few characters
per token is reported as ``random``, unless it is a digest of a usual length, a
UUID or reads like an identifier or a path: its parts are letters, perhaps with up to
eight digits behind, and the letters by themselves take few tokens.

Defined cases: a NULL text is an empty one and has no spans. Rows are scanned one
by one; repeated rows and further columns stay as they are. Positions count code
points, ends are exclusive.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from planar.llm.spans import SPANS, Span, apart, span_array

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")

# The patterns and least lengths of the base scan.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST["hex"])
# One of these occurs in lower case in whatever ASSIGN finds.
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

# Prose takes four characters and more per token, random base-62 less than two.
LEAST_RUN = 20
MOST_CHARS_PER_TOKEN = 2.0
MASK = "[secret]"
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_JOINT = re.compile(r"[+/_=-]+")
_NAME_PART = re.compile(r"([A-Za-z]*)[0-9]{0,8}")
# Parts of a name that are this short need not tokenize well by themselves.
_SHORT_PART = 4


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    name = os.path.basename(path)
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _is_name(run: str, encoding, most_chars_per_token: float) -> bool:
    """Names, paths and dates: parts of letters, perhaps with a number behind. The
    letters of all parts, and of each that is not short, take few tokens."""
    parts = [_NAME_PART.fullmatch(part) for part in _JOINT.split(run)]
    if not all(parts):
        return False
    letters = [m[1] for m in parts if m[1]]
    tokens = [len(encoding.encode_ordinary(x)) for x in letters]
    if any(len(x) > _SHORT_PART and len(x) <= most_chars_per_token * n for x, n in zip(letters, tokens)):
        return False
    return not letters or sum(map(len, letters)) > most_chars_per_token * sum(tokens)


def is_known_form(run: str, encoding, most_chars_per_token: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Digests, UUIDs, and what reads like a name."""
    if len(run) in _DIGEST_LENGTHS and _HEX_ONLY.fullmatch(run):
        return True
    return bool(_UUID.fullmatch(run)) or _is_name(run, encoding, most_chars_per_token)


def base_spans(text: str) -> list[Span]:
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in _ASSIGN_HINTS):
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def find(text: str, encoding, most_chars_per_token: float) -> list[Span]:
    """All spans of a text by start, then kind. ``random`` ones touch no other."""
    spans = base_spans(text)
    runs = [("random", *m.span()) for m in _RUN.finditer(text)]
    for span in list(apart(runs, spans)):
        run = text[span[1] : span[2]]
        few = len(run) <= most_chars_per_token * len(encoding.encode_ordinary(run))
        if few and not is_known_form(run, encoding, most_chars_per_token):
            spans.append(span)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch that spans cover replaced by ``MASK``."""
    parts, at, covered = [], 0, -1
    for _, start, end in spans:
        if start >= covered:
            parts += [text[at:start], MASK]
        covered = max(covered, end)
        at = covered
    return "".join(parts) + text[at:]


def secret_spans(
    text: str | Column,
    vocabulary: str | None = None,
    most_chars_per_token: float = MOST_CHARS_PER_TOKEN,
) -> Column:
    """Array of ``kind, start, end`` for a text column, by start, then kind.

    ``vocabulary`` is the path of a rank file that every executor can open; the
    installed public one by default.
    """

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        encoding = _encoding(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        found = [find(t or "", encoding, most_chars_per_token) for t in texts.to_pylist()]
        return span_array(found)

    return scan(text)


def mask_secrets(
    text: str | Column,
    vocabulary: str | None = None,
    most_chars_per_token: float = MOST_CHARS_PER_TOKEN,
) -> Column:
    """The text with its secrets replaced; NULL stays NULL."""

    @F.arrow_udf("string")
    def scan(texts: pa.Array) -> pa.Array:
        encoding = _encoding(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        out = [None if t is None else masked(t, find(t, encoding, most_chars_per_token)) for t in texts.to_pylist()]
        return pa.array(out, pa.string())

    return scan(text)

