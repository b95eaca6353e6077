"""Columns derived from arrays of ``kind, start, end``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
Span = tuple[str, int, int]


def span_array(found: list[list[Span]]) -> pa.Array:
    """Spans of several texts as the Arrow form of ``SPANS``."""
    flat = [span for spans in found for span in spans]
    offsets = [0]
    for spans in found:
        offsets.append(offsets[-1] + len(spans))
    types = (pa.string(), pa.int64(), pa.int64())
    fields = [pa.array([span[i] for span in flat], kind) for i, kind in enumerate(types)]
    values = pa.StructArray.from_arrays(fields, names=["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def apart(spans: list[Span], taken: list[Span]) -> Iterator[Span]:
    """Those of ``spans`` (by start) that overlap none of ``taken``; goes once through both."""
    cover: list[list[int]] = []
    for _, start, end in sorted(taken, key=lambda s: s[1]):
        if cover and start <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], end)
        else:
            cover.append([start, end])
    at = 0
    for span in spans:
        while at < len(cover) and cover[at][1] <= span[1]:
            at += 1
        if at == len(cover) or span[2] <= cover[at][0]:
            yield span


def of_kinds(spans: str, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(list(kinds)))


def n_spans(spans: str, kind: str) -> Column:
    return F.size(of_kinds(spans, [kind])).cast("bigint").alias(f"n_{kind}")


def spans_text(spans: str | Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
