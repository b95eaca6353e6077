"""WARC archives: written and read by tasks, verified as chains of records.

Writing. A record per row through Spark's text writer, whose line separator closes
the record, so archives can go wherever Spark can write. Of the rows with equal
payloads of some size the one with the smallest id is a response, the others are
revisit records without a payload that refer to it.

Reading. Spark's text reader cuts the files, in blocks, at every place that looks
like the start of a record, and so also inside payloads that hold such bytes. The
place of each piece in its file is a running sum of lengths, within each block and
over the blocks. A piece with a readable header is a candidate with a successor:
the place behind its content. The task also follows successors to where they leave
its block. Pointer jumping from the start of each file over these exits, four and
their multiples per round, finds where the chain enters each block, and a walk from
there keeps the candidates that are reached. A record that was cut is put together
again from the pieces between it and its successor.

Defined cases: a NULL or empty payload is a record of length 0. Rows with a NULL id
are responses that nothing refers to. Repeated rows with the smallest id are all
responses. A broken or cut off record ends the chain of its file. Further columns
are ignored, whatever their names. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written
from planar.plans.scratch import scratch_path
from planar.plans.sizing import fits_broadcast

MAGIC = "WARC/1.0\r\n"
_GAP = "\r\n\r\n"  # behind the headers and behind the content
LEAST_SHARED_BYTES = 100
RECORDS_PER_FILE = 16_384
_HOPS = 4
_URN = "urn:page:"


# --- writing -------------------------------------------------------------------


def classify(pages: DataFrame, payload: Column, page_id: str, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, size, refers_to`` for every row.

    Only ids and digests are grouped. The revisits are joined back by digest,
    as a broadcast if they were measured to be small, else in salted parts, so
    that a digest that many rows share does not meet in one task.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")
    ).where(F.col("first") < F.col("last")).select("digest", "first")
    rows = attach(rows, written(pages.sparkSession, shared, "warc-shared"), "digest")
    refers = F.when((F.col("size") >= least) & (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.withColumn("refers_to", refers).drop("first")


def _record(rows: DataFrame) -> Column:
    """A whole record but for its last byte, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    own = F.coalesce(F.concat(F.lit(f"<{_URN}"), F.col("page_id").cast("string"), F.lit(">")), F.lit(f"<{_URN}none>"))
    to = F.concat(F.lit(f"WARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"), F.lit(">\r\n"))
    return F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), own, F.lit("\r\n"), F.when(revisit, to).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(_GAP),
        F.when(revisit, "").otherwise(F.col("payload")), F.lit(_GAP[:-1]),
    )


def write(
    pages: DataFrame, path: str, payload: Column | None = None, page_id: str = "page_id",
    least: int = LEAST_SHARED_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Archives of the table below ``path``; by default of its ``html``."""
    rows = classify(pages, F.col("html").cast("string") if payload is None else payload, page_id, least)
    out = rows.select(_record(rows).alias("value"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


# --- reading -------------------------------------------------------------------

_PIECES = (
    "file string, block bigint, piece bigint, rel bigint, size bigint, reach bigint, exit bigint, complete boolean, "
    "type string, id string, refers_to string, digest string, payload_bytes bigint, payload_digest string"
)
_HEADER = re.compile(rb"([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r\n")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The raw pieces in order: the reader cuts at the magic and drops it."""
    pieces = spark.read.option("lineSep", MAGIC).text(path)
    return pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def parsed(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers, where the content starts, and its length; None if unreadable."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    headers, at = {}, 0
    while at < stop + 2:
        m = _HEADER.match(piece, at, stop + 2)
        if not m:
            return None
        headers[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    length = headers.get("content-length", "")
    if "warc-type" not in headers or not length.isdecimal():
        return None
    return headers, stop + 4, int(length)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """``file, block, number in the block, place in the block, piece``."""
    now, number, rel = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != now:
                now, number, rel = (file, block), 0, 0
            yield file, block, number, rel, value
            number, rel = number + 1, rel + len(value) + len(MAGIC)


_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("piece", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()),
    ("reach", pa.int64()), ("exit", pa.int64()), ("complete", pa.bool_()), ("type", pa.string()), ("id", pa.string()),
    ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def _candidate(value: bytes) -> dict:
    head = parsed(value)
    if head is None:
        return {"complete": False}
    headers, at, length = head
    complete = len(value) == at + length + 4
    return {
        "reach": at + length + 4, "complete": complete, "type": headers["warc-type"], "id": headers.get("warc-record-id"),
        "refers_to": headers.get("warc-refers-to"), "digest": headers.get("warc-payload-digest"), "payload_bytes": length,
        "payload_digest": hashlib.sha256(value[at : at + length]).hexdigest() if complete else None,
    }


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each block without their bytes, and where their chains leave it."""
    block: list[dict] = []

    def ended() -> pa.RecordBatch:
        exits = {}
        for row in reversed(block):
            if row.get("reach") is not None:
                then = row["rel"] + row["reach"] + len(MAGIC)
                row["exit"] = exits[row["rel"]] = exits.get(then, then)
        return pa.RecordBatch.from_pylist(block, schema=_SCHEMA)

    for file, number, piece, rel, value in _numbered(batches):
        if block and (block[0]["file"], block[0]["block"]) != (file, number):
            yield ended()
            block = []
        block.append({"file": file, "block": number, "piece": piece, "rel": rel, "size": len(value), **_candidate(value)})
    if block:
        yield ended()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its place ``at`` in the file and, where it has a header,
    the place ``to`` of its successor. Places are those of the magic."""
    pieces = written(spark, _scan(spark, path).mapInArrow(_candidates, _PIECES), "warc-pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # The piece before the first magic of a file sits, so to say, before the file.
    zero = F.col("base") - len(MAGIC)
    placed = pieces.join(blocks, ["file", "block"]).withColumns({
        "at": zero + F.col("rel"), "to": zero + F.col("rel") + len(MAGIC) + F.col("reach"), "exit": zero + F.col("exit")})
    return placed.drop("base", "rel")


def entries(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """``file, at`` of the places at which the chain from the start of each file
    comes into a block. Only exits can be such places, so few links take part.

    Each round follows 1 to 4 of the current jumps and then makes each jump four
    times as long. A jump to a place without a candidate ends its chain.
    """
    jumps = pieces.where(F.col("reach").isNotNull()).select("file", "at", F.col("exit").alias("to"))
    ways_in = jumps.select("file", F.col("to").alias("at")).unionByName(
        jumps.where(F.col("at") == 0).select("file", "at")).distinct()
    jumps = written(spark, jumps.join(ways_in, ["file", "at"]), "warc-exits")
    reached = jumps.where(F.col("at") == 0).select("file", "at")
    n = reached.count()
    while n:
        ways = jumps.select("file", F.col("at").alias("a0"), F.col("to").alias("b0"))
        for i in range(1, _HOPS):
            hop = jumps.select("file", F.col("at").alias(f"b{i - 1}"), F.col("to").alias(f"b{i}"))
            ways = ways.join(hop, ["file", f"b{i - 1}"], "left")
        ends = F.array(*[F.col(f"b{i}") for i in range(_HOPS)])
        ways = written(spark, ways.select("file", F.col("a0").alias("at"), ends.alias("ends")), "warc-jumps")
        met = reached.join(ways, ["file", "at"]).select("file", F.explode("ends").alias("at")).where(F.col("at").isNotNull())
        found = written(spark, reached.unionByName(met).distinct(), "warc-reached")
        grown = found.count()
        if grown == n:
            break
        reached, n = found, grown
        jumps = ways.select("file", "at", F.get("ends", F.lit(_HOPS - 1)).alias("to")).where(F.col("to").isNotNull())
    return reached


def _walk(block: pa.Table, entered: pa.Table) -> pa.Table:
    """The candidates of a block that are reached from where the chain comes in."""
    at, to = block.column("at").to_pylist(), block.column("to").to_pylist()
    place = {a: i for i, a in enumerate(at) if to[i] is not None}
    kept = set()
    for now in entered.column("at").to_pylist():
        while now in place and place[now] not in kept:
            kept.add(place[now])
            now = to[place[now]]
    return block.take(pa.array(sorted(kept), pa.int64())).select(_RECORD)


_RECORD = ["file", "at", "type", "id", "refers_to", "digest", "payload_bytes", "payload_digest", "complete"]


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, number, _, value in _numbered(batches):
        yield pa.RecordBatch.from_pydict(
            {"file": [file], "block": [block], "piece": pa.array([number], pa.int64()), "value": [value]})


def _put_together(pieces: pa.Table) -> pa.Table:
    """One row: length and digest of the content of a record cut into pieces."""
    pieces = pieces.sort_by("at")
    whole = MAGIC.encode().join(pieces.column("value").to_pylist())
    head = parsed(whole)
    good = head is not None and len(whole) == head[1] + head[2] + 4 and whole.endswith(_GAP.encode())
    digest = hashlib.sha256(whole[head[1] : head[1] + head[2]]).hexdigest() if good else None
    return pa.table({
        "file": pieces.column("file").slice(0, 1), "at": pieces.column("record").slice(0, 1),
        "joined_digest": pa.array([digest], pa.string()),
    })


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains of all archives below ``path``: ``file, at, type,
    id, refers_to, digest`` (as stated), ``payload_bytes, payload_digest`` (as read;
    NULL for a record that does not end as it should)."""
    pieces = written(spark, candidates(spark, path), "warc-candidates")
    chain = entries(spark, pieces)
    entered = pieces.select("file", "block", "at").join(chain, ["file", "at"], "left_semi")
    # New columns, for the cogroup to tell its sides apart.
    entered = entered.select(*[F.col(c).alias(c) for c in entered.columns])
    walked = pieces.groupBy("file", "block").cogroup(entered.groupBy("file", "block")).applyInArrow(
        _walk, pieces.select(*_RECORD).schema)
    records = written(spark, walked, "warc-chain")

    # Pieces between a record that was cut and its successor belong to it.
    starts = records.select("file", "at", F.col("at").alias("start"), (~F.col("complete")).alias("cut"))
    if starts.where("cut").isEmpty():
        return records.drop("complete")
    back = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = pieces.select("file", "block", "piece", "at").join(starts, ["file", "at"], "left").withColumns({
        "record": F.last("start", ignorenulls=True).over(back), "cut": F.last("cut", ignorenulls=True).over(back)})
    wanted = owned.where("cut").select("file", "block", "piece", "at", "record")
    raw = _scan(spark, path).mapInArrow(_raw, "file string, block bigint, piece bigint, value binary")
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    whole = raw.join(wanted, ["file", "block", "piece"]).select("file", "record", "at", "value")
    whole = whole.groupBy("file", "record").applyInArrow(_put_together, "file string, at bigint, joined_digest string")
    out = records.join(whole, ["file", "at"], "left")
    return out.withColumn("payload_digest", F.coalesce("payload_digest", "joined_digest")).drop("joined_digest", "complete")


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``write`` by page: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``; a revisit has those of the payload it refers to."""

    def page(urn: str) -> Column:
        return F.regexp_extract(urn, rf"^<{_URN}(-?[0-9]+)>$", 1).try_cast("bigint")

    records = read(spark, path).select(
        page("id").alias("page_id"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
        "payload_bytes", "payload_digest")
    records = written(spark, records, "warc-records")
    named = records.where(F.col("record_type") == "revisit").select("refers_to").distinct()
    responses = records.where(F.col("record_type") == "response").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    responses = responses.join(named, "refers_to", "left_semi").dropDuplicates(["refers_to"])
    out = attach(records, written(spark, responses, "warc-referred"), "refers_to")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page_id", F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_records`` of archives written to the shared folder for this call."""
    path = scratch_path(spark, "warc")
    write(pages, path)
    return page_records(spark, path)
