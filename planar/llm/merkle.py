"""Merkle tree over a table: a manifest, proofs for every row, and their check.

Leaves are numbered within their group by a range shuffle. An aligned block of
``ARITY ** BLOCK_LEVELS`` consecutive nodes is one row, which keeps each level as one
string of concatenated hex digests: the parents of a level are hashes of its
substrings of fixed width, the siblings of a node are the substrings to its left and
right in its run. The blocks' roots are the leaves of the next tree of blocks, and so
on until every group is one block; the roots of the groups make one more tree. A level
is kept as the bytes of its hex text, in which Spark finds a substring without counting
characters. Everything is made of built-in expressions.

Defined cases: a NULL column is ``-`` in its leaf. NULL ids come first in their group;
rows that agree in the id are ordered by their leaf, and repeated rows are leaves of
their own. A NULL group is a group of its own and comes first. A row with a NULL id is
not tampered with. Further columns are ignored, whatever their names; an empty table
has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.ranks import ranked
from planar.llm.scratch import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A node has up to so many children; a block has so many levels above its leaves.
ARITY, BLOCK_LEVELS = 8, 3
BLOCK = ARITY**BLOCK_LEVELS
HEX = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEGMENTS = "array<struct<left:binary,right:binary>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of a row: every field with its length before it."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _int(v: Column) -> Column:
    return v.cast("int")


def _parents(level: Column) -> Column:
    """The next level: hashes of runs of ``ARITY`` digests."""
    width = ARITY * HEX
    last = _int(F.ceil(F.octet_length(level) / F.lit(width))) - 1
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashed, "").cast("binary")


def _segment(level: Column, at: Column) -> Column:
    """What flanks digest number ``at`` in its run."""
    within = at % ARITY
    return F.struct(
        F.substring(level, (at - within) * HEX + 1, within * HEX).alias("left"),
        F.substring(level, (at + 1) * HEX + 1, (F.lit(ARITY - 1) - within) * HEX).alias("right"))


def fold(start: Column, segments: Column) -> Column:
    """The root that a digest leads to with these siblings, lowest level first."""
    return F.aggregate(
        segments, start,
        lambda node, s: F.sha2(F.concat(s["left"], node.cast("binary"), s["right"]), 256))


def proof_digest(segments: Column) -> Column:
    """The hash of all siblings, level by level."""
    joined = F.aggregate(segments, F.lit(b""), lambda all_, s: F.concat(all_, s["left"], s["right"]))
    return F.sha2(joined, 256)


@dataclass
class Tree:
    """``blocks`` has, per group ``grp`` and ``block``, its nodes (``items``: ``pos``,
    ``digest``, ``carry``), the strings ``level0`` and up (NULL above the top), the
    ``levels`` within the block, the siblings ``upper`` above it and the ``top`` of the
    group."""

    blocks: DataFrame

    def tops(self) -> DataFrame:
        return self.blocks.where("block = 0").select("grp", "top")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """``grp, carry, digest, segments, top`` for every node. With ``above`` (``grp,
        above, root``) its segments follow, and ``root`` is added."""
        blocks, keep = self.blocks, ["grp", "top"]
        upper = F.col("upper")
        if above is not None:
            blocks, keep, upper = attach(blocks, above, "grp", "inner"), [*keep, "root"], F.concat("upper", "above")

        def node(item: Column) -> Column:
            at = _int(item["pos"] - F.col("block") * BLOCK)
            inner = F.array(*[_segment(F.col(f"level{k}"), _int(F.floor(at / ARITY**k))) for k in range(BLOCK_LEVELS)])
            return F.struct(
                item["carry"].alias("carry"), item["digest"].alias("digest"),
                F.concat(F.slice(inner, F.lit(1), F.col("levels")), upper).alias("segments"))

        return blocks.select(*keep, F.inline(F.transform("items", node)))


def climb(nodes: DataFrame, label: str) -> Tree:
    """The tree over ``grp, pos, digest, carry``; positions are 0 and up per group."""
    spark = nodes.sparkSession
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", "carry")))
    blocks = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"))
    blocks = written(spark, blocks, f"{label}-items")
    # A group's number of nodes: the last block's, and whole ones before it.
    sizes = blocks.groupBy("grp").agg(F.max(F.col("block") * BLOCK + F.size("items")).alias("n"))
    sizes = written(spark, sizes, f"{label}-sizes")
    blocks = attach(blocks, sizes, "grp", "inner")
    levels = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(BLOCK_LEVELS)), F.lit(0))
    blocks = blocks.withColumn("levels", levels).drop("n")
    digests = F.array_join(F.transform("items", lambda x: x["digest"]), "")
    blocks = blocks.withColumn("level0", digests.cast("binary"))
    for k in range(1, BLOCK_LEVELS + 1):
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("levels") >= k, _parents(F.col(f"level{k - 1}"))))
    last = F.coalesce(*[f"level{k}" for k in range(BLOCK_LEVELS, -1, -1)]).cast("string")
    blocks = written(spark, blocks.withColumn("block_root", last).drop(f"level{BLOCK_LEVELS}"), f"{label}-blocks")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        return Tree(blocks.select("*", F.array().cast(_SEGMENTS).alias("upper"), F.col("block_root").alias("top")))
    # Blocks are the nodes of the next tree.
    roots = blocks.select("grp", F.col("block").alias("pos"), F.col("block_root").alias("digest"), F.col("block").alias("carry"))
    upper = climb(roots, label).proofs()
    upper = upper.select("grp", F.col("carry").alias("block"), F.col("segments").alias("upper"), "top")
    return Tree(attach(blocks, written(spark, upper, f"{label}-upper"), ["grp", "block"], "inner"))


def _group(column: Column) -> Column:
    """A text for every group, in the order of the groups, NULL first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def verified_rows(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id: str = "doc_id", text: str = "text",  # noqa: A002
) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256`` of the table as it is, and
    ``folded_root, verified`` after rows whose id has a CRC divisible by 3 had the A-Z
    of their text lower-cased."""
    spark = docs.sparkSession
    columns = {f: F.col(f"`{f}`") for f in fields}
    key = F.col(f"`{id}`")
    changed = F.crc32(key.cast("string").cast("binary")) % 3 == 0
    lowered = columns | {text: F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _UPPER.lower())}
    # An unchanged leaf is NULL in ``forged``, which keeps the rows narrow.
    leaves = docs.select(
        key.alias("doc_id"), _group(F.col(f"`{group}`")).alias("grp"), leaf(list(columns.values())).alias("digest"),
        F.when(changed, leaf(list(lowered.values()))).alias("forged"))
    leaves = written(spark, leaves, "leaves")
    nodes = ranked(leaves, "grp", ["doc_id", "digest"], "ranked-leaves")
    tree = climb(nodes.select("grp", "pos", "digest", F.struct("doc_id", "forged").alias("carry")), "tree")

    tops = written(spark, tree.tops().withColumn("one", F.lit("")), "subroots")
    tops = ranked(tops, "one", ["grp"], "ranked-subroots")
    tops = climb(tops.select(F.col("one").alias("grp"), "pos", F.col("top").alias("digest"), F.col("grp").alias("carry")), "top")
    above = tops.proofs().select(F.col("carry").alias("grp"), F.col("segments").alias("above"), F.col("top").alias("root"))
    above = written(spark, above, "above")

    out = tree.proofs(above).withColumn("folded_root", fold(F.coalesce("carry.forged", "digest"), F.col("segments")))
    return out.select(
        "carry.doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root",
        proof_digest(F.col("segments")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
