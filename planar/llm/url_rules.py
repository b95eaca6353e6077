"""URL filter: a list of host and path rules, and association rules mined by FP-growth.

Listed rules decide first. For other urls, association rules decide: Spark's
FP-growth finds the token combinations that go with a label in a labelled url
table; those of host and path tokens with enough support and confidence are kept, unless a shorter one
is as sure. Rules are found through an inverted index, by their rarest token.

A url has at most seven tokens (end of host, last two host names, first and third last
host name, first folder, file ending, query keys), so at most ``7 / min_support`` tokens are frequent,
whatever the size of the table; the rules over them fit a broadcast for that reason.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, no
tokens, and gets the default verdict. Repeated rows are judged alike; further
columns stay as they are. Without labels there are no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "label="


@dataclass(frozen=True)
class ListedRule:
    """For a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The list of the contract.
LISTED = (
    ListedRule(ALLOW, "com", "/"),
    ListedRule(BLOCK, "example.com", "/en/"),
    ListedRule(ALLOW, "www.example.com", "/en/"),
    ListedRule(BLOCK, "net", "/es/"),
    ListedRule(BLOCK, "net", "/fr/"),
)


def host(url: str | Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    url = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _first_fit(rules: Sequence[ListedRule], host: Column, path: Column, field: str) -> Column:
    """``field`` of the longest rule that fits, or NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        own = (host == F.lit(rule.host)) | host.endswith(f".{rule.host}")
        out = F.when(own & path.startswith(rule.path), F.lit(getattr(rule, field))).otherwise(out)
    return out


def tokens(url: str | Column) -> Column:
    """The distinct tokens of a url, sorted."""
    url = F.col(url) if isinstance(url, str) else url
    names = F.split(host(url), r"\.")
    folders = F.filter(F.split(path(url), "/"), lambda p: p != F.lit(""))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1)

    def token(kind: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{kind}="), value))

    found = F.array(
        token("end", F.element_at(names, -1)),
        F.when(F.size(names) > 1, token("site", F.array_join(F.slice(names, -2, 2), "."))),
        F.when(F.size(names) > 2, token("sub", F.get(names, F.lit(0)))),
        F.when(F.size(names) > 3, token("third", F.get(names, F.size(names) - 3))),
        token("folder", F.lower(F.get(folders, F.lit(0)))),
        token("file", F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), folders), -1), r"\.([A-Za-z0-9]{1,8})$", 1)),
        token("keys", F.array_join(F.array_sort(F.array_distinct(keys)), "+")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """``tokens, verdict, confidence, support`` of the rules for ``url, verdict``."""
    baskets = labelled.where(F.col("verdict").isNotNull()).select(
        F.concat(tokens("url"), F.array(F.concat(F.lit(_LABEL), F.col("verdict")))).alias("items")
    )
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    about = F.get("consequent", F.lit(0))
    rules = rules.where(about.startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(about, len(_LABEL) + 1, 1 << 20).alias("verdict"),
        "confidence", "support",
    )
    # One token is too blunt; a rule joins something of the host and of the path.
    kind = lambda prefixes: F.exists("tokens", lambda t: F.substring_index(t, "=", 1).isin(prefixes))
    rules = rules.where(kind(["end", "site", "sub", "third"]) & kind(["folder", "file", "keys"]))
    # A rule says nothing new if leaving out one of its tokens gives one as sure.
    shorter = rules.select(
        F.col("tokens").alias("short"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    parts = F.filter(F.transform("tokens", lambda t: F.array_remove("tokens", t)), lambda p: F.size(p) > 0)
    longer = rules.select("tokens", "verdict", "confidence", F.explode(parts).alias("short"))
    needless = longer.join(shorter, "short").where((F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence")))
    return rules.join(needless.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``signature`` (a set of frequent tokens) and the ``mined`` verdict of its
    best rule: the surest, then the best supported, then the longest, then allow.

    ``urls`` has one row per distinct signature. Every rule is listed under its
    rarest token only, so a url meets few rules that do not fit.
    """
    listed = rules.withColumn("rule", F.monotonically_increasing_id())
    places = listed.select("rule", F.explode("tokens").alias("token"))
    often = places.groupBy("token").agg(F.count("*").alias("n"))
    rarest = places.join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = listed.join(rarest, "rule").drop("rule")
    met = urls.select("signature", F.explode("signature").alias("token")).join(index, "token")
    fits = met.where(F.size(F.array_except("tokens", "signature")) == 0)
    rank = F.struct("confidence", "support", F.size("tokens"), (F.col("verdict") == ALLOW).alias("allow"))
    return fits.groupBy("signature").agg(F.max_by("verdict", rank).alias("mined"))


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, listed: Sequence[ListedRule] = LISTED, default: str = ALLOW,
    url: str = "url", min_support: float = 0.005, min_confidence: float = 0.9,
) -> DataFrame:
    """``page`` (the whole row), ``host``, ``path``, ``rule`` and ``verdict``.

    ``labelled`` has ``url, verdict``. By default the urls that a listed rule
    judges are the labelled table, which carries the list over to other urls.
    """
    rows = pages.select(F.struct("*").alias("page"), F.col(f"`{url}`").alias("u"))
    rows = rows.select("page", "u", host("u").alias("host"), path("u").alias("path"))
    rows = rows.withColumns({
        "rule": _first_fit(listed, F.col("host"), F.col("path"), "name"),
        "by_rule": _first_fit(listed, F.col("host"), F.col("path"), "verdict"),
    })
    if labelled is None:
        labelled = rows.where(F.col("by_rule").isNotNull()).select(F.col("u").alias("url"), F.col("by_rule").alias("verdict"))
    rules = written(pages.sparkSession, mine(labelled, min_support, min_confidence), "url-rules")
    frequent = rules.agg(F.array_sort(F.flatten(F.collect_set("tokens"))).alias("t")).select(F.array_distinct("t"))
    vocabulary = frequent.scalar()
    signed = rows.withColumn("signature", F.array_intersect(tokens("u"), vocabulary))
    best = written(pages.sparkSession, matches(signed.select("signature").distinct(), rules), "url-verdicts")
    out = attach(signed, best, "signature")
    return out.select("page", "host", "path", "rule", F.coalesce("by_rule", "mined", F.lit(default)).alias("verdict"))
