"""URL filters from association rules, in DataFrame functions only.

A list of rules (host, path) judges the pages that it fits: host and all its
subdomains, paths that start with the rule's, the longest rule first. Pages that
no rule of the list fits are judged by mined rules. The listed pages are the
labelled ones: their URL tokens and their verdict are transactions, Spark's
FP-growth finds the token combinations that are frequent, and rules from tokens
to a verdict are kept by support and confidence, whatever their size. A rule is
dropped if one from fewer of its tokens is as confident. Kept rules form an
inverted index from token to rule; a rule matches a page that has all its
tokens, and the most confident match decides, then the better supported, then
blocking, then the rule's text. Pages without a match are allowed.

A URL has a token for each part of its host and each segment of its path (see
:func:`tokens`). Tokens that are found on exactly the same labelled pages are
mined as one and written out again in the rules, so a path that is always the
same does not multiply the combinations. Support alone bounds the mining: with a
share of `MIN_SUPPORT` there are at most (tokens of a page) / `MIN_SUPPORT`
frequent tokens, which the driver holds during mining. Equal sets of tokens are
matched once.

Defined cases. A null URL, or one without "://", has an empty host and path. An
empty list or table mines nothing, and unlisted pages are allowed. Repeated rows
are judged alike. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import stored

ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def listed(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as text and verdict; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last that fits is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(host: Column, path: Column, url: Column) -> Column:
    """What mining sees of a URL: parts of its host and every segment of its path, each named."""
    label = F.split(path, "/", -1)
    count = F.size(label) - 1

    def named(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + "="), value)

    parts = F.array(
        named("tld", F.substring_index(host, ".", -1)),
        named("site", F.substring_index(host, ".", -2)),
        named("host", host),
        named("depth", count.cast("string")),
        named("ending", F.regexp_extract(path, r"\.([^./]*)$", 1)),
        named("query", F.coalesce(F.contains(url, F.lit("?")), F.lit(False)).cast("string")),
        named("scheme", F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise("")),
    )
    segments = F.transform(F.slice(label, F.lit(2), count), lambda x, i: F.concat(F.lit("path"), (i + 1).cast("string"), F.lit("="), x))
    return F.concat(parts, segments)


def together(rows: DataFrame, least: int) -> DataFrame:
    """token, name of every token on `least` pages and more; tokens of exactly the same pages share the smallest one's name.

    `rows` has page and distinct tokens. Digests of the pages find such tokens,
    and counting the pages that have all of them verifies it.
    """
    each = rows.select("page", F.explode("tokens").alias("token"))
    marks = [F.count("*").alias("n"), F.min("page").alias("first"), F.bit_xor(F.xxhash64("page")).alias("x"), F.bit_xor(F.xxhash64("page", F.lit(1))).alias("y")]
    frequent = stored(each.groupBy("token").agg(*marks).where(F.col("n") >= least), "tokens")
    classes = frequent.groupBy("n", "first", "x", "y").agg(F.min("token").alias("name"), F.count("*").alias("size"))
    named = stored(frequent.join(classes, ["n", "first", "x", "y"]).select("token", "name", "n", "size"), "named")
    whole = each.join(named.where("size > 1"), "token").groupBy("page", "name", "n", "size").agg(F.count("*").alias("have")).where("have = size")
    proven = whole.groupBy("name", "n").agg(F.count("*").alias("pages")).where("pages = n").select("name", F.lit(True).alias("proven"))
    return named.join(proven, "name", "left").select("token", F.when(F.coalesce("proven", F.lit(False)), F.col("name")).otherwise(F.col("token")).alias("name"))


def broader_parts(antecedent: str) -> str:
    """SQL of all proper subsets of an array that is not empty, each in its order."""
    masks = f"filter(sequence(1L, shiftleft(1L, size({antecedent})) - 1), m -> m < shiftleft(1L, size({antecedent})) - 1)"
    return f"transform({masks}, m -> filter({antecedent}, (t, i) -> (shiftright(m, i) & 1) = 1))"


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows (tokens, verdict), pruned."""
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("page"), F.array_distinct("tokens").alias("tokens"), "verdict"), "labelled")
    count = rows.count()
    if not count:
        return labelled.sparkSession.createDataFrame([], schema)
    names = stored(together(rows, max(math.ceil(min_support * count), 1)), "names")
    items = rows.select("page", "verdict", F.explode("tokens").alias("token")).join(names, "token")
    items = items.groupBy("page", "verdict").agg(F.collect_set("name").alias("names"))
    verdict = F.array(F.concat(F.lit("verdict="), "verdict"))
    bare = rows.select("page", "verdict").join(items.select("page", "names"), "page", "left").select(F.concat(F.coalesce("names", F.array().cast("array<string>")), verdict).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(stored(bare, "items"))
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"), F.regexp_extract(F.element_at("consequent", 1), "^verdict=(.*)$", 1).alias("verdict"), "confidence", "support"
    )
    rules = rules.where(F.col("verdict").isin(ALLOW, BLOCK) & ~F.exists("antecedent", lambda t: t.startswith("verdict=")))
    rules = stored(rules, "rules")
    # a rule goes if one with fewer of its tokens has at least its confidence
    parts = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    each = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode(F.expr(broader_parts("antecedent"))).alias("part"))
    lost = each.join(parts, ["part", "verdict"]).where("of_part >= confidence").select("antecedent", "verdict").distinct()
    kept = rules.join(lost, ["antecedent", "verdict"], "left_anti")
    # every choice of one token for each name
    members = names.groupBy("name").agg(F.collect_set("token").alias("tokens"))
    spelt = members.agg(F.map_from_entries(F.collect_list(F.struct("name", "tokens"))).alias("m")).scalar()
    choices = F.aggregate(
        "antecedent",
        F.array(F.array().cast("array<string>")),
        lambda made, name: F.flatten(F.transform(made, lambda a: F.transform(F.col("spelt")[name], lambda t: F.concat(a, F.array(t))))),
    )
    written = kept.withColumn("spelt", spelt).select(F.explode(choices).alias("antecedent"), "verdict", "confidence", "support")
    return written.withColumn("antecedent", F.array_sort("antecedent"))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of distinct token sets that some rule matches, by an inverted index."""
    index = rules.select("*", F.explode("antecedent").alias("token"), F.size("antecedent").alias("need"))
    found = sets.select("tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(index, "token")
    found = found.groupBy("tokens", "antecedent", "verdict", "confidence", "support", "need").agg(F.count("*").alias("have")).where("have = need")
    best = F.struct("confidence", "support", (F.col("verdict") == BLOCK).alias("block"), F.array_join("antecedent", " ").alias("text"), "verdict")
    return found.groupBy("tokens").agg(F.max(best).alias("best")).select("tokens", "best.verdict")


def judged(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", **mining) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none of the list fits), verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("listed"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    known = mined(rows.where("listed IS NOT NULL").select("tokens", "listed.verdict"), **mining)
    sets = rows.where("listed IS NULL").select("tokens").distinct()
    found = stored(matched(sets, known), "matched").withColumnRenamed("verdict", "mined")
    by_list = rows.where("listed IS NOT NULL").select("page_id", "host", "path", "listed.rule", "listed.verdict")
    others = rows.where("listed IS NULL").join(found, "tokens", "left")
    others = others.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit(ALLOW)).alias("verdict"))
    return by_list.unionByName(others)
