"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight and gets its share of all words as a target, at most
`MOST_EPOCHS` times its own words; what that cuts off is shared out again by
weight. A source gives whole epochs first. For the rest of its target its
documents are put in the order of exponential keys, -ln(u) / quality weight with
u a digest of the document's id, and taken from the smallest key on until the
words taken are as near the rest as whole documents allow.

No source has to fit a task. Keys are counted into key ranges, and words are
prefix-summed over ranges; documents of earlier ranges are all taken, those of
later ones not, and only the one range that holds the cut is sorted. Ranges are
even for weight 1; of documents with weight 1/2, the last one of n / `RANGE_ROWS`
ranges holds about the root of n * `RANGE_ROWS`.

Defined cases. Null text has no words. A null source is a source, the last in
order. Documents without words are taken as often as their source's epochs and
place in the order say, at no cost. Rows with the same doc_id share one key and
are taken or left together. A document without a quality label, or with another
value than 0 and 1, has weight 1; of several labels the highest counts. An empty
table gives an empty result. Other columns are not read, and :func:`mixed` hands
them on.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.session import stored

WORDS = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
SOURCE_WEIGHTS = (1, 2, 3)
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}
SEED = "mix"
#: Documents of a key range, about.
RANGE_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential with rate `weight`; the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / weight


def targets(totals: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source (source, source_size, n): its target.

    A source stands at its cap if its weight's share would exceed it once all
    sources with a lower cap for their weight stand at theirs.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), place + 1).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    lower = Window.orderBy(F.col("cap") / F.col("w"))
    up_to, own = lower.rangeBetween(Window.unboundedPreceding, 0), lower.rangeBetween(0, 0)
    rows = rows.withColumn("all", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    spent = F.sum("cap").over(up_to) - F.sum("cap").over(own)
    still = F.col("all_w") - F.sum("w").over(up_to) + F.sum("w").over(own)
    rows = rows.withColumn("capped", F.col("w") * (F.col("all") - spent) > F.col("cap") * still)
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    left_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    share = (F.col("w") * left).cast("double") / left_w.cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", "n", target.alias("target"))


def plan(
    docs: DataFrame, quality: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times (how often it is taken).

    quality: doc_id and quality, the labels.
    """
    known = quality.groupBy(F.col("doc_id").alias("_q")).agg(F.max("quality").alias("quality"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = sized.join(known, sized["doc_id"] == known["_q"], "left")
    weight = F.lit(1.0)
    for value, w in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == value, w).otherwise(weight)
    rows = stored(sized.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), weight, seed).alias("key")), "sized")

    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = stored(targets(totals), "targets")
    largest = aims.agg(F.max("n")).first()[0] or 1
    ranges = math.ceil(largest / RANGE_ROWS)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    # 1 - exp(-key) rises with the key and is uniform for weight 1
    in_range = F.least(F.floor(-F.expm1(-F.col("key")) * ranges), F.lit(ranges - 1)).cast("int")
    rows = rows.withColumn("range", in_range)
    words = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("range")
    upto = words.withColumn("upto", F.sum("words").over(so_far)).select(
        F.col("source").alias("_s"), F.col("range").alias("cut"), (F.col("upto") - F.col("words")).alias("before"), "upto"
    )
    cuts = aims.join(upto, aims["source"].eqNullSafe(upto["_s"]) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto")), "left")
    cuts = stored(cuts.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest", "cut", "before"), "cuts")

    placed = rows.join(cuts, rows["source"].eqNullSafe(cuts["_s"])).drop("_s")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    clear = placed.where("cut IS NULL OR range <> cut").withColumn(
        "times", F.col("epochs") + F.coalesce((F.col("range") < F.col("cut")) & (F.col("rest") > 0), F.lit(False)).cast("long")
    )
    in_order = Window.partitionBy("source").orderBy("key")
    end = F.col("before") + F.sum("size").over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    start = end - F.sum("size").over(in_order.rangeBetween(0, 0))
    at_cut = placed.where("range = cut").withColumn("times", F.col("epochs") + ((start + end <= 2 * F.col("rest")) & (F.col("rest") > 0)).cast("long"))
    return clear.select(*columns, "times").unionByName(at_cut.select(*columns, "times"))


def mixed(docs: DataFrame, quality: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    taken = plan(docs, quality, seed=seed).where("times > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "times").distinct()
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & docs["source"].eqNullSafe(taken["_source"])
    repeats = F.array_repeat(F.lit(1), taken["times"].cast("int"))
    one = f"one_{uuid.uuid4().hex}"
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns], F.explode(repeats).alias(one)).drop(one)
