"""Spelling variants: words one edit apart, by a frontier over a relational trie.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. All words form a trie, held as a table of edges (node, first
character, child), and a frontier of states (word, position, node, edits) is
joined with the edges level by level. A state without an edit follows its own
word; at a node it may also replace the word's next character by that of another
edge, or skip it. A state with an edit must match exactly. A state that has used
its edit and its whole word at a node where a word ends has found a near word.

Edges of which only one leads on are drawn together: an edge carries all
characters up to the next node at which words part or end, so the number of
levels is that of such nodes on a path, not the length of the words. The edges
of a level come from the states that stand there: of the words behind an edge,
the first and the last one in order agree exactly as far as all of them do.

Two more things keep the frontier as small as the words' own paths. Words are
walked forwards and backwards, and edits are made in the second half of each
walk only, where few words share a node; an edit in the first half is one in the
second half of the walk backwards. So all walks may begin at the node of the
first `least_chars // 2` characters. And each pair is sought from one side, from
the longer word or, by the replaced character, from the smaller one.

Scale. All steps are equi-joins and aggregations combined before the shuffle; a
crowded node is an ordinary skewed join key, which Spark splits. Each level is
written, so a lost executor costs one level at most.

Defined cases. Null and empty texts have no words. Repeated rows count again. A
null doc_id is an empty text in the digest. Words of any length are walked. An
empty table gives no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import stored

LEAST_CHARS = 7
LEAST_COUNT = 2
#: A word's form occurs so many times as often as the word.
TIMES = 10
#: One run of so many loses a character.
SPOILT = 31

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STATE = ["back", "word", "n", "pos", "node", "edits", "near_n"]


def word_counts(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, spoilt: int = SPOILT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word and n: runs of letters, A-Z lower-cased, of which the digest with the doc_id spoils one in `spoilt`."""
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(name.alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    lost = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % spoilt == 0, F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.length("run"))))
    words = rows.select(F.coalesce(word, F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


@F.pandas_udf(T.StringType())
def _common(lo: pd.Series, hi: pd.Series) -> pd.Series:
    return pd.Series([a if a == b else commonprefix((a, b)) for a, b in zip(lo, hi)], dtype=object)


def _char(word: str, at: str) -> Column:
    """The character after the first `at` ones."""
    return F.expr(f"substring({word}, {at} + 1, 1)")


def _edges(states: DataFrame) -> DataFrame:
    """back, at, char, child, ends and lengths of the edges that leave the nodes where states without an edit stand.

    `ends` is the count of the word that the child is, null if it is none;
    `lengths` marks the word lengths behind the edge, modulo 64.
    """
    rows = states.where("edits = 0").select("back", F.col("node").alias("at"), _char("word", "pos").alias("char"), "word", "n")
    made = rows.groupBy("back", "at", "char").agg(
        F.min(F.struct("word", "n")).alias("lo"),
        F.max("word").alias("hi"),
        F.bit_or(F.expr("shiftleft(1L, length(word) % 64)")).alias("lengths"),
    )
    made = made.select("back", "at", "char", "lo", "lengths", _common("lo.word", "hi").alias("child"))
    ends = F.when(F.col("child") == F.col("lo.word"), F.col("lo.n"))
    return made.select("back", "at", "char", "child", ends.alias("ends"), "lengths")


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states of the next level, and those that have come to an end at a near word."""
    half = "if(back, length(word) - floor(length(word) / 2), floor(length(word) / 2))"
    free = states.where("edits = 0")
    may_edit = free.where(f"pos >= {half}")

    # steps: from which position the edge's characters are to be the word's, and which length of word is sought
    own = free.select("*", _char("word", "pos").alias("char"), F.col("pos").alias("from"), F.lit(0).alias("used"))
    skip = may_edit.select("*", _char("word", "pos + 1").alias("char"), F.expr("pos + 1").alias("from"), F.lit(2).alias("used"))
    skip = skip.where((F.col("char") != _char("word", "pos")) & (F.col("char") != ""))
    match = states.where("edits > 0 AND pos < length(word)")
    match = match.select("*", _char("word", "pos").alias("char"), F.col("pos").alias("from"), F.col("edits").alias("used"))
    steps = own.unionByName(skip).unionByName(match).withColumnRenamed("node", "at").join(edges, ["back", "at", "char"])
    label = "substring(child, length(at) + 1)"
    steps = steps.where(f"used = 0 OR substring(word, from + 1, length(child) - length(at)) = {label}")
    steps = steps.withColumn("to", F.expr("from + length(child) - length(at)"))

    swap = may_edit.withColumnRenamed("node", "at").join(edges, ["back", "at"]).where(F.col("char") > _char("word", "pos"))
    swap = swap.where("substring(word, pos + 2, length(child) - length(at) - 1) = substring(child, length(at) + 2)")
    swap = swap.withColumns({"used": F.lit(1), "to": F.expr("pos + length(child) - length(at)")}).drop("char")

    both = steps.drop("char", "from").unionByName(swap)
    sought = "if(used = 2, length(word) - 1, length(word))"
    alive = f"used = 0 AND to < length(word) OR used > 0 AND (lengths & shiftleft(1L, {sought} % 64)) <> 0 AND (to < length(word) OR ends IS NOT NULL)"
    moved = both.where(alive).select("back", "word", "n", F.col("to").alias("pos"), F.col("child").alias("node"), F.col("used").alias("edits"), F.col("ends").alias("near_n"))

    # the last character skipped, where what is left is a word
    shorter = free.where("pos = length(word) - 1 AND near_n IS NOT NULL")
    shorter = shorter.withColumns({"pos": F.expr("pos + 1"), "edits": F.lit(2)})
    return moved.unionByName(shorter.select(*STATE))


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """word, near, near_n: every near word of every word, once.

    `words` has word and n, each word once, of `least_chars` code points at least.
    """
    start = least_chars // 2
    ways = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("w")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("w"))))
    states = words.select(ways.alias("way"), "n").select("way.back", F.col("way.w").alias("word"), "n").where(F.length("word") > start)
    states = states.select("back", "word", "n", F.lit(start).alias("pos"), F.substring("word", 1, start).alias("node"), F.lit(0).alias("edits"), F.lit(None).cast("long").alias("near_n"))
    states = stored(states, "frontier")
    found = []
    while not (going := states.where("pos < length(word)")).isEmpty():
        edges = stored(_edges(going), "edges")
        states = stored(_moved(going, edges), "frontier")
        found.append(states.where("edits > 0 AND pos = length(word)"))
    if not found:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = reduce(DataFrame.unionByName, found)
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(turned("word").alias("word"), turned("node").alias("near"), "n", "near_n")
    sides = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    both = pairs.select(F.explode(sides).alias("side")).select("side.*")
    return both.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, for words with a form; chains are halved in each round.

    A form occurs several times as often as its word, so chains are short and never close.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        found = moved.select("word", "root")


def spelling_variants(words: DataFrame, least_chars: int = LEAST_CHARS, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    near = near_words(words, least_chars).groupBy("word").agg(F.count("*").alias("n_near"), best)
    made = words.join(near, "word", "left")
    usual = -F.col("best.m") >= times * F.col("n")
    made = made.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.m")).alias("form_n"))
    made = stored(made, "forms")
    last = roots(made.where("form IS NOT NULL"))
    return made.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
