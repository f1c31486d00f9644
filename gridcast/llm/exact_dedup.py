"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks where its own content says so: after the first
`BOUNDARY` beyond `CHUNK_MIN` characters, at `CHUNK_MAX` at the latest. Each
chunk gets a short identifier, a 64-bit hash, which is verified: all distinct
chunk contents are compared byte by byte, and should two of them share one, a
wider identifier is verified and used instead. For this the chunk contents move
once, each distinct one once per task. From then on a document
is its recipe, the ordered list of chunk identifiers, and two documents are
equal exactly if their recipes are; only recipes are grouped and joined.

Defined cases. Null text counts as empty; an empty text has an empty recipe.
Rows with the same doc_id and equal texts are one document written twice: they
are counted in `group_size` and marked alike, and :func:`deduplicate` returns
one of them. A null doc_id never becomes `keep_id` while the group has another.
An empty table gives an empty result. Other columns, whatever their names, are
not read, and :func:`deduplicate` hands them on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.session import stored

SPACES = r"[\x20\x09-\x0D]+"
CHUNK_MIN = 64
CHUNK_MAX = 8192
#: A sentence end after some letters only, so that boundaries are rarer than `CHUNK_MIN` and fall back into step.
BOUNDARY = r"[b-hj-m][.!?] "


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text in pieces that end at a content-defined boundary; joined they are the text."""
    pattern = rf"(?s).{{{least},{most}}}?(?<={BOUNDARY})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hash64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def sha256(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


#: Identifiers of a chunk, the shortest first; the first one that verifies is used.
IDENTIFIERS = (hash64, sha256)


def clashes(texts: DataFrame, identifier: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Identifiers that different chunk contents of the corpus share.

    This is the one place where chunk contents move: they are made distinct in
    each task, then over all tasks, compared byte by byte. Only counts follow.
    """
    pieces = texts.select(F.explode(chunks(F.col(text))).alias("chunk"))
    distinct = pieces.select(identifier(F.col("chunk")).alias("chunk_id"), "chunk").distinct()
    return distinct.groupBy("chunk_id").agg(F.count("*").alias("contents")).where("contents > 1")


def recipes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
) -> DataFrame:
    """doc_id, recipe (array of chunk identifiers), text_sha256 of the normalised text.

    Each identifier is verified on all chunks of the corpus before it is used;
    if two contents share one, the next wider identifier is taken.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text"))
    for identifier in identifiers:
        if clashes(plain, identifier).isEmpty():
            recipe = F.transform(chunks(F.col("text")), identifier)
            return plain.select("doc_id", recipe.alias("recipe"), sha256(F.col("text")).alias("text_sha256"))
    raise ValueError("different chunks share every identifier")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    known = stored(recipes(docs, doc_id, text), "recipes")
    # unique documents need no partner: only groups of two and more are joined back
    groups = known.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1")
    paired = known.join(groups, "recipe", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return paired.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast(T.LongType()).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of a document written twice, one row.

    Only identifiers of documents are joined against the documents. Where no
    doc_id occurs twice, the identifier alone says which rows go.
    """
    groups = stored(exact_groups(docs, doc_id, text), "groups")
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        lost = groups.where("NOT kept").select("doc_id")
        return docs.join(lost, docs[doc_id].eqNullSafe(lost["doc_id"]), "left_anti")
    mark = f"digest_{uuid.uuid4().hex}"
    marked = docs.withColumn(mark, sha256(normalised(F.col(text))))
    kept = groups.where("kept").select("doc_id", "text_sha256").distinct()
    same = marked[doc_id].eqNullSafe(kept["doc_id"]) & (marked[mark] == kept["text_sha256"])
    return marked.join(kept, same, "left_semi").dropDuplicates([doc_id, mark]).drop(mark)
