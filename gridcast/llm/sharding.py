"""Sharding by extendible hashing, in DataFrame functions only.

A row's hash is a string of bits, and a shard is a prefix of it: at first there
is one shard, the empty prefix. A shard over its byte limit is split on the next
bit, and only such shards are. Counts of bytes by prefix, combined before they
are shuffled, decide the splits; the rows themselves are read once more, to get
their shard from the directory. So the input is read twice and must give the same
rows each time, as a stored table does.

The directory is indexed by a number of prefix bits at a time, a slot for each
prefix that occurs. A slot holds the depth of the shard that it lies in, or, if
even its own prefix is over the limit, passes its rows on to the next round,
which looks at further bits of these rows alone.

Rows with equal keys have equal hashes. Behind the `BITS` bits of the key come
`BITS` bits of the row's number, so a key that holds a third of all rows is split
like any other. Rows are numbered in a stored table, which only those are written
to whose key's bits did not suffice. A single row over the limit is a shard of
its own.

Defined cases. Null and empty texts have no bytes; a null key hashes as an empty
one. Repeated rows are shared out by row number. An empty table gives an empty
result. Every column of the input is kept, and the names of the columns added
must be free: a name in use, in whatever case, gets an underscore in front
(:func:`added` says which).

Shards are written whole, each into one file, and files hold their shards in
order, so there is no folder per shard to list; :func:`manifest` says where each
one is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import stored

BITS = 60
LIMIT = 1 << 20
#: Prefix bits that one round looks at, at most: the directory has so many slots for each shard that is split further.
ROUND_BITS = 16


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's digest as a number."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _free(name: str, taken: list[str]) -> str:
    used = {t.lower() for t in taken}  # names that differ in case only are one name to Spark
    while name in used:
        name = "_" + name
    return name


def added(columns: list[str]) -> list[str]:
    """The names of the columns that rows with these columns get: shard, depth, shard_bytes, shard_rows, if they are free."""
    return [_free(c, columns) for c in ("shard", "depth", "shard_bytes", "shard_rows")]


def _prefix(depth: Column | int) -> Column:
    """The first `depth` bits of h1 and h2 as two numbers; the second counts beyond `BITS`."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    first = F.expr("shiftright(h1, 60 - least(d, 60))")
    second = F.when(F.col("d") > BITS, F.expr("shiftright(h2, 120 - d)")).otherwise(0)
    return F.struct(first.alias("p1"), second.cast("long").alias("p2"))


def _sums(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes and rows of every prefix of low to high bits: d, p1, p2, bytes, rows."""
    finest = rows.withColumn("d", F.lit(high)).select(_prefix(high).alias("p"), "size", F.lit(high).alias("d"))
    finest = finest.groupBy("p").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # the slots hold few rows by now; coarser prefixes are sums of finer ones
    each = finest.select("p.p1", "p.p2", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    p1 = F.expr(f"shiftright(p1, least({high}, 60) - least(d, 60))")
    p2 = F.when(F.col("d") > BITS, F.expr(f"shiftright(p2, {high} - d)")).otherwise(0).cast("long")
    each = each.select("d", p1.alias("p1"), p2.alias("p2"), "bytes", "rows")
    return each.groupBy("d", "p1", "p2").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def assigned(rows: DataFrame, key: str, size: Column, limit: int = LIMIT, round_bits: int = ROUND_BITS) -> DataFrame:
    """The rows with shard (its bits as text), depth, shard_bytes and shard_rows.

    `size` gives a row's bytes; null counts as none.
    """
    columns = rows.columns
    kept = F.struct(*[F.col(c) for c in columns]).alias("row")
    plain = rows.select(kept, hash_bits(F.col(key)).alias("h1"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    left = plain.withColumn("h2", F.lit(0).cast("long"))
    counted = stored(plain.select("h1", "size"), "sizes").withColumn("h2", F.lit(0).cast("long"))
    total = counted.agg(F.sum("size")).first()[0] or 0
    step = min(round_bits, max(4, math.ceil(math.log2(max(total / limit, 1))) + 3))
    done, low = [], 0
    names = added(columns)
    while True:
        high = min(low + step, 2 * BITS if low >= BITS else BITS)
        sums = stored(_sums(counted, low, high), "sums")
        fits = (F.col("bytes") <= limit) | (F.col("rows") <= 1) | (F.col("d") == 2 * BITS)
        # a slot lies in the shard of its shortest prefix that fits
        slots = sums.where(F.col("d") == high).select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
        up1 = F.expr(f"shiftright(s1, least({high}, 60) - least(d, 60))")
        up2 = F.when(F.col("d") > BITS, F.expr(f"shiftright(s2, {high} - d)")).otherwise(0).cast("long")
        slots = slots.select("s1", "s2", "d", up1.alias("p1"), up2.alias("p2"))
        found = slots.join(sums.where(fits), ["d", "p1", "p2"])
        directory = found.groupBy("s1", "s2").agg(F.min(F.struct("d", "p1", "p2", "bytes", "rows")).alias("leaf"))
        directory = stored(directory, "directory")
        if high <= ROUND_BITS:  # so many slots at most: the rows need not move to meet them
            directory = F.broadcast(directory)
        slot = left.withColumn("d", F.lit(high)).withColumn("p", _prefix(high)).drop("d")
        joined = slot.join(directory, (F.col("p.p1") == directory["s1"]) & (F.col("p.p2") == directory["s2"]), "left")
        depth = F.col("leaf.d")
        bits = F.concat(
            F.when(depth > 0, F.expr("lpad(bin(leaf.p1), least(leaf.d, 60), '0')")).otherwise(""),
            F.when(depth > BITS, F.expr("lpad(bin(leaf.p2), leaf.d - 60, '0')")).otherwise(""),
        )
        placed = joined.where("leaf IS NOT NULL").select(
            *[F.col("row")[c].alias(c) for c in columns],
            bits.alias(names[0]),
            depth.cast("long").alias(names[1]),
            F.col("leaf.bytes").alias(names[2]),
            F.col("leaf.rows").alias(names[3]),
        )
        done.append(placed)
        over = sums.where((F.col("d") == high) & ~fits)
        if over.isEmpty():
            break
        rest = joined.where("leaf IS NULL")
        if high < BITS:
            left = stored(rest.select("row", "h1", "size"), "left").withColumn("h2", F.lit(0).cast("long"))
        elif low < BITS:  # no bits of the key are left: from here on the row's number counts
            numbered = rest.select("row", "h1", "size").withColumn("n", F.monotonically_increasing_id())
            left = stored(numbered, "left").withColumn("h2", hash_bits(F.col("n")))
        else:
            left = stored(rest.select("row", "h1", "h2", "size"), "left")
        counted = left
        low = high
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(rows: DataFrame, path: str, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """Write every shard into one file, by one task, as it fits the limit.

    Returned are the rows as the files have them, with the columns of :func:`assigned`.
    """
    made = assigned(rows, key, size, limit)
    name = added(rows.columns)[0]
    made.repartition(name).sortWithinPartitions(name).write.parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def manifest(shards: DataFrame, shard: str = "shard", size: str = "shard_bytes", rows: str = "shard_rows") -> DataFrame:
    """shard, file, bytes, rows of written shards, from those narrow columns alone."""
    at = shards.select(F.col(shard).alias("shard"), F.col("_metadata.file_path").alias("file"), F.col(size).alias("bytes"), F.col(rows).alias("rows"))
    return at.distinct()


def digest(shards: DataFrame, key: str, size: Column, shard: str = "shard") -> DataFrame:
    """One row per row of written shards: the key, shard, depth, shard_bytes, shard_rows, counted from the rows themselves."""
    found = shards.select(F.col(key), F.col(shard).alias("shard"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    found = stored(found, "found")
    sums = found.groupBy("shard").agg(F.sum("size").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return found.join(sums, "shard").select(key, "shard", F.length("shard").cast("long").alias("depth"), "shard_bytes", "shard_rows")
