"""Extendible hashing against a plain recursive split."""

import hashlib

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from gridcast.llm import queries, sharding


def plain(rows, limit):
    bits = {k: f"{int(hashlib.md5((k or '').encode()).hexdigest()[:15], 16):060b}" for k, _ in rows}

    def split(part, depth):
        size = sum(s or 0 for _, s in part)
        if size <= limit or len(part) == 1:
            return [(k, s, bits[k][:depth], depth, size, len(part)) for k, s in part]
        return [x for b in "01" if (some := [r for r in part if bits[r[0]][depth] == b]) for x in split(some, depth + 1)]

    return sorted(split(rows, 0), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, s, 0, "x") for k, s in rows], "key string, size long, shard int, row string")


@pytest.mark.parametrize("bits", [16, 3])
def test_equals_recursive_splits(spark, bits):
    rows = [(f"k{i}", i % 50) for i in range(1500)] + [("big", 10_000), ("none", None), (None, 5), ("", 0)]
    got = sharding.assigned(frame(spark, rows), "key", F.col("size"), 400, bits)
    assert got.columns == ["key", "size", "shard", "row", "_shard", "depth", "shard_bytes", "shard_rows"]
    assert sorted(((r.key, r["size"], r._shard, r.depth, r.shard_bytes, r.shard_rows) for r in got.collect()), key=str) == plain(rows, 400)


def test_a_hot_key_is_split_by_row(spark):
    rows = [("hot", 10)] * 700 + [(f"k{i}", 10) for i in range(700)]
    got = sharding.assigned(frame(spark, rows), "key", F.col("size"), 200).cache()
    sums = got.groupBy("_shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.first("shard_bytes").alias("said"), F.first("shard_rows").alias("rows")).collect()
    assert got.count() == 1400 and all(r.b <= 200 and r.b == r.said and r.n == r.rows for r in sums)
    names = [r._shard for r in sums]
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_empty_table_and_one_shard(spark):
    assert sharding.assigned(frame(spark, []), "key", F.col("size"), 10).count() == 0
    assert {r._shard for r in sharding.assigned(frame(spark, [("a", 3), ("b", 4)]), "key", F.col("size"), 10).collect()} == {""}


def test_written_shards(spark, tmp_path):
    rows = [(f"k{i}", 10) for i in range(100)]
    df = frame(spark, rows).drop("shard")
    back = sharding.write_shards(df, str(tmp_path / "out"), "key", F.col("size"), 100)
    assert back.count() == 100
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]  # no folder per shard
    listed = sharding.manifest(back).collect()
    assert len(listed) == len({r.shard for r in listed}) >= 10  # each shard in one file
    assert sum(r.rows for r in listed) == 100 and sum(r.bytes for r in listed) == 1000


@pytest.mark.parametrize("name", ["shard", "Shard", "SHARD_ROWS", "depth"])
def test_clashing_names_through_the_query(spark, tmp_path, name):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.withColumn(name, F.lit("own")).write.parquet(str(tmp_path / "documents.parquet"))
    plain = queries.op9_sharding(spark, "/root/testdata/sf0.01")
    got = queries.op9_sharding(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def texts(spark):
    rows = [(f"k{i}", "é" * (i % 9), i) for i in range(600)] + [("hot", "abcde", i) for i in range(300)] + [(None, None, -1), ("big", "x" * 900, -2)]
    return spark.createDataFrame(rows, "doc_id string, text string, other long")


@pytest.mark.parametrize("limit", [100, 10**6])
def test_written_shards_hold_every_row_whole(spark, tmp_path, limit):
    docs, size = texts(spark), F.octet_length("text")
    back = sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", size, limit)
    assert back.columns == [*docs.columns, "shard", "depth", "shard_bytes", "shard_rows"]
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    got = sharding.digest(back, "doc_id", size).collect()
    assert sorted(map(str, got)) == sorted(map(str, back.select("doc_id", "shard", "depth", "shard_bytes", "shard_rows").collect()))
    assert all((r.shard_bytes <= limit or r.shard_rows == 1) and r.depth == len(r.shard) for r in got)
    assert ({r.shard for r in got} == {""}) == (limit > 100)


def test_query_writes_whole_documents(spark, monkeypatch):
    seen, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda *a, **b: seen.append((a[1], write(*a, **b))) or seen[-1][1])
    sf = "/root/testdata/sf0.01"
    got, docs = queries.op9_sharding(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    (path, back), = seen
    files = spark.read.parquet(path)
    assert set(docs.columns) < set(files.columns) and back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    assert sizes.where(f"b > {sharding.LIMIT} AND n > 1").isEmpty() and sizes.count() > 1
    assert difference(got, duck(sf), queries.ORACLE["op9_sharding"]) is None
