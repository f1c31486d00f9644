"""SimHash against plain loops over all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridcast.llm import simhash
from gridcast.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """fps: {doc_id: fingerprint}; by breadth-first walks over all pairs."""
    ids = sorted(fps)
    points = np.array([fps[i] for i in ids], dtype=np.uint64)
    left, out = set(range(len(ids))), {}
    for start in range(len(ids)):
        if start not in left:
            continue
        walk = [start]
        left.discard(start)
        while walk:
            at = walk.pop()
            out[ids[at]] = ids[start]
            near = np.flatnonzero(np.bitwise_count(points ^ points[at]) <= radius)
            new = [int(x) for x in near if int(x) in left]
            left.difference_update(new)
            walk += new
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C", "a b c d", "É a\tb\x0bc d e", "x " * 300, "a b c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == plain_components(fps)


def near_points(n, seed=1):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    points = set()
    while len(points) < n:
        p = rng.choice(centres)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            p ^= 1 << bit
        points.add(p)
    return sorted(points)


@pytest.mark.parametrize("part_rows, rows", [(8192, 1), (40, 1), (40, 5_000_000), (7, 10**10)])
def test_crowded_shards_and_finer_masks(spark, part_rows, rows):
    points = near_points(400)
    signed = [p - 2**64 if p >> 63 else p for p in points]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    stars = {r.node: r.component for r in components(simhash.links(distinct, rows, part_rows=part_rows)).collect()}
    want = plain_components(dict(enumerate(points)))
    got = {}
    for i, p in enumerate(signed):
        got.setdefault(stars.get(p, p), []).append(i)
    classes = {}
    for i, c in sorted(want.items()):
        classes.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(classes.values())


@pytest.mark.parametrize("rows", [1, 10**7, 10**9, 10**12])
def test_masks_share_one_for_every_link(rows):
    masks = simhash.shard_masks(rows)
    rng = random.Random(3)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1040)]
    rows = components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1040)}


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (3, "A b c d e", "z", 3), (3, "a b C d e", "z", 3), (None, "q", "z", 3), (9, "long " * 50_000, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost_id string, fp long")
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str)
    assert {(r[0], r[2]) for r in got} == {(1, 1), (2, 1), (3, 3), (None, None), (9, 9)}
    assert len(got) == 6
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "9", "None"]
    assert simhash.simhash_components(docs.where(F.lit(False))).count() == 0


def test_no_python_list_of_pairs():
    points = np.array(near_points(300), dtype=np.uint64)
    forest = simhash.Forest(points, np.zeros(300, int))
    found = {(int(a), int(b)) for x, y in forest.near(points, np.zeros(300, int), 4) for a, b in zip(x, y)}
    want = {(i, j) for i, j in itertools.product(range(300), repeat=2) if int(points[i] ^ points[j]).bit_count() <= 4}
    assert found == want


A, B, C = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")


def near(text):
    """One word more at the end: other bits, but within the radius."""
    return next(t for t in (f"{text} {w}" for w in range(999)) if 0 < (plain_fingerprint(text) ^ plain_fingerprint(t)).bit_count() <= 4)


def test_one_row_stays_of_each_component(spark):
    near_a, near_b, near_c = near(A), near(B), near(C)
    rows = [
        (5, A), (5, B), (3, near_a), (7, near_b),  # 5 goes beside 3, and stays beside 7
        (8, C), (8, near_c), (8, C),  # one of three
        (None, near_a), (None, "some words of its own"), (None, "quite another text without a copy"), (None, "some words of its own"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {t: plain_fingerprint(t) for _, t in rows}
    groups = plain_components(dict(enumerate(fps.values())))
    of = {t: groups[i] for i, t in enumerate(fps)}
    want = {g: min((d for d, t in rows if of[t] == g and d is not None), default=None) for g in of.values()}
    got = simhash.keep_one(docs, repeats=False).collect()
    assert sorted((of[r.text], str(r.doc_id)) for r in got) == sorted((g, str(d)) for g, d in want.items())
    assert {(r.doc_id, r.text) for r in got} >= {(3, near_a), (5, B), (None, "some words of its own"), (None, "quite another text without a copy")}
    both = simhash.keep_one(docs).collect()
    assert {(r.doc_id, r.text) for r in both} == {(r.doc_id, r.text) for r in got} and len(both) > len(got)


def test_the_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(3, "A b c d e"), (3, "a b C d e"), (None, "a b c d e"), (None, "f g h i j k"), (None, "F g h i j k")], "doc_id long, text string")
    got = corpus_pipeline.simhash_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["3", "None"]
