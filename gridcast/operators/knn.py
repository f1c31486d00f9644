"""k-nearest-neighbour regression, exact, without comparing all rows with all rows.

Training rows are cut into tiles by a tree of binary splits at quantiles, one
feature after the other, until every tile is small; each node of the tree keeps
its bounding box and size. A query is first answered from its home, the deepest
node around it that holds k rows. Its k neighbours can be no farther than that
answer, so a second walk down the tree follows only nodes whose boxes come
nearer, and the tiles it ends at are searched as well. Both walks visit a number
of nodes that grows with the depth of the tree, not with the number of tiles. A
tile with many queries is searched by several tasks.

The tree has two levels. Its upper part, which the driver and all tasks hold, has
a bounded number of tiles. A task cuts the tile it searches by a tree of its own
and walks it in the same two steps, so beyond that number tiles may hold more
rows than one comparison should read. A tile that is too long for one task is
dealt into parts by key; each part offers its k nearest, and the nearest of all
parts count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from gridcast.session import frozen, stored

#: Levels of the tree that one reading of the rows cuts, and the accuracy of their quantiles.
LEVELS_AT_ONCE = 3
ACCURACY = 1000
#: Tiles that the driver and the tasks hold the tree of; some 100 bytes each. Beyond, tiles hold more rows.
TREE_TILES = 1 << 18
#: Training rows of a tile that one task searches, and rows in a leaf of the tree that the task makes of them.
PART_ROWS = 1 << 19
LEAF_ROWS = 512


class Tree:
    """Binary splits in arrays: left and right child (-1: a tile), feature, cut, parent."""

    def __init__(self):
        self.left, self.right, self.parent = [-1], [-1], [-1]
        self.feature, self.cut = [0], [0.0]

    def split(self, node: int, feature: int, cuts: Sequence[float]) -> None:
        """Cut a tile at ascending values: at the middle one, then both sides."""
        if not len(cuts):
            return
        middle = len(cuts) // 2
        first = len(self.left)
        self.left[node], self.right[node] = first, first + 1
        self.feature[node], self.cut[node] = feature, float(cuts[middle])
        for grown, value in ((self.left, -1), (self.right, -1), (self.parent, node), (self.feature, 0), (self.cut, 0.0)):
            grown += [value, value]
        self.split(first, feature, cuts[:middle])
        self.split(first + 1, feature, cuts[middle + 1 :])

    def frame(self) -> dict[str, np.ndarray]:
        kinds = {"left": "int32", "right": "int32", "parent": "int32", "feature": "int32", "cut": "float64"}
        return {name: np.array(getattr(self, name), dtype=kind) for name, kind in kinds.items()}


def _walk(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The tile of each point."""
    at = np.zeros(len(points), dtype="int32")
    moving = np.flatnonzero(tree["left"][at] >= 0)
    while len(moving):
        node = at[moving]
        low = points[moving, tree["feature"][node]] <= tree["cut"][node]
        at[moving] = np.where(low, tree["left"][node], tree["right"][node])
        moving = moving[tree["left"][at[moving]] >= 0]
    return at


def _tile_udf(tree: dict[str, np.ndarray]):
    @F.pandas_udf(IntegerType())
    def tile(*columns: pd.Series) -> pd.Series:
        return pd.Series(_walk(tree, np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return tile


def _tiled(train: DataFrame, features: Sequence[str], rows: int, tile_rows: int) -> tuple[DataFrame, Tree]:
    """Add `_tile`, with about `tile_rows` distinct points in each tile at most.

    Every round cuts the tiles that are still too large along the next feature;
    it ends when none is, or when a whole turn of the features finds no cut.
    """
    tree, waiting, turn, idle = Tree(), rows > tile_rows, 0, 0
    tile_rows = max(tile_rows, rows / TREE_TILES)
    parts = 1 << LEVELS_AT_ONCE
    while waiting and idle < len(features):
        f = turn % len(features)
        steps = [i / parts for i in range(1, parts)]
        placed = train.select(_tile_udf(tree.frame())(*features).alias("_g"), F.col(features[f]).alias("_x"))
        large = placed.groupBy("_g").agg(
            F.count("*").alias("n"), F.max("_x").alias("most"), F.percentile_approx("_x", steps, ACCURACY).alias("q")
        ).where(F.col("n") > tile_rows)
        found, cut = large.collect(), 0
        for r in found:
            wanted = min(parts, 1 << max(1, int(np.ceil(np.log2(r["n"] / tile_rows)))))
            cuts = sorted({r["q"][parts * j // wanted - 1] for j in range(1, wanted)} - {r["most"]})
            tree.split(r["_g"], f, cuts)
            cut += len(cuts)
        waiting, turn, idle = bool(found), turn + 1, 0 if cut else idle + 1
    return train.withColumn("_tile", _tile_udf(tree.frame())(*features)), tree


class Boxes:
    """The tree with bounding boxes and sizes of its nodes, and the walks of queries down it."""

    def __init__(self, tree: Tree, rows: Sequence, features: Sequence[str], k: int):
        self.features = list(features)
        self.tree = tree.frame()
        count, wide = len(self.tree["left"]), len(self.features)
        self.sizes = np.zeros(count, dtype="int64")
        self.low, self.high = np.full((count, wide), np.inf), np.full((count, wide), -np.inf)
        for r in rows:
            t = r["_tile"]
            self.sizes[t] = r["_n"]
            self.low[t] = [r[f"_lo{i}"] for i in range(wide)]
            self.high[t] = [r[f"_hi{i}"] for i in range(wide)]
        for node in range(count - 1, 0, -1):  # children come after their parent
            p = self.tree["parent"][node]
            self.sizes[p] += self.sizes[node]
            self.low[p] = np.minimum(self.low[p], self.low[node])
            self.high[p] = np.maximum(self.high[p], self.high[node])
        self.wanted = min(k, int(self.sizes[0]))

    def _home(self, points: np.ndarray) -> np.ndarray:
        """The deepest node around each point that holds enough rows."""
        node = _walk(self.tree, points)
        while (short := self.sizes[node] < self.wanted).any():
            node[short] = self.tree["parent"][node[short]]
        return node

    def _near(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0.0)
        total = np.zeros(len(points))
        for i in range(points.shape[1]):
            total += gap[:, i] * gap[:, i]
        return total

    def tiles(self, points: np.ndarray, limit: np.ndarray, home: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(point, tile) of tiles within the squared limits, in or out of the points' homes; and the nodes visited."""
        asked = np.arange(len(points))
        node = home.copy() if inside else np.zeros(len(points), dtype="int32")
        found, visited = [], 0
        while len(asked):
            visited += len(asked)
            keep = self.sizes[node] > 0
            if not inside:
                keep &= (node != home[asked]) & (self._near(points[asked], node) <= limit[asked] * (1 + 1e-9))
            asked, node = asked[keep], node[keep]
            end = self.tree["left"][node] < 0
            found.append((asked[end], node[end]))
            asked, node = asked[~end], node[~end]
            asked, node = np.tile(asked, 2), np.concatenate([self.tree["left"][node], self.tree["right"][node]])
        if not found:
            return asked, node, visited
        return np.concatenate([q for q, _ in found]), np.concatenate([t for _, t in found]), visited

    def _pairs(self, batches: Iterator[pd.DataFrame], inside: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                part = pdf.iloc[start : start + 4096]
                points = part[self.features].to_numpy(dtype=float)
                limit = np.full(len(part), np.inf)
                if not inside:
                    limit = part["_reach"].to_numpy(dtype=float)
                    limit[np.isnan(limit)] = np.inf
                q, t, _ = self.tiles(points, limit, self._home(points), inside)
                yield part[self.features].iloc[q].assign(_tile=t.astype("int32"))

    def home(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tiles of each point's home."""
        return self._pairs(batches, True)

    def others(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tiles beyond the home that come nearer than `_reach`, the k-th squared distance found at home."""
        return self._pairs(batches, False)


def _first_k(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query, ties to the smaller id."""
    order = np.lexsort([ids, d, q])
    sorted_q = q[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q) < k]


def _compared(asked: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, squared distance) of the k nearest rows by comparing all rows, in blocks of queries."""
    k_here = min(k, len(points))
    block = max(1, 2_000_000 // max(len(points), 1))
    out = []
    for start in range(0, len(asked), block):
        part = asked[start : start + block]
        distance = np.zeros((len(part), len(points)))
        for i in range(points.shape[1]):
            gap = part[:, i : i + 1] - points[:, i]
            distance += gap * gap
        kth = np.partition(distance, k_here - 1, axis=1)[:, k_here - 1 : k_here]
        q, t = np.nonzero(distance <= kth)
        d = distance[q, t]
        best = _first_k(q, d, ids[t], k)
        out.append((q[best] + start, t[best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


class Leaves:
    """One task's rows, cut by medians into leaves of a tree of their own."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, leaf_rows: int):
        self.points, self.ids, self.k = points, ids, k
        wide, tree = points.shape[1], Tree()
        self.rows: dict[int, np.ndarray] = {}
        waiting = [(0, np.arange(len(points)), 0, 0)]
        while waiting:
            node, rows, f, idle = waiting.pop()
            if len(rows) <= leaf_rows or idle == wide:
                self.rows[node] = rows
                continue
            x, after = points[rows, f], (f + 1) % wide
            cut = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            if cut == x.max():
                below = x[x < cut]
                if not len(below):
                    waiting.append((node, rows, after, idle + 1))
                    continue
                cut = below.max()
            tree.split(node, f, [cut])
            low = x <= cut
            waiting += [(tree.left[node], rows[low], after, 0), (tree.right[node], rows[~low], after, 0)]
        boxes = [
            {"_tile": node, "_n": len(rows)}
            | {f"_{n}{i}": g(points[rows, i]) for i in range(wide) for n, g in (("lo", np.min), ("hi", np.max))}
            for node, rows in self.rows.items()
        ]
        self.boxes = Boxes(tree, boxes, [str(i) for i in range(wide)], k)

    def _in_leaves(self, asked: np.ndarray, q: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(leaf) > 0, True])
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows, own = self.rows[int(leaf[start])], q[start:end]
            found, t, d = _compared(asked[own], self.points[rows], self.ids[rows], self.k)
            out.append((own[found], rows[t], d))
        return tuple(np.concatenate(c) for c in zip(*out))

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, squared distance) of the k nearest rows: at home first, then in leaves that come nearer."""
        home = self.boxes._home(asked)
        q, leaf, _ = self.boxes.tiles(asked, np.full(len(asked), np.inf), home, True)
        at_home = self._in_leaves(asked, q, leaf)
        best = _first_k(at_home[0], at_home[2], self.ids[at_home[1]], self.k)
        reach = np.zeros(len(asked))
        np.maximum.at(reach, at_home[0][best], at_home[2][best])
        q, leaf, _ = self.boxes.tiles(asked, reach, home, False)
        found = [np.concatenate(c) for c in zip(at_home, self._in_leaves(asked, q, leaf))]
        best = _first_k(found[0], found[2], self.ids[found[1]], self.k)
        return tuple(c[best] for c in found)


def _nearest(features: Sequence[str], label: str, key: str, k: int, leaf_rows: int):
    """The k nearest training rows of one tile, or part of one, for each query point of the group."""

    def search(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(train):
            return queries[list(features)].iloc[:0].assign(_d=0.0, _id=0, _y=0.0)
        asked = queries[list(features)].to_numpy(dtype=float)
        points = train[list(features)].to_numpy(dtype=float)
        ids, labels = train[key].to_numpy(), train[label].to_numpy()
        if len(train) > 2 * leaf_rows:
            q, t, d = Leaves(points, ids, k, leaf_rows).nearest(asked)
        else:
            q, t, d = _compared(asked, points, ids, k)
        return queries[list(features)].iloc[q].assign(_d=d, _id=ids[t], _y=labels[t])

    return search


def _search(
    pairs: DataFrame,
    tiled: DataFrame,
    sizes: dict[int, int],
    features: list[str],
    label: str,
    key: str,
    k: int,
    queries_per_task: int,
    part_rows: int,
) -> DataFrame:
    """The k nearest of each (query point, tile) pair, of every part of the tile: features, _d, _id, _y."""
    load = {r["_tile"]: r["n"] for r in pairs.groupBy("_tile").agg(F.count("*").alias("n")).collect()}
    cut = [(t, -(-n // queries_per_task), -(-sizes[t] // part_rows)) for t, n in load.items()]
    cut = [(t, shares, parts) for t, shares, parts in cut if shares > 1 or parts > 1]
    if cut:
        # a tile with many queries is shared out, its training rows go to every share;
        # a tile with many rows is dealt into parts, its queries go to every part
        counts = F.broadcast(pairs.sparkSession.createDataFrame(cut, "_tile int, _shares bigint, _parts bigint"))
        shares, parts = F.coalesce("_shares", F.lit(1)), F.coalesce("_parts", F.lit(1))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        pairs = pairs.join(counts, "_tile", "left").withColumn("_share", F.pmod(F.xxhash64(*features), shares))
        tiled = tiled.join(counts, "_tile", "left").withColumn("_share", every(shares))
        pairs, tiled = pairs.withColumn("_part", every(parts)), tiled.withColumn("_part", F.pmod(F.xxhash64(key), parts))
        pairs, tiled = pairs.drop("_shares", "_parts"), tiled.drop("_shares", "_parts")
    else:
        none = {"_share": F.lit(0), "_part": F.lit(0)}
        pairs, tiled = pairs.withColumns(none), tiled.withColumns(none)
    columns = ", ".join(f"`{f}` double" for f in features)
    task = ["_tile", "_share", "_part"]
    return (
        pairs.groupBy(*task)
        .cogroup(tiled.groupBy(*task))
        .applyInPandas(_nearest(features, label, key, k, LEAF_ROWS), f"{columns}, _d double, _id bigint, _y double")
    )


def knn_regress(
    train: DataFrame,
    queries: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    tile_rows: int = 4096,
    queries_per_task: int = 200_000,
    name: str = "prediction",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Mean label of the k training rows nearest to each query row.

    Features are doubles without missing values, scaled beforehand; `key` is an
    integer that is unique in `train`. Of equally near rows the smaller key
    wins. Rows with the same features are searched for once, and no point
    offers more than its k smallest keys.
    """
    features = list(features)
    same = Window.partitionBy(*features).orderBy(key)
    points = stored(
        train.select(*features, F.col(key).cast("bigint").alias(key), F.col(label).cast("double").alias(label))
        .withColumn("_r", F.row_number().over(same))
        .where(F.col("_r") <= k)
        .drop("_r"),
        "points",
    )
    cut, tree = _tiled(points, features, points.count(), tile_rows)
    tiled = stored(cut, "tiled")
    extent = [f(c).alias(f"_{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = tiled.groupBy("_tile").agg(F.count("*").alias("_n"), *extent).collect()
    if not boxes:
        return queries.withColumn(name, F.lit(None).cast("double"))
    tiles = Boxes(tree, boxes, features, k)

    asked = queries.select(*features).distinct()
    columns = ", ".join(f"`{f}` double" for f in features)
    sizes = {r["_tile"]: r["_n"] for r in boxes}

    def search(pairs: DataFrame) -> DataFrame:
        return _search(stored(pairs, "pairs"), tiled, sizes, features, label, key, k, queries_per_task, part_rows)

    at_home = stored(search(asked.mapInPandas(tiles.home, f"{columns}, _tile int")), "at_home")
    kth = F.element_at(F.sort_array(F.collect_list("_d")), k)
    reach = at_home.groupBy(*features).agg(F.when(F.count("*") >= k, kth).alias("_reach"))
    nearby = search(reach.mapInPandas(tiles.others, f"{columns}, _tile int"))
    found = at_home.unionByName(nearby)
    nearest = Window.partitionBy(*features).orderBy("_d", "_id")
    mean = (
        found.withColumn("_r", F.row_number().over(nearest))
        .where(F.col("_r") <= k)
        .groupBy(*features)
        .agg(F.avg("_y").alias(name))
    )
    return queries.join(mean, features, "left")
