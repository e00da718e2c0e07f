"""Operator 11: hard negatives by branch and bound over ball trees.

Rows are dealt to partitions by ranges of their label; each partition builds ball trees of at most a block's bytes. An inner
node holds the centre and radius of its rows, so the inner product of a query with any of them lies within
<q, centre> +- |q| radius. A search asks a tree for the k best rows whose score is in a window and whose label is, or is not,
the query's: nodes whose bounds lie outside the window, whose rows are all of the wrong label, or whose upper bound is strictly
beneath the current k-th score are pruned; what is equal to it stays, for ties. Leaves with the best bounds are read first.

Plan: the index (a row for each tree) and the anchors (packed by label in rows of a bounded size) are written once. The first search
joins trees and packs that have a label in common, for the positives of each anchor; the second joins trees and packs that differ in
some label, with a window for each distinct positive score of an anchor. Each pair of a tree and a pack is a group; k rows a query and
tree are merged by query.

Cases: rows without id, label or vector, or with a null or non-finite component, take no part; vectors of unequal length count
as zero where they have no component; a row never finds rows of its own id; repeated rows are separate candidates and one anchor;
rows of one id with different vectors or labels are anchors of their own; components and scores beyond 64 bits become the nearest 64-bit
number (scores that might pass 2^53 are summed as Python's integers, without bounds); an anchor without positives, or a positive whose window holds no
row, gives no rows, and so does an empty table; other columns are dropped first.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.llm.common import materialize, table
from quillbar.llm.vectors import matrix

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows and bytes of a tree, anchors and bytes of a pack, rows of a leaf.
ROWS, BLOCK_BYTES, ANCHORS, LEAF = 16_384, 16 << 20, 1024, 32
#: Leaves that a query reads by itself before leaves are read for all queries together.
FIRST_LEAVES = 3
#: Values of a hash by which labels are counted, so that rows of a label come to the same blocks.
BUCKETS = 4096
SCALE = 256
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Products of integers are exact in doubles below this.
EXACT = 2.0**53
#: Share of |q| (|centre| + radius) that rounding may add to a bound.
SLACK = 1e-9


def whole_numbers(column, scale: int = SCALE):
    """floor(scale * x) of each component, as the nearest 64-bit number."""
    edge = F.lit(2.0**63)
    return F.transform(column, lambda x: F.when(x * scale >= edge, F.lit(HIGHEST)).when(x * scale < -edge, F.lit(LOWEST)).otherwise(F.floor(x * scale).cast("long")))


def clean(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, vector (array<double>), label of the rows that take part."""
    found = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").cast("long").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


class Tree:
    """Rows in the order of their leaves, and nodes of a balanced binary tree: children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order, depth = np.arange(len(ids)), 0
        while (len(ids) >> depth) > LEAF:
            depth += 1
        nodes = (2 << depth) - 1
        self.first, self.last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.centre, self.radius = np.zeros((nodes, vectors.shape[1])), np.zeros(nodes)
        self.lowest, self.highest = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.leaves, self.last[0] = (1 << depth) - 1, len(ids)
        points = vectors.astype(np.float64)
        for node in range(nodes):
            lo, hi = self.first[node], self.last[node]
            own = order[lo:hi]
            x = points[own]
            self.centre[node] = x.mean(0)
            away = np.sqrt(((x - self.centre[node]) ** 2).sum(1))
            self.radius[node] = away.max()
            self.lowest[node], self.highest[node] = labels[own].min(), labels[own].max()
            if node < self.leaves:
                # Rows part at the median along the line between two far ends.
                one = x[away.argmax()]
                other = x[((x - one) ** 2).sum(1).argmax()]
                middle = (hi - lo) // 2
                order[lo:hi] = own[np.argpartition(x @ (other - one), middle)]
                self.first[2 * node + 1], self.last[2 * node + 1] = lo, lo + middle
                self.first[2 * node + 2], self.last[2 * node + 2] = lo + middle, hi
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.reach = np.sqrt((self.centre**2).sum(1)) + self.radius


class Search:
    """The k best rows for units of work: unit i asks by queries[of[i]] for scores in [low[i], high[i]]."""

    def __init__(self, tree: Tree, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.tree, self.queries, self.ids, self.labels, self.of, self.low, self.high, self.k, self.same = tree, queries.astype(np.float64), ids, labels, of, low, high, k, same
        self.length = np.sqrt((self.queries**2).sum(1))
        heaviest = float(np.abs(tree.vectors.astype(np.float64)).max(initial=0))
        self.exact = heaviest * float(np.abs(self.queries).sum(1).max(initial=0)) < EXACT
        self.whole = queries
        # Integers beyond 2^53 are no doubles: without bounds all rows are asked.
        self.score = np.full((len(of), k), -np.inf) if self.exact else np.full((len(of), k), None, object)
        self.id = np.zeros((len(of), k), np.int64)
        self.points = tree.vectors.astype(np.float64) if self.exact else None
        self.middle = self.queries @ tree.centre.T  # anchors of a pack x nodes of a tree

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def bounds(self, unit: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, most score, whether the node stays) of pairs of a unit and a node."""
        q, t = self.of[unit], self.tree
        middle = self.middle[q, node]
        around = self.length[q] * (t.radius[node] + SLACK * t.reach[node])
        least, most = middle - around, middle + around
        own = self.labels[q]
        able = (t.lowest[node] <= own) & (own <= t.highest[node]) if self.same else (t.lowest[node] != own) | (t.highest[node] != own)
        return least, most, able & (most >= self.low[unit]) & (least <= self.high[unit]) & (most >= self.kth()[unit])

    def read(self, unit: np.ndarray, leaf: np.ndarray) -> None:
        """Rows of one leaf for each unit; no unit comes twice."""
        t, together = self.tree, max(1, (32 << 20) // (8 * LEAF * 2 * max(1, self.queries.shape[1])))
        for at in range(0, len(unit), together):
            u, n = unit[at : at + together], leaf[at : at + together]
            size = t.last[n] - t.first[n]
            row = t.first[n][:, None] + np.arange(size.max())[None, :]
            there = np.arange(size.max())[None, :] < size[:, None]
            row = np.where(there, row, 0)
            q = self.of[u]
            score = np.einsum("ijk,ik->ij", self.points[row], self.queries[q])
            wanted = (t.labels[row] == self.labels[q][:, None]) == self.same
            ok = there & wanted & (t.ids[row] != self.ids[q][:, None]) & (score >= self.low[u][:, None]) & (score <= self.high[u][:, None])
            ok &= score >= self.kth()[u][:, None]
            new = ok.any(1)
            u, row, score, ok = u[new], row[new], score[new], ok[new]
            score, ids = np.concatenate([self.score[u], np.where(ok, score, -np.inf)], 1), np.concatenate([self.id[u], t.ids[row]], 1)
            best = np.lexsort((ids, -score), axis=1)[:, : self.k]
            self.score[u], self.id[u] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)

    def read_by(self, unit: np.ndarray, leaf: int) -> None:
        """Rows of one leaf for many units: units of one query share its scores."""
        t = self.tree
        rows = slice(t.first[leaf], t.last[leaf])
        query, of = np.unique(self.of[unit], return_inverse=True)
        score = self.queries[query] @ self.points[rows].T
        score[((t.labels[rows][None, :] == self.labels[query][:, None]) != self.same) | (t.ids[rows][None, :] == self.ids[query][:, None])] = -np.inf
        score = score[of]
        ok = (score >= np.maximum(self.low[unit], self.kth()[unit])[:, None]) & (score <= self.high[unit][:, None]) & (score > -np.inf)
        new = np.flatnonzero(ok.any(1))
        if len(new):
            u, score = unit[new], np.concatenate([self.score[unit[new]], np.where(ok[new], score[new], -np.inf)], 1)
            ids = np.concatenate([self.id[u], np.broadcast_to(t.ids[rows], (len(u), score.shape[1] - self.k))], 1)
            best = np.lexsort((ids, -score), axis=1)[:, : self.k]
            self.score[u], self.id[u] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)

    def reaching(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, leaf, most score) of what the bounds leave, level by level."""
        unit, node = np.arange(len(self.of)), np.zeros(len(self.of), np.int64)
        _, most, able = self.bounds(unit, node)
        unit, node, most = unit[able], node[able], most[able]
        while len(unit) and node[0] < self.tree.leaves:
            unit, node = np.repeat(unit, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
            _, most, able = self.bounds(unit, node)
            unit, node, most = unit[able], node[able], most[able]
        return unit, node, most

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, id, score) of what is found."""
        if not self.exact:
            return self.plain()
        unit, node, most = self.reaching()
        # The leaves with the best bounds first, so that the k-th score is known early.
        order = np.lexsort((-np.minimum(most, self.high[unit]), unit))
        first = np.flatnonzero(np.diff(unit[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        early = np.zeros(len(unit), bool)
        for place in range(FIRST_LEAVES):
            at = order[first[size > place] + place]
            at = at[most[at] >= self.kth()[unit[at]]]
            self.read(unit[at], node[at])
            early[at] = True
        # Then leaf by leaf, for the units whose bound still reaches their k-th score.
        rest = np.flatnonzero(~early & (most >= self.kth()[unit]))
        rest = rest[np.lexsort((-most[rest], node[rest]))]
        edges = np.flatnonzero(np.diff(node[rest], prepend=-1))
        for group in sorted(np.split(rest, edges[1:]) if len(rest) else [], key=lambda g: -most[g[0]]):
            asking = group[most[group] >= self.kth()[unit[group]]]
            if len(asking):
                self.read_by(np.sort(unit[asking]), node[group[0]])
        at, place = np.nonzero(self.score > -np.inf)
        return at, self.id[at, place], self.score[at, place].astype(np.int64)

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, out = self.tree, []
        points = [[int(x) for x in v] for v in t.vectors]
        for i, q in enumerate(self.of.tolist()):
            own = [int(x) for x in self.whole[q]]
            low, high = (max(LOWEST, min(HIGHEST, int(x))) if np.isfinite(x) else x for x in (self.low[i], self.high[i]))
            found = []
            for n in np.flatnonzero(((t.labels == self.labels[q]) == self.same) & (t.ids != self.ids[q])).tolist():
                score = max(LOWEST, min(HIGHEST, sum(a * b for a, b in zip(points[n], own, strict=True))))
                if low <= score <= high:
                    found.append((-score, int(t.ids[n])))
            out += [(i, x, -s) for s, x in sorted(found)[: self.k]]
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _packed(width: int, kind: str):
    """Rows (block, vec_id, label, name, vector) of one block -> (block, labels, names, body). A tree's body is the Tree, a pack's its anchors."""

    def run(rows: pa.Table) -> pa.Table:
        ids, labels, names = (rows.column(c).to_numpy() for c in ("vec_id", "label", "name"))
        vectors = matrix([x.as_py() for x in rows.column("vector")], np.int64)
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        if np.abs(vectors.astype(np.float64)).max(initial=0) < 2**15:
            vectors = vectors.astype(np.int16)
        body = Tree(ids, labels, vectors) if kind == "tree" else (ids, labels, names, vectors)
        names = np.zeros(0, np.int64) if kind == "tree" else names
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (np.unique(labels), names)]
        return pa.table([rows.column("block").slice(0, 1), *lists, pa.array([pickle.dumps(body)], pa.binary())], names=["block", "labels", "names", "body"])

    return run


def blocks_of(rows: DataFrame, most_rows: int, width: int, kind: str) -> tuple[DataFrame, int]:
    """(block, labels, names, body) and how many: about most_rows rows each, rows of one label in blocks that follow each other."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    counts = sorted((r["bucket"], r["n"]) for r in rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect())  # BUCKETS at most
    total = sum(n for _, n in counts)
    before = np.cumsum([n for _, n in counts]) - [n for _, n in counts]
    starts = rows.sparkSession.createDataFrame([(b, n, int(s)) for (b, n), s in zip(counts, before, strict=True)], "bucket int, held long, start long")
    blocks = max(1, -(-total // most_rows))
    # A number that is drawn once deals even many copies of one row evenly to the blocks of their label.
    drawn = F.pmod(F.xxhash64("vec_id", "name", F.monotonically_increasing_id()), F.col("held"))
    block = F.floor((F.col("start") + drawn) * blocks / F.lit(max(1, total))).cast("long")
    dealt = rows.withColumn("bucket", bucket).join(F.broadcast(starts), "bucket").select(block.alias("block"), "vec_id", "label", "name", "vector")
    kinds = "block long, labels array<long>, names array<long>, body binary"
    return materialize(dealt.groupBy("block").applyInArrow(_packed(width, kind), kinds), kind), blocks


def _searching(k: int, same: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "query": pa.int64(), "unit": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        out = []
        for tree in left.column("body").to_pylist() if len(right) else []:
            tree = pickle.loads(tree)
            for body, windows in zip(right.column("body").to_pylist(), right.column("windows").to_pylist(), strict=True):
                ids, labels, names, queries = pickle.loads(body)
                if windows is None:
                    of, asked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                    low, high = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
                else:
                    place = {n: i for i, n in enumerate(names.tolist())}
                    of = np.array([place[w["query"]] for w in windows], np.int64)
                    asked, low, high = (np.array([w[c] for w in windows], np.int64) for c in ("unit", "low", "high"))
                unit, found, score = Search(tree, queries, ids, labels, of, low, high, k, same).run()
                q = of[unit]
                out.append(pa.table([pa.array(x) for x in (ids[q], names[q], asked[unit], found, score)], names=list(kinds)))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in kinds.items()})

    return run


def searched(trees: DataFrame, packs: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, query, unit, vec_id, score, rank: the k best of each query and unit. pairs (tree, pack): what meets."""
    # Tree and pack as one key: each side is partitioned by one of them after its join, which would count as partitioned by both.
    cell = F.concat_ws(":", "tree", "pack").alias("cell")
    left = trees.select(F.col("block").alias("tree"), "body").join(pairs, "tree").select(cell, "body")
    right = packs.select(F.col("block").alias("pack"), "body", "windows").join(pairs, "pack").select(cell, "body", "windows")
    kinds = "query_id long, query long, unit long, vec_id long, score long"
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_searching(k, same), kinds)
    order = W.partitionBy("query_id", "query", "unit").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """rows: vec_id long, label long, vector array<long>. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(rows.withColumn("name", F.xxhash64("vec_id", "label", "vector")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("w")).first()
    width = max(1, size["w"])
    held, asking = (max(LEAF, min(x, BLOCK_BYTES // (8 * width))) for x in (ROWS, ANCHORS))
    (trees, _), (packs, many) = blocks_of(rows, held, width, "tree"), blocks_of(rows.where(is_anchor).dropDuplicates(["vec_id", "name"]), asking, width, "pack")

    # Numbers of blocks and their labels alone meet here; bodies join the pairs that are left.
    a, b = trees.select(F.col("block").alias("tree"), F.col("labels").alias("of_tree")), packs.select(F.col("block").alias("pack"), F.col("labels").alias("of_pack"))
    together = a.withColumn("label", F.explode("of_tree")).join(b.withColumn("label", F.explode("of_pack")), "label").select("tree", "pack").distinct()
    none = F.lit(None).cast("array<struct<query:long,unit:long,low:long,high:long>>")
    best = materialize(searched(trees, packs.select("block", "body", none.alias("windows")), together, positives, True), "positives")

    # What least * positive <= 100 * score <= most * positive leaves, in whole numbers.
    wide = F.col("score").cast("decimal(20,0)")
    window = best.select("query", F.col("score").alias("unit"), F.ceil(wide * least / 100).cast("long").alias("low"), F.floor(wide * most / 100).cast("long").alias("high")).where("low <= high").distinct()
    of_pack = packs.select("block", F.explode("names").alias("query")).join(window, "query").groupBy("block").agg(F.collect_list(F.struct("query", "unit", "low", "high")).alias("windows"))
    asked = materialize(packs.select("block", "body").join(of_pack, "block"), "windows")
    apart = a.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(b, "pack")
    apart = apart.where((F.size("of_tree") > 1) | (F.col("of_tree") != F.col("of_pack"))).select("tree", "pack")
    found = searched(trees, asked, apart, negatives, False).select("query", "unit", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = best.select(F.col("query_id").alias("anchor_id"), "query", F.col("score").alias("unit"), F.col("vec_id").alias("positive_id"))
    return found.join(pairs, ["query", "unit"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("unit").alias("positive_score"), "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    found = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = found.select("vec_id", label.alias("label"), whole_numbers("vector").alias("vector"))
    return mined(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11}
ORACLES = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.l = c.l AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
negatives AS (
  SELECT p.a AS anchor_id, p.c AS positive_id, n.c AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.c) AS place
  FROM positives p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM negatives WHERE place <= 3
"""
}
