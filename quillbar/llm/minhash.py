"""Operator 12: near-duplicate documents by MinHash with tensored banding, links verified.

A document's set holds the hashes of its distinct shingles of `width` words. A set has two collections of
COLLECTIONS sketches; a sketch joins JOINED minima. Each pair of a sketch of the first collection and one of the second is
the key of a table, so COLLECTIONS ** 2 tables of 2 * JOINED minima a key are made of 2 * COLLECTIONS * JOINED minima, not
of COLLECTIONS ** 2 * 2 * JOINED. Two sets meet in a table if they share a sketch of each collection: for a similarity of s that
fails with at most 2 * (1 - s ** JOINED) ** COLLECTIONS, 2.1e-5 at 0.8 and 1.1e-6 at 0.85.

Sets that meet others in fewer than LEAST tables are dropped: a linked pair that meets at all shares so many with all
but 3e-6. Of those that remain whole sets are read, and the links verified on them as in jaccard.set_components: copies are
one set, a group of sets that meet is a star, and members it leaves open are compared where exact bounds do not rule them out. No
pair that meets in a table is given up, whatever the size of its group.

Cases: a text without words, or null, has an empty set, links with nothing and is its own component; fewer words
than `width` are one shingle; a row without key links like others but gives no component its name (it has the
smallest key it reaches, null if there is none, and is kept only then); repeated rows are linked like copies, and all rows of the key
that names a component are kept; an empty table gives no rows; other columns are dropped first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import table
from quillbar.llm.jaccard import SIGNATURES_IN_BLOCK, set_components
from quillbar.llm.words import mix

WIDTH, PERCENT = 2, 80
#: Sketches of each of the two collections, minima of a sketch, tables in which a set must meet others.
COLLECTIONS, JOINED, LEAST = 16, 3, 4
#: Sets of fewer features are similar only if they are equal.
SMALLEST = 4
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MINIMA = 2 * COLLECTIONS * JOINED
#: Odd multipliers: each orders the 64-bit hashes of features in another way.
_ORDERS = mix(np.arange(1, _MINIMA + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
_TABLES = mix(np.arange(COLLECTIONS**2, dtype=np.uint64) + _STEP).reshape(COLLECTIONS, COLLECTIONS)
#: Features that are ordered together.
_TOGETHER = 8192


def minima(features: np.ndarray) -> np.ndarray:
    """The least feature by each order."""
    least = np.full(_MINIMA, np.iinfo(np.uint64).max)
    for lo in range(0, len(features), _TOGETHER):
        some = features[lo : lo + _TOGETHER]
        np.minimum(least, np.array([(some * order).min() for order in _ORDERS]), out=least)
    return least


def table_keys(features: np.ndarray) -> np.ndarray:
    """A key for each pair of sketches, one of each collection."""
    found = minima(features).reshape(2, COLLECTIONS, JOINED)
    total = np.zeros((2, COLLECTIONS), np.uint64)
    for i in range(JOINED):
        total = mix(total * _STEP + found[:, :, i])
    return mix(mix(total[0][:, None] + _TABLES) + total[1][None, :]).ravel()


def _sign(features: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
    return ([(0, table_keys(features))] if len(features) >= SMALLEST else []), [LEAST, LEAST]


def _block_ranges(source: DataFrame) -> dict[int, tuple[int, int]]:
    sets = source.agg(F.count("text").alias("n")).first()["n"]
    return {0: (0, max(1, -(-sets * COLLECTIONS**2 // SIGNATURES_IN_BLOCK)))}


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key of the component), kept, of every row."""
    found = set_components(docs, key, text, WIDTH, PERCENT, _sign, _block_ranges)
    return found.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_minhash_dedup": op12}
ORACLES = {
    "op12_minhash_dedup": """
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS f
  FROM lowered),
named AS (SELECT md5(array_to_string(list_sort(f), chr(10))) AS s, any_value(f) AS f, min(doc_id) AS d FROM sets WHERE len(f) > 0 GROUP BY 1),
features AS (SELECT d, len(f) AS n, unnest(f) AS x FROM named),
often AS (SELECT x, count(*) AS times FROM features GROUP BY x HAVING count(*) > 1),
ordered AS (
  SELECT d, n, x, times, row_number() OVER (PARTITION BY d ORDER BY times, x) + n - count(*) OVER (PARTITION BY d) AS place
  FROM features JOIN often USING (x)),
first AS (SELECT * FROM ordered WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (
  SELECT DISTINCT a.d AS a, b.d AS b FROM first a JOIN first b ON a.x = b.x AND a.d < b.d
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN named x ON p.a = x.d JOIN named y ON p.b = y.d
  WHERE 100 * len(list_intersect(x.f, y.f)) >= 80 * (len(x.f) + len(y.f) - len(list_intersect(x.f, y.f)))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (
  SELECT d, d FROM named
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
least_of AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
of_set AS (SELECT md5(array_to_string(list_sort(f), chr(10))) AS s, root FROM named JOIN least_of ON node = d)
SELECT doc_id, CAST(len(f) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN of_set ON len(f) > 0 AND md5(array_to_string(list_sort(f), chr(10))) = of_set.s
"""
}
