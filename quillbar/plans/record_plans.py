"""Queries over record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbar.operators import records as P
from quillbar.plans.catalog import query
from quillbar.sources.fixtures import load

NTZ = "timestamp_ntz"


@query("record_detail", """SELECT o_orderkey, to_json(coalesce(n, 0)) AS n_lines, first_line FROM (SELECT o_orderkey FROM orders) o LEFT JOIN (
SELECT l_orderkey, count(*) AS n, arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS first_line FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def record_detail(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = P.detail(load(spark, d, "orders").select("o_orderkey"), {"lines": (lines, ["l_quantity"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])}, "o_orderkey")
    return found.select("o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("string").alias("n_lines"), F.get("lines", F.lit(0))["l_quantity"].alias("first_line"))


@query("mapped_sources", """WITH h AS (SELECT CASE event_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'part' ELSE 'customer' END AS kind, event_id AS source_id FROM events)
SELECT kind, source_id, r AS record_id FROM h JOIN (SELECT 'order' AS k, o_orderkey AS s, o_custkey AS r FROM orders UNION ALL SELECT 'part', p_partkey, p_partkey * 2 FROM part UNION ALL SELECT 'customer', c_custkey, c_custkey FROM customer) x ON kind = k AND source_id = s""")
def mapped_sources(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "order").when(F.col("event_id") % 3 == 1, "part").otherwise("customer")
    hits = load(spark, d, "events").select(kind.alias("kind"), F.col("event_id").alias("source_id"))
    sources = {
        "order": load(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("record_id")),
        "part": load(spark, d, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") * 2).alias("record_id")),
        "customer": load(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("record_id")),
    }
    return P.mapped_sources(hits, sources).select("kind", "source_id", "record_id")


@query("current_scenes", "SELECT o_custkey AS record_id, o_orderkey AS scene_id, o_orderdate > TIMESTAMP '1998-01-01' AS after_submission FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def current_scenes(spark, d):
    o = load(spark, d, "orders")
    scenes = o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").cast(NTZ).alias("created_at"), F.lit("1998-01-01").cast(NTZ).alias("submitted_at"))
    return P.current_scenes(scenes).select("record_id", "scene_id", "after_submission")


@query("tag_versions", "SELECT n AS name, coalesce(max(o_custkey), 0) + 1 AS version FROM (SELECT DISTINCT o_orderpriority AS n FROM orders UNION ALL SELECT 'new') w LEFT JOIN orders ON o_orderpriority = n GROUP BY 1")
def tag_versions(spark, d):
    tags = load(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("version"))
    wanted = tags.select("name").distinct().unionByName(spark.createDataFrame([("new",)], "name string"))
    return P.next_versions(tags, wanted)


@query("private_hits", """WITH s AS (SELECT o_orderkey AS call_id, o_custkey % 400 AS file_hash, o_custkey // 10 AS episode_id, o_orderkey % 2 = 0 AS confirmed, o_totalprice AS distance FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY distance, call_id) = 1),
e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY CASE WHEN confirmed THEN 'e' || episode_id ELSE 'c' || call_id END ORDER BY distance, call_id) = 1)
SELECT call_id, file_hash FROM e ORDER BY distance, call_id LIMIT 50""")
def private_hits(spark, d):
    o = load(spark, d, "orders")
    scored = o.select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 400).alias("file_hash"), F.floor(F.col("o_custkey") / 10).alias("episode_id"), (F.col("o_orderkey") % 2 == 0).alias("confirmed"), F.col("o_orderdate").cast(NTZ).alias("submitted_at"), F.col("o_totalprice").alias("distance"))
    evidence = scored.select("call_id", F.lit("1996-01-01").cast(NTZ).alias("recorded_at"))
    return P.private_hits(scored, evidence, 80).select("call_id", "file_hash")


@query("clipped_scopes", """WITH l AS (SELECT l_suppkey AS symbol, min(l_shipdate) AS a, CASE WHEN l_suppkey % 2 = 0 THEN max(l_shipdate) END AS b FROM lineitem GROUP BY 1),
s AS (SELECT DISTINCT l_suppkey AS symbol, TIMESTAMP '1995-01-01' + INTERVAL (k) YEAR AS "start", TIMESTAMP '1996-01-01' + INTERVAL (k) YEAR AS "end" FROM lineitem, range(9) t(k)),
c AS (SELECT symbol, greatest("start", a) AS "start", CASE WHEN b IS NULL THEN "end" ELSE least("end", b) END AS "end" FROM s JOIN l USING (symbol))
SELECT * FROM c WHERE "start" < "end" """)
def clipped_scopes(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast(NTZ).alias("at"))
    life = rows.groupBy("symbol").agg(F.min("at").alias("listed"), F.max("at").alias("_b")).withColumn("delisted", F.when(F.col("symbol") % 2 == 0, F.col("_b"))).drop("_b")
    year = F.make_ym_interval(F.col("k"), F.lit(0))
    scopes = life.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("symbol", (F.lit("1995-01-01").cast(NTZ) + year).alias("start"), (F.lit("1996-01-01").cast(NTZ) + year).alias("end"))
    return P.clipped_scopes(scopes, life)


@query("advanced_cursors", "SELECT event_type, greatest(CASE WHEN event_type <> 'view' THEN 1705000000 END, CAST(max(floor(epoch_us(ts) / 1e6)) AS BIGINT) - 48 * 3600) AS cursor FROM events GROUP BY 1")
def advanced_cursors(spark, d):
    from quillbar.functions.interval import seconds_of

    done = load(spark, d, "events").select("event_type", seconds_of(F.col("ts")).alias("end"))
    stored = done.select("event_type").distinct().where("event_type <> 'view'").withColumn("cursor", F.lit(1705000000).cast("long"))
    return P.advanced_cursors(stored, done, ["event_type"], F.lit(3600), 64, 16)


@query("event_log_page", "SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def event_log_page(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("sequence"))
    return P.keyset_events(e, 500, 100).select(F.col("sequence").alias("event_id"))


@query("exploratory_set", """WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 500)
SELECT o_custkey AS call_id, CAST(0 AS INTEGER) AS claim_no, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 1""")
def exploratory_set(spark, d):
    """The chosen set: the 500 customers with the most orders."""
    o = load(spark, d, "orders")
    chosen = o.groupBy(F.col("o_custkey").alias("call_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "call_id").limit(500)
    outcomes = o.select(F.col("o_custkey").alias("call_id"), F.lit(0).alias("claim_no"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("outcome_id"))
    return P.exploratory(chosen, outcomes)
