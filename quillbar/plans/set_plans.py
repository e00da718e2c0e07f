"""Queries over filters, joins, aggregates, windows, selections and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions import decimals, text
from quillbar.operators import relational as R
from quillbar.operators import retrieval, shapes
from quillbar.plans.bar_plans import B1
from quillbar.plans.catalog import alias, query
from quillbar.sources.fixtures import bars, calls, fills, load

NTZ = "timestamp_ntz"


@query("optional_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def optional_filter(spark, d):
    o = R.optional(load(spark, d, "orders"), o_orderpriority="1-URGENT", o_orderstatus=None)
    return o.where(R.between(F.col("o_orderdate"), F.lit("1996-01-01").cast(NTZ), F.lit("1997-01-01").cast(NTZ))).select("o_orderkey")


@query("literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('The 1')) OR contains(lower(text), 'an_') OR contains(lower(text), '50%')")
def literal_search(spark, d):
    hit = text.contains_literal(F.col("text"), F.lit("The 1")) | text.contains_literal(F.col("text"), F.lit("an_")) | text.contains_literal(F.col("text"), F.lit("50%"))
    return load(spark, d, "documents").where(hit).select("doc_id")


@query("charset_prefilter", "SELECT p_partkey, contains(lower(p_name), '1a') AS found, contains(lower(p_name), '1') AND contains(lower(p_name), 'a') AS maybe FROM part")
def charset_prefilter(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", text.contains_literal(F.col("p_name"), F.lit("1A")).alias("found"), text.may_contain(F.col("p_name"), F.lit("1A")).alias("maybe"))


@query("tag_or_alias", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' OR l_linestatus = 'A'")
def tag_or_alias(spark, d):
    tags = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("name"), F.array("l_linestatus").alias("aliases"))
    records = load(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"))
    return retrieval.tagged(records, tags, "A").select(F.col("record_id").alias("o_orderkey"))


@query("keyset_page", "SELECT call_id, submitted_at FROM (SELECT o_orderkey AS call_id, o_orderdate AS submitted_at FROM orders) WHERE (submitted_at, call_id) < (TIMESTAMP '1998-06-01', 5000) ORDER BY submitted_at DESC, call_id DESC LIMIT 101")
def keyset_page(spark, d):
    after = F.struct("submitted_at", "call_id") < F.struct(F.lit("1998-06-01").cast(NTZ).alias("submitted_at"), F.lit(5000).cast("long").alias("call_id"))
    return calls(spark, d).select("call_id", "submitted_at").where(after).orderBy(F.desc("submitted_at"), F.desc("call_id")).limit(101)


CATALOG = """SELECT p_partkey, 'P' || p_partkey AS symbol, 'B' || (p_partkey % 97) AS base, p_size % 3 > 0 AS active, CASE WHEN p_size % 5 > 0 THEN CAST(p_partkey % 50 AS BIGINT) END AS popularity FROM part"""


def _instruments(spark, d):
    p = load(spark, d, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.concat(F.lit("B"), F.col("p_partkey") % 97).alias("base"), (F.col("p_size") % 3 > 0).alias("active"), F.when(F.col("p_size") % 5 > 0, F.col("p_partkey") % 50).alias("popularity"))


@query("catalog_search", f"""WITH i AS ({CATALOG}), s AS (SELECT *, CASE WHEN symbol = 'P12' THEN 0 WHEN base = 'P12' THEN 1 WHEN starts_with(symbol, 'P12') THEN 2 WHEN contains(symbol, 'P12') THEN 3 END AS search_rank FROM i)
SELECT symbol, base, search_rank, CASE WHEN active THEN 0 ELSE 1 END AS inactive, popularity FROM s WHERE search_rank IS NOT NULL""")
def catalog_search(spark, d):
    return retrieval.catalogue(_instruments(spark, d), "p 1-2").select("symbol", "base", "search_rank", "inactive", "popularity")


@query("exclude_before_topk", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (1, 2, 3, 5, 8) ORDER BY vec_id LIMIT 50")
def exclude_before_topk(spark, d):
    return load(spark, d, "embeddings").where(~F.col("vec_id").isin(1, 2, 3, 5, 8)).select("vec_id", "label").orderBy("vec_id").limit(50)


@query("overlap_guard", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-20' AND ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-10')")
def overlap_guard(spark, d):
    hit = R.overlap(F.col("ts"), F.col("ts") + F.expr("interval 6 hours"), F.lit("2024-01-10").cast(NTZ), F.lit("2024-01-20").cast(NTZ))
    return load(spark, d, "events").where(~hit).select("event_id")


@query("symbol_validity", r"SELECT p_partkey, regexp_full_match(upper(replace(p_name, ' ', '_')), '[A-Z0-9_]{1,40}') AS valid FROM part")
def symbol_validity(spark, d):
    return load(spark, d, "part").select("p_partkey", text.valid_symbol(F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("valid"))


@query("json_fields", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("json_rows", "SELECT o_custkey, o_orderkey, len(o_orderpriority) AS n FROM orders")
def json_rows(spark, d):
    o = load(spark, d, "orders")
    body = o.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("body"))
    rows = body.select("o_custkey", F.inline(F.from_json("body", "array<struct<o_orderkey:bigint,o_orderpriority:string>>")))
    return rows.select("o_custkey", "o_orderkey", F.length("o_orderpriority").cast("long").alias("n"))


alias("json_rows_all", "json_rows")


@query("text_preview", "SELECT doc_id, left(text, 500) AS preview FROM documents")
def text_preview(spark, d):
    return load(spark, d, "documents").select("doc_id", retrieval.preview(F.col("text")).alias("preview"))


@query("inner_join", "SELECT l_orderkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def inner_join(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return load(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("left_outer", "SELECT o_orderkey, count(l_orderkey) AS n, max(l_linenumber) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def left_outer(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"))
    return load(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("semi_filters", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_filters(spark, d):
    hit = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey").join(hit, "o_orderkey", "left_semi")


@query("anti_filters", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_filters(spark, d):
    hit = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey").join(hit, "o_orderkey", "left_anti")


@query("latest_link", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_link(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast(NTZ).alias("o_orderdate"))
    return R.first_by(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("ordinality", "SELECT doc_id, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS ordinal, unnest(string_split(text, ' ')) AS word FROM documents")
def ordinality(spark, d):
    words = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ordinal", "word"))
    return words.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "word")


@query("unpivot_metrics", "SELECT l_suppkey, key, round(sum(value), 4) AS total FROM (UNPIVOT (SELECT l_suppkey, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME key VALUE value) GROUP BY 1, 2")
def unpivot_metrics(spark, d):
    long = R.unpivot(load(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_tax"), ["l_suppkey"], ["l_discount", "l_tax"])
    return long.groupBy("l_suppkey", "key").agg(F.round(F.sum("value"), 4).alias("total"))


@query("either_join", "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_suppkey")
def either_join(spark, d):
    c, s = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), load(spark, d, "supplier").select("s_suppkey")
    return R.either(c, s, ("c_custkey", "s_suppkey"), ("c_nationkey", "s_suppkey"), ["c_custkey", "s_suppkey"]).select("c_custkey", "s_suppkey")


@query("interval_join", """WITH s AS (SELECT event_type AS k, event_id AS span_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events)
SELECT e.event_id, s.span_id FROM events e JOIN s ON e.event_type = s.k AND e.ts >= s.a AND e.ts <= s.b""")
def interval_join(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("k"), "event_id", F.col("ts").alias("at"))
    spans = e.select("k", F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + F.expr("interval 2 hours")).alias("end"))
    return R.interval_join(e, spans, ["k"], "at").select("event_id", "span_id")


alias("interval_join_all", "interval_join")


@query("overlap_join", """SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END, TIMESTAMP '9999-12-31') > TIMESTAMP '1997-06-01'""")
def overlap_join(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast(NTZ).alias("opened_at"), F.when(F.col("o_orderstatus") != "O", (F.col("o_orderdate") + F.expr("interval 30 days")).cast(NTZ)).alias("closed_at"))
    from quillbar.operators.ledger import cycle_list

    return cycle_list(o, F.lit("1997-06-01").cast(NTZ), F.lit("1998-01-01").cast(NTZ)).select("o_orderkey")


@query("asof_price", """SELECT c.event_id, t.value AS price FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type <> 'click') t ON c.user_id = t.user_id AND c.ts >= t.ts""")
def asof_price(spark, d):
    e = load(spark, d, "events")
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type <> 'click'").select("user_id", "ts", F.col("value").alias("price"))
    return R.asof(left, right, ["user_id"], "ts", ["price"]).select("event_id", "price")


@query("recursive_chain", """WITH RECURSIVE p AS (SELECT DISTINCT p_partkey AS node, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0),
a AS (SELECT node, parent AS ancestor, 1 AS level FROM p UNION ALL SELECT a.node, p.parent, a.level + 1 FROM a JOIN p ON a.ancestor = p.node) SELECT * FROM a""")
def recursive_chain(spark, d):
    parent = F.floor(F.col("p_partkey") / 3)
    p = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(parent > 0, parent).alias("parent"))
    return R.ancestry(p, "node", "parent")


@query("small_array_join", "SELECT event_id, step FROM events JOIN (VALUES ('click', 60), ('view', 3600)) v(t, step) ON event_type = t")
def small_array_join(spark, d):
    steps = spark.createDataFrame([("click", 60), ("view", 3600)], "event_type string, step int")
    return load(spark, d, "events").join(F.broadcast(steps), "event_type").select("event_id", "step")


@query("filtered_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS customers, count(DISTINCT coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey END, -o_orderkey)) AS groups FROM orders GROUP BY 1")
def filtered_counts(spark, d):
    o = load(spark, d, "orders")
    group = F.coalesce(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), -F.col("o_orderkey"))
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(group).alias("groups"))


@query("exact_median", "SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def exact_median(spark, d):
    return R.exact_median(load(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("state_zero_fill", "SELECT s AS state, count(o_orderkey) AS n FROM (VALUES ('realized'), ('unrealized'), ('pending'), ('insufficient_data'), ('not_triggered'), ('no_criteria')) v(s) LEFT JOIN orders ON s = CASE o_orderstatus WHEN 'F' THEN 'realized' WHEN 'P' THEN 'unrealized' ELSE 'pending' END GROUP BY 1")
def state_zero_fill(spark, d):
    from quillbar.operators.rules import STATES

    return R.counts_of(calls(spark, d), "state", STATES)


@query("equal_weight_rate", """WITH e AS (SELECT o_orderpriority AS signature, o_custkey, count(*) FILTER (o_orderstatus = 'F') AS w, count(*) FILTER (o_orderstatus <> 'O') AS v FROM orders GROUP BY 1, 2)
SELECT signature, round(avg(CASE WHEN v > 0 THEN w / v END), 9) AS rate, count(*) FILTER (v > 0) AS n_entities, count(*) FILTER (v = 0) AS n_missing FROM e GROUP BY 1""")
def equal_weight_rate(spark, d):
    c = calls(spark, d)
    found = R.equal_weight_rate(c, "signature", "episode_id", F.col("state") == "realized", F.col("state") != "pending")
    return found.withColumn("rate", F.round("rate", 9))


@query("ordered_collection", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def ordered_collection(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(R.ordered_list(F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("orders"))


@query("state_map", "SELECT o_orderpriority, to_json(map_from_entries(list({'k': s, 'v': n} ORDER BY s))) AS counts FROM (SELECT o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def state_map(spark, d):
    found = R.count_map(load(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")
    return found.select("o_orderpriority", F.to_json("counts").alias("counts"))


@query("having_buckets", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def having_buckets(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 600")


@query("day_distribution", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1, 2")
def day_distribution(spark, d):
    from quillbar.operators.statistics import trigger_days

    return trigger_days(load(spark, d, "events").withColumn("signature", F.col("event_type")), "ts").select(F.col("signature").alias("event_type"), "day", "n")


@query("coverage_all", f'{B1} SELECT symbol, coalesce(bool_and(volume >= 1), false) AS covered, bool_or(volume > 8) AS busy FROM b GROUP BY 1')
def coverage_all(spark, d):
    return bars(spark, d).groupBy("symbol").agg(F.coalesce(F.every(F.col("volume") >= 1), F.lit(False)).alias("covered"), F.bool_or(F.col("volume") > 8).alias("busy"))


@query("quantile_bounds", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.98), 6) AS hi, round(quantile_cont(l_extendedprice, 0.02), 6) AS lo FROM lineitem GROUP BY 1")
def quantile_bounds(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.percentile("l_extendedprice", 0.98), 6).alias("hi"), F.round(F.percentile("l_extendedprice", 0.02), 6).alias("lo"))


@query("rarity", "SELECT a.l_suppkey, a.p AS percent, round(count(*) FILTER (l.l_extendedprice < a.p * 1000) / count(*), 9) AS rarity FROM (SELECT DISTINCT l_suppkey, unnest(range(10)) * 5.0 AS p FROM lineitem) a JOIN lineitem l ON l.l_suppkey = a.l_suppkey GROUP BY 1, 2")
def rarity(spark, d):
    rows = load(spark, d, "lineitem")
    asked = rows.select("l_suppkey").distinct().withColumn("percent", F.explode(F.array(*[F.lit(i * 5.0) for i in range(10)]))).withColumn("score", F.col("percent") * 1000)
    found = R.empirical_rank(rows, asked, ["l_suppkey"], "l_extendedprice", "score")
    return found.select("l_suppkey", F.col("percent").cast("decimal(13,1)").alias("percent"), F.round("rarity", 9).alias("rarity"))


@query("best_z_score", "SELECT l_suppkey, round(CASE WHEN stddev_pop(l_extendedprice) <= 1e-9 THEN 0 ELSE (max(l_extendedprice) - avg(l_extendedprice)) / stddev_pop(l_extendedprice) END, 6) AS z FROM lineitem GROUP BY 1")
def best_z_score(spark, d):
    sd = F.stddev_pop("l_extendedprice")
    z = F.when(sd <= 1e-9, 0.0).otherwise((F.max("l_extendedprice") - F.avg("l_extendedprice")) / sd)
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(z, 6).alias("z"))


@query("hash_chain", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
h AS (SELECT o_custkey, n, sha256('|' || o_orderkey) AS chain FROM o WHERE n = 1 UNION ALL SELECT o.o_custkey, o.n, sha256(h.chain || '|' || o.o_orderkey) FROM h JOIN o ON o.o_custkey = h.o_custkey AND o.n = h.n + 1)
SELECT o_custkey, arg_max(chain, n) AS chain FROM h GROUP BY 1""")
def hash_chain(spark, d):
    values = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return load(spark, d, "orders").groupBy("o_custkey").agg(text.hash_chain(values).alias("chain"))


@query("recent_ten", "SELECT o_custkey, o_orderkey, row_number() OVER w AS recent, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY recent <= 10")
def recent_ten(spark, d):
    late = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(late).cast("long").alias("recent"), F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("n"))
    return o.where("recent <= 10")


@query("running_bounds", "SELECT event_id, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(CASE WHEN value > 400 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS islands FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def running_bounds(spark, d):
    w = W.partitionBy("user_id").orderBy("ts")
    high = F.when(F.col("value") > 400, 1).otherwise(0)
    return load(spark, d, "events").select("event_id", F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.sum(high).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("islands"))


@query("union_all", "SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'event', event_id FROM events")
def union_all(spark, d):
    parts = [load(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, t, c in (("order", "orders", "o_orderkey"), ("part", "part", "p_partkey"), ("event", "events", "event_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_distinct", "SELECT l_orderkey AS id FROM lineitem UNION SELECT o_orderkey FROM orders")
def union_distinct(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).unionByName(load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).distinct()


@query("array_sets", "SELECT o_custkey, list_contains(list(o_orderpriority), '1-URGENT') AS urgent, list_has_any(list(o_orderstatus), ['F', 'P']) AS closed FROM orders GROUP BY 1")
def array_sets(spark, d):
    g = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_list("o_orderstatus").alias("s"))
    return g.select("o_custkey", F.array_contains("p", "1-URGENT").alias("urgent"), F.arrays_overlap("s", F.array(F.lit("F"), F.lit("P"))).alias("closed"))


@query("retained_difference", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 4)")
def retained_difference(spark, d):
    e = load(spark, d, "embeddings")
    return R.retained_difference(e, e.where("label < 4"), "vec_id").select("vec_id")


RANKED = "SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS score, (vec_id * 37) % 1000 AS \"start\", (vec_id * 37) % 1000 + 64 AS \"end\" FROM embeddings"


def _ranked(spark, d):
    e = load(spark, d, "embeddings")
    start = (F.col("vec_id") * 37) % 1000
    return e.select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("score"), start.alias("start"), (start + 64).alias("end"))


@query("diversity_top3", f"WITH r AS ({RANKED}) SELECT id, label, score FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) <= 3")
def diversity_top3(spark, d):
    return R.diversity_cap(_ranked(spark, d), ["label"], [F.desc("score"), "id"], 3).select("id", "label", "score")


def greedy_sql(conflict: str) -> str:
    """SQL of a greedy selection: rows in order, each kept unless it conflicts with a kept one."""
    return f"""WITH RECURSIVE {greedy_rows(conflict)}
SELECT label, unnest(ids) AS id FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1"""


def greedy_rows(conflict: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS n FROM ({RANKED})),
g AS (SELECT label, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, CAST([] AS BIGINT[]) AS ids FROM r GROUP BY label
UNION ALL SELECT g.label, r.n, CASE WHEN len(list_filter(g.kept, lambda k: {conflict})) > 0 THEN g.kept ELSE list_append(g.kept, {{'s': r."start", 'e': r."end"}}) END,
CASE WHEN len(list_filter(g.kept, lambda k: {conflict})) > 0 THEN g.ids ELSE list_append(g.ids, r.id) END FROM g JOIN r ON r.label = g.label AND r.n = g.n + 1)"""


@query("nms_half_width", greedy_sql("abs(k.s - r.\"start\") < 32"))
def nms_half_width(spark, d):
    return R.nms_half_width(_ranked(spark, d), ["label"]).select("label", "id")


@query("nms_overlap", greedy_sql("least(k.e, r.\"end\") - greatest(k.s, r.\"start\") > 32"))
def nms_overlap(spark, d):
    return R.nms_overlap(_ranked(spark, d), ["label"]).select("label", "id")


@query("runner_ups", f"""WITH RECURSIVE {greedy_rows('k.s < r."end" AND k.e > r."start"')},
k AS (SELECT label, unnest(ids[1:3]) AS id FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1)
SELECT r.id, r.label, r.score, r."start", r."end" FROM k JOIN r ON r.label = k.label AND r.id = k.id""")
def runner_ups(spark, d):
    return R.runner_ups(_ranked(spark, d), ["label"])


@query("fetch_groups", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "start", "end") AS n FROM ({RANKED})),
g AS (SELECT label, n, "start" AS s, "end" AS e, 1 AS part FROM r WHERE n = 1
UNION ALL SELECT r.label, r.n, CASE WHEN greatest(g.e, r."end") - g.s <= 200 THEN g.s ELSE r."start" END, CASE WHEN greatest(g.e, r."end") - g.s <= 200 THEN greatest(g.e, r."end") ELSE r."end" END,
CASE WHEN greatest(g.e, r."end") - g.s <= 200 THEN g.part ELSE g.part + 1 END FROM g JOIN r ON r.label = g.label AND r.n = g.n + 1)
SELECT label, s AS "start", max(e) AS "end", count(*) AS n_ranges FROM g GROUP BY label, part, s""")
def fetch_groups(spark, d):
    return R.fetch_groups(_ranked(spark, d), ["label"], 200)


@query("one_per_contract", f"WITH r AS ({RANKED}) SELECT id, label, score FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1")
def one_per_contract(spark, d):
    return R.first_by(_ranked(spark, d), ["label"], [F.desc("score"), "id"]).select("id", "label", "score")


@query("fair_queue", """WITH w AS (SELECT event_id AS id, event_type AS queue, user_id % 5 AS last_turn, ts AS created FROM events WHERE event_id % 2 = 0),
r AS (SELECT event_type AS queue, count(*) AS busy FROM events WHERE event_id < 3 GROUP BY 1)
SELECT id, w.queue FROM w LEFT JOIN r ON w.queue = r.queue QUALIFY row_number() OVER (PARTITION BY w.queue ORDER BY last_turn, created, id) <= 4 - coalesce(max(r.busy) OVER (PARTITION BY w.queue), 0)""")
def fair_queue(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("queue"), (F.col("user_id") % 5).alias("last_turn"), F.lit(0).alias("run_after"), F.col("ts").alias("created"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return R.fair_queue(e.where("id % 2 = 0"), e.where("id < 3"), dict.fromkeys(kinds, 4)).select("id", "queue")


@query("borda_rank", """WITH t AS (SELECT l_partkey AS symbol, round(sum(l_extendedprice), 2) AS turnover, count(*) AS trades FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY turnover DESC, symbol) AS rank_first, row_number() OVER (ORDER BY trades DESC, symbol) AS rank_second FROM t)
SELECT symbol, trades, rank_first, rank_second, rank_first + rank_second AS score, row_number() OVER (ORDER BY rank_first + rank_second, symbol) AS place FROM r""")
def borda_rank(spark, d):
    t = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.round(F.sum("l_extendedprice"), 2).alias("turnover"), F.count(F.lit(1)).alias("trades"))
    ranked = R.borda(t, "turnover", "trades", "symbol")
    return ranked.select("symbol", "trades", *[F.col(c).cast("long").alias(c) for c in ("rank_first", "rank_second", "score", "place")])


@query("knn_cosine", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e), 9) AS distance FROM embeddings, q WHERE vec_id NOT IN (0, 7) ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e), vec_id LIMIT 20""")
def knn_cosine(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    first = e.where("id = 0").first()  # one query vector
    return shapes.nearest(e, first["embedding"] if first else [], 20, (0, 7), 200).select("id", F.round("distance", 9).alias("distance"))


@query("lexical_top60", "SELECT doc_id AS chunk_id FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id DESC LIMIT 60")
def lexical_top60(spark, d):
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("occurred_at"), "text")
    return retrieval.lexical(chunks, "The").select("chunk_id")


@query("rrf_fusion", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents QUALIFY r < 60), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS r FROM documents WHERE contains(lower(text), 'the') QUALIFY r < 60),
s AS (SELECT doc_id, sum(1.0::DOUBLE / (61 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1),
k AS (SELECT doc_id AS chunk_id, doc_id // 3 AS document_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY score DESC, doc_id) = 1)
SELECT chunk_id, document_id, round(score, 9) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 20""")
def rrf_fusion(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 3).alias("document_id"), "n_chars", "text", F.col("doc_id").alias("occurred_at"))
    dense = retrieval.ranked(docs.orderBy(F.desc("n_chars"), "chunk_id").limit(60), [F.desc("n_chars"), "chunk_id"])
    words = retrieval.ranked(retrieval.lexical(docs, "the"), [F.desc("occurred_at"), "chunk_id"])
    return retrieval.fused([dense, words], "chunk_id", "document_id", 20).select("chunk_id", "document_id", F.round("score", 9).alias("score"))


@query("index_status", "SELECT count(*) FILTER (o_orderkey % 4 = 0 OR o_orderkey % 5 = 0) AS pending, min(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 THEN o_orderdate END) AS oldest, count(*) FILTER (NOT (o_orderkey % 4 = 0 OR o_orderkey % 5 = 0)) AS indexed FROM orders")
def index_status(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(2).alias("version"), F.col("o_orderdate").cast(NTZ).alias("occurred_at"))
    indexed = o.where("document_id % 4 <> 0").select("document_id", F.when(F.col("document_id") % 5 == 0, 1).otherwise(2).alias("version"))
    return retrieval.index_status(o, indexed)


@query("index_repair", "SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def index_repair(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(2).alias("version"))
    indexed = o.where("document_id % 4 <> 0").select("document_id", F.when(F.col("document_id") % 5 == 0, 1).otherwise(2).alias("version"))
    return retrieval.to_repair(o, indexed, o.where("document_id % 7 <> 0").select("document_id"))


@query("latest_tags", "SELECT o_orderpriority AS name, o_custkey AS version, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey DESC) = 1")
def latest_tags(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("version"), F.col("o_orderkey").alias("created_at"))
    return retrieval.latest_tags(o).select("name", "version", F.col("created_at").alias("o_orderkey"))


@query("utf8_chunks")
def utf8_chunks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(text.utf8_chunks("text")).alias("c")).select("doc_id", "c.*")


@query("decimal_text", "SELECT l_orderkey, l_linenumber, rtrim(rtrim(CAST(CAST(l_extendedprice AS DECIMAL(18, 4)) AS VARCHAR), '0'), '.') AS plain FROM lineitem")
def decimal_text(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,4)").cast("string")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decimals.trimmed(price).alias("plain"))


alias("decimal_text_all", "decimal_text")


@query("line_fit", """SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)), 3) AS residual FROM lineitem GROUP BY 1""")
def line_fit(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    unexplained = F.regr_syy(y, x) * (1 - F.regr_r2(y, x)) / F.count(F.lit(1))  # root mean square of what the line leaves
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.sqrt(unexplained), 3).alias("residual"))


@query("fills_exit_vwap", """WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 'BUY' ELSE 'SELL' END AS side, CAST(CAST(floor(l_extendedprice / l_quantity * 10000) AS DECIMAL(14, 0)) * 0.0001 AS DECIMAL(18, 4)) AS p, CAST(l_quantity AS DECIMAL(18, 4)) AS q FROM lineitem)
SELECT symbol, round(CAST(sum(p * q) FILTER (side = 'SELL') AS DOUBLE) / CAST(nullif(sum(q) FILTER (side = 'SELL'), 0) AS DOUBLE), 6) AS exit_vwap FROM f GROUP BY 1""")
def fills_exit_vwap(spark, d):
    sell = F.col("side") == "SELL"
    top, bottom = F.sum(F.when(sell, F.col("price") * F.col("quantity"))), F.sum(F.when(sell, F.col("quantity")))
    return fills(spark, d).groupBy("symbol").agg(F.round(F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0))), 6).alias("exit_vwap"))
