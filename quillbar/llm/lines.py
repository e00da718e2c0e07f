"""Operator 2: near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is a sequence of words (white space between them does not count). A line goes if an earlier line
(by doc_id, then place in the document) has the same words, or words within one edit: one word
inserted, deleted or replaced, both lines having at least `min_words` words. The earlier line may itself
be a copy; it counts all the same.

Method: distinct lines emit hashed variants, the line itself and the line without each of its words.
Two lines within one edit share a variant: the shorter one whole, or both without the same word. Equal
variants are joined through their earliest line, so a variant that thousands of lines share makes one
pair a line; the edit distance of each pair is verified on the words. Only lines that can have such a
partner emit variants: one edit leaves either the first or the second half of a line as it was, so a
line whose half-keys are all its own is left out. Variant hashes are running exclusive ors over word
places, so a line of a million words costs a million rows and no more.

Cases: null text has no lines; lines without words are never removed; a null doc_id takes no part and
keeps all its lines; rows that repeat doc_id and text share their places, so neither loses lines to the
other; rows of one doc_id with different texts are documents of their own, in the order of a hash of
their texts; an empty table gives no rows; other columns, whatever their names, are kept by
`without_removed` and dropped by `removed_lines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.llm.common import bounded_count, framed, materialize, table

MIN_WORDS = 8
#: Lines that are broadcast, at up to 64 bytes a line (13 MB); beyond it both sides are shuffled.
MOST_BROADCAST = 200_000
#: A line that occurs oftener is dealt to several tasks; MOST_HOT is the most there can be of them.
OFTEN, MOST_HOT = 2_000, 20_000


#: Fixed value: the white space between words.
SPACE = " \t\n\x0b\x0c\r"


def words_of(line):
    """Words of a line that has any."""
    return F.split(F.btrim(line, F.lit(SPACE)), r"\s+")


def has_words(line):
    return F.btrim(line, F.lit(SPACE)) != ""


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, pos, words of every line that has words."""
    split = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return split.where(has_words(F.col("line"))).select("doc", "pos", words_of(F.col("line")).alias("words"))


def _half_keys(n, words):
    """Keys of the first (even) and the second half (odd) of a line, were it the shorter or the longer one."""
    keys = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        rest = m - half
        keys.append(F.xxhash64(F.lit(0), m, F.slice(words, F.lit(1), half)).bitwiseAND(F.lit(-2)))
        keys.append(F.xxhash64(F.lit(1), m, F.slice(words, n - rest + 1, rest)).bitwiseOR(F.lit(1)))
    return F.array(*keys)


def _place(*names):
    return F.struct(*[F.col(n) for n in names])


def _xor(values):
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, pos, kept_doc, kept_pos of every line that goes, and the earliest line it repeats; for tables
    where rows that share a key share their text (see `removals` for others)."""
    lines = lines_of(docs, key, text)
    numbered = lines.select("doc", "pos", F.xxhash64("words").alias("line"), F.size("words").alias("n"), "words")
    keys = F.when(F.col("n") >= min_words, _half_keys(F.col("n"), F.col("words")))
    known = materialize(numbered.select("doc", "pos", "line", "n", keys.alias("keys")), "lines")
    first = F.min(_place("doc", "pos")).alias("first")
    keyed = known.where("keys is not null").select("line", F.explode("keys").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("line").alias("l"), F.max("line").alias("h")).where("l <> h").select("half")
    odd = F.col("half").bitwiseAND(F.lit(1)) == 1
    halves = keyed.join(shared, "half", "left_semi").groupBy("line").agg(F.bool_or(~odd).alias("head"), F.bool_or(odd).alias("tail"))
    halves = materialize(halves, "lines")
    hint = F.broadcast if bounded_count(halves) <= MOST_BROADCAST else (lambda df: df)
    able = known.where("keys is not null").select("line", "n", "doc", "pos").join(hint(halves), "line").groupBy("line", "n", "head", "tail").agg(first)
    able = materialize(able.select("line", "n", "head", "tail", "first.doc", "first.pos"), "lines")

    places = able.groupBy("doc").agg(F.collect_list(_place("pos", "line", "n", "head", "tail")).alias("at"))
    if bounded_count(able) <= MOST_BROADCAST:
        places = F.broadcast(places)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.split(F.col(text), "\n").alias("all"))
    fetched = texts.join(places, "doc").select("doc", "all", F.explode("at").alias("at"))
    words = words_of(F.get("all", F.col("at.pos")))
    words = fetched.select("at.line", "at.n", "at.head", "at.tail", "doc", "at.pos", words.alias("words"))
    words = words.where(F.xxhash64("words") == F.col("line"))  # another text of the id has other lines there
    candidates = materialize(words.dropDuplicates(["line", "n"]), "lines")

    # Word i of the line has the code of its place, and the code it gets if a word before it goes.
    code = F.transform("words", lambda w, i: F.xxhash64(i, w))
    moved = F.transform("words", lambda w, i: F.xxhash64(i - 1, w))
    coded = candidates.select("line", "n", "head", "tail", "doc", "pos", code.alias("c"), moved.alias("m"))
    coded = coded.select("line", "n", "head", "tail", "doc", "pos", _xor("c").alias("whole"), _xor("m").alias("all_moved"), F.arrays_zip("c", "m").alias("codes"))
    spread = coded.select("line", "n", "head", "tail", "doc", "pos", "all_moved", F.posexplode("codes").alias("i", "w"))
    upto = W.partitionBy("line", "n").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = spread.select("line", "n", "head", "tail", "doc", "pos", "i", "all_moved", F.col("w.c").alias("c"), F.expr("bit_xor(w.c)").over(upto).alias("before"), F.expr("bit_xor(w.m)").over(upto).alias("behind"))
    # With the first half in common the edit is in the second, and the other way round.
    run = run.where((F.col("head") & (F.col("i") >= F.floor((F.col("n") - 1) / 2))) | (F.col("tail") & (F.col("i") <= F.floor(F.col("n") / 2) + 1)))
    fewer = run.select(F.xxhash64(F.col("n") - 1, F.col("before").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("behind"))).alias("variant"), F.col("i").alias("gap"), "line", "n", "doc", "pos")
    entire = coded.select(F.xxhash64("n", "whole").alias("variant"), F.lit(-1).alias("gap"), "line", "n", "doc", "pos")
    variants = fewer.unionByName(entire).select("variant", "gap", _place("doc", "pos", "line", "n").alias("at"))

    # The earliest line for each (variant, gap); a line without a word meets the same gap and the whole line.
    earliest = variants.groupBy("variant", "gap").agg(F.min("at").alias("same"), F.count(F.lit(1)).alias("k"))
    of_variant = earliest.groupBy("variant").agg(F.min("same").alias("any"), F.min(F.when(F.col("gap") < 0, F.col("same"))).alias("whole"), F.sum("k").alias("k")).where("k > 1")
    best = earliest.join(of_variant.drop("k"), "variant").select("variant", "gap", F.when(F.col("gap") < 0, F.col("any")).otherwise(F.least("same", "whole")).alias("partner"))
    met = variants.join(best, ["variant", "gap"]).where(F.col("partner") < F.col("at"))
    pairs = met.select(F.col("at.line").alias("line"), F.col("at.n").alias("n"), F.col("partner.line").alias("with_line"), F.col("partner.n").alias("with_n"), _place("partner.doc", "partner.pos").alias("partner")).distinct()
    left = pairs.join(candidates.select("line", "n", F.col("words").alias("a")), ["line", "n"])
    right = candidates.select(F.col("line").alias("with_line"), F.col("n").alias("with_n"), F.col("words").alias("b"))
    verified = left.join(right, ["with_line", "with_n"]).where(within_one_edit(F.col("a"), F.col("b")))
    every = known.select("doc", "pos", "line", "n")
    repeated = materialize(every.groupBy("line", "n").agg(first, F.count(F.lit(1)).alias("k")).where("k > 1"), "lines")
    # A line near to an earlier one is here by its own first place, even if it occurs once.
    near = verified.groupBy("line", "n").agg(F.min("partner").alias("kept")).withColumn("k", F.lit(1).cast("long"))
    keeper = repeated.select("line", "n", F.col("first").alias("kept"), "k").unionByName(near)
    keeper = keeper.groupBy("line", "n").agg(F.min("kept").alias("kept"), F.max("k").alias("k"))
    often = max(OFTEN, -(-bounded_count(known) // MOST_HOT))
    parts = F.ceil(F.col("k") / often).cast("int")
    hot = repeated.where(F.col("k") > often).select("line", "n", parts.alias("parts"))
    part = F.pmod(F.xxhash64("doc", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = every.join(F.broadcast(hot), ["line", "n"], "left").withColumn("part", part)  # at most MOST_HOT rows
    keeper = keeper.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("k") > often, parts - 1).otherwise(0))))
    found = dealt.join(keeper, ["line", "n", "part"]).where(_place("doc", "pos") != F.col("kept"))
    return found.select("doc", "pos", F.col("kept.doc").alias("kept_doc"), F.col("kept.pos").alias("kept_pos"))


def within_one_edit(a, b):
    """Arrays of words that differ by one word inserted, deleted or replaced at most."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")  # 1-based, 0: nowhere
    n, m = F.size(a), F.size(b)
    rest = lambda x, skip: F.slice(x, differ + skip, F.size(x))
    same = F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)
    return (differ == 0) | F.when(differ > 0, same)


def removals(named: DataFrame, apart: bool, min_words: int = MIN_WORDS) -> DataFrame:
    """named, apart: see common.framed. row, removed (sorted places of its lines that go), kept_in (sorted keys of the
    documents that keep them) of each row of which any goes; copies of a row share theirs."""
    gone = removed_lines(named, "row", "text", min_words)
    if apart:
        gone = materialize(gone, "removed")
    by_row = gone.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("removed"), F.sort_array(F.collect_set("kept_doc")).alias("kept_in"))
    if apart:  # rows that keep lines are named by their keys
        keys = named.where("row is not null").select(F.col("row").alias("kept_doc"), F.col("doc").alias("kept_key")).distinct()
        sources = gone.select("doc", "kept_doc").distinct().join(keys, "kept_doc").groupBy("doc").agg(F.sort_array(F.collect_set("kept_key")).alias("kept_in"))
        by_row = by_row.drop("kept_in").join(sources, "doc")
    return by_row.select(F.col("doc").alias("row"), "removed", "kept_in")


def without_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their remaining lines as text; a document that had lines with words and lost them all goes."""
    named, apart = framed(docs, key, text)
    gone = removals(named, apart, min_words).select("row", "removed")
    given = F.col("whole").getField(text).cast("string")
    left = F.filter(F.split(given, "\n"), lambda line, i: ~F.array_contains(F.col("removed"), i))
    found = named.select("whole", "row").join(gone, "row", "left").withColumn("left", F.when(F.col("removed").isNotNull(), left))
    kept = found.where(F.col("removed").isNull() | F.exists("left", has_words))
    shown = F.when(F.col("removed").isNull(), given).otherwise(F.array_join("left", "\n"))
    return kept.select(*[shown.alias(c) if c == text else F.col("whole").getField(c).alias(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    named, apart = framed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    found = named.select("row", "whole.doc_id", lines.cast("long").alias("n_lines")).join(removals(named, apart), "row", "left")
    empty = F.array().cast("array<bigint>")
    removed = F.coalesce(F.col("removed").cast("array<bigint>"), empty)
    return found.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), removed.alias("removed"), F.coalesce("kept_in", empty).alias("kept_in"))


QUERIES = {"op2_line_dedup": op2}
ORACLES = {
    "op2_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM docs WHERE ls IS NOT NULL),
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS ws FROM l),
o AS (SELECT doc_id, pos, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
f AS (SELECT ws, n, min({'d': doc_id, 'p': pos}) AS first FROM o GROUP BY ws, n),
v AS (
  SELECT ws, n, first, ws AS variant, -1 AS gap FROM f WHERE n >= 8
  UNION ALL
  SELECT ws, n, first, list_concat(ws[1:i], ws[i + 2:]) AS variant, i AS gap FROM (SELECT *, unnest(range(n)) AS i FROM f WHERE n >= 8)),
e AS (SELECT variant, gap, min(first) AS same FROM v GROUP BY variant, gap),
g AS (SELECT variant, min(same) AS anyone, min(same) FILTER (gap < 0) AS whole FROM e GROUP BY variant),
near AS (
  SELECT v.ws, min(CASE WHEN v.gap < 0 THEN g.anyone WHEN g.whole IS NULL OR e.same < g.whole THEN e.same ELSE g.whole END) AS partner
  FROM v JOIN e ON v.variant = e.variant AND v.gap = e.gap JOIN g ON v.variant = g.variant GROUP BY v.ws),
keep AS (SELECT f.ws, CASE WHEN near.partner < f.first THEN near.partner ELSE f.first END AS kept FROM f LEFT JOIN near ON f.ws = near.ws),
gone AS (SELECT o.doc_id, o.pos, keep.kept FROM o JOIN keep ON o.ws = keep.ws WHERE keep.kept <> {'d': o.doc_id, 'p': o.pos}),
r AS (
  SELECT doc_id, count(DISTINCT pos) AS n_removed, list_sort(list_distinct(list(CAST(pos AS BIGINT)))) AS removed,
    list_sort(list_distinct(list(kept.d))) AS kept_in FROM gone GROUP BY doc_id)
SELECT docs.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(removed, CAST([] AS BIGINT[])) AS removed, coalesce(kept_in, CAST([] AS BIGINT[])) AS kept_in
FROM docs LEFT JOIN r ON docs.doc_id = r.doc_id
"""
}
