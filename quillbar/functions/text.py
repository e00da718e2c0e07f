"""Text, hashes and small array functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES, CHUNK_OVERLAP = 480, 96


def contains_literal(text: Column, wanted: Column) -> Column:
    """Case-insensitive substring; %, _ and \\ mean themselves."""
    return F.contains(F.lower(text), F.lower(wanted))


def characters(text: Column) -> Column:
    """The distinct characters of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c != ""))


def may_contain(text: Column, wanted: Column) -> Column:
    """Necessary for contains_literal: all characters of a short phrase occur."""
    return (F.length(wanted) > 2) | (F.size(F.array_except(characters(wanted), characters(text))) == 0)


def search_phrase(text: Column) -> Column:
    """An instrument name as it is searched: full-width forms as ASCII, no white space, upper case,
    without a leading $, venue prefix, contract suffix and separators."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    x = F.upper(F.regexp_replace(F.translate(text, wide, narrow), r"[\s　]+", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"^\$+", ""), r"^BINANCE:", "")
    return F.regexp_replace(F.regexp_replace(x, r"\.P$", ""), r"[/\-_]", "")


def valid_symbol(symbol: Column) -> Column:
    """A-Z, 0-9, _ or Han; 40 characters and 128 bytes at most."""
    return symbol.rlike(r"^[A-Z0-9_一-鿿㐀-䶿]{1,40}$") & (F.octet_length(symbol) <= 128)


def slash_command(text: Column) -> Column:
    """/k, /t or /kt with direction (L, S, ?, C) and s=, h=, theta= before ' | '. Null direction and
    template T0 where a key repeats or a part is unknown."""
    head = F.split(F.substring_index(text, " | ", 1), r"\s+")
    args = F.filter(F.slice(head, 2, 64), lambda x: x != "")
    keyed = lambda k: F.filter(args, lambda x: x.startswith(f"{k}="))
    value = lambda k: F.substring_index(F.get(keyed(k), F.lit(0)), "=", -1)
    sides = F.filter(args, lambda x: x.isin("L", "S", "?", "C"))
    known = F.forall(args, lambda x: x.isin("L", "S", "?", "C") | x.rlike(r"^(s|h|theta)=\S+$"))
    single = (F.size(sides) <= 1) & (F.size(keyed("s")) <= 1) & (F.size(keyed("h")) <= 1) & (F.size(keyed("theta")) <= 1)
    numbers = F.coalesce(value("h").rlike(r"^\d+$"), F.lit(True)) & F.coalesce(value("theta").rlike(r"^\d+(\.\d+)?$"), F.lit(True))
    ok = F.get(head, F.lit(0)).isin("/k", "/t", "/kt") & known & single & numbers
    t1 = ok & F.get(sides, F.lit(0)).isin("L", "S") & value("h").isNotNull()
    return F.struct(F.get(head, F.lit(0)).alias("kind"), F.when(ok, F.get(sides, F.lit(0))).alias("direction"), F.when(ok, value("s")).alias("symbol"), F.when(ok, value("h").cast("int")).alias("hours"), F.when(ok, value("theta").cast("double")).alias("ratio"), F.when(t1, "T1").otherwise("T0").alias("template"))


def _cuts(text: str, size: int = CHUNK_BYTES, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int, str]]:
    raw = text.encode()
    out, at = [], 0
    on_edge = lambda i: i >= len(raw) or raw[i] & 0xC0 != 0x80
    while at < len(raw):
        end = min(at + size, len(raw))
        while not on_edge(end):
            end -= 1
        out.append((at, end, raw[at:end].decode()))
        if end == len(raw):
            break
        at = max(end - overlap, at + 1)
        while not on_edge(at):
            at += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def utf8_chunks(text: pd.Series) -> pd.Series:
    """Chunks of 480 bytes at most, 96 in common, cut between characters."""
    return text.map(lambda x: [dict(zip(("start", "end", "text"), c, strict=True)) for c in _cuts(x)], na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("next", T.IntegerType())]))
def utf8_slice(text: pd.Series, start: pd.Series, size: pd.Series) -> pd.DataFrame:
    """At most `size` bytes from byte `start`, and where the rest starts (null at the end)."""
    rows = []
    for t, s, n in zip(text, start, size, strict=True):
        raw = (t or "").encode()
        end = min(int(s) + int(n), len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        rows.append((raw[int(s) : end].decode(errors="ignore"), end if end < len(raw) else None))
    return pd.DataFrame(rows, columns=["text", "next"])


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in alphabetical order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def md5_uuid(*parts: Column) -> Column:
    """The md5 of the parts, written as a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def hash_chain(values: Column) -> Column:
    """sha256 folded over an ordered array of text."""
    return F.aggregate(values, F.lit(""), lambda h, x: F.sha2(F.concat_ws("|", h, x), 256))


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def nearest_two(sizes: list[int], wanted: Column) -> Column:
    """The two of the fixed sizes nearest to `wanted`, nearest first, smaller first on ties."""
    each = F.array_sort(F.array(*[F.struct(F.abs(wanted - s).alias("d"), F.lit(s).alias("s")) for s in sizes]))
    return F.transform(F.slice(each, 1, 2), lambda x: x["s"])


def falling_length(values: Column) -> Column:
    """Length of the longest strictly falling subsequence of an array of doubles."""
    best = F.aggregate(values, F.array().cast("array<struct<v:double,n:int>>"), lambda acc, x: F.concat(acc, F.array(F.struct(x.cast("double").alias("v"), (F.coalesce(F.array_max(F.transform(F.filter(acc, lambda a: a["v"] > x), lambda a: a["n"])), F.lit(0)) + 1).cast("int").alias("n")))))
    return F.coalesce(F.array_max(F.transform(best, lambda a: a["n"])), F.lit(0))


#: Fields of a JSON document that name other records, and the kind of record they name.
REFERENCES = {"call_id": "call", "attachment_id": "attachment", "statistics_run_id": "job", "baseline_run_id": "job", "search_run_id": "job", "job_id": "job", "session_id": "session", "set_snapshot_id": "set", "export_id": "export"}
REFERENCE_LISTS = {"call_ids": "call", "attachments": "attachment"}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def reference_ids(body: Column) -> Column:
    """Distinct (kind, id) of the records that JSON text refers to; what is no UUID is left out."""
    single = [F.struct(F.lit(kind).alias("kind"), F.get_json_object(body, f"$.{field}").alias("id")) for field, kind in REFERENCES.items()]

    def named(values: Column, kind: str, part) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), part(x).alias("id")))

    none = F.array().cast("array<string>")
    listed = [named(F.coalesce(F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>"), none), kind, lambda x: x) for field, kind in REFERENCE_LISTS.items()]
    items = F.coalesce(F.from_json(F.get_json_object(body, "$.items"), "array<struct<call_id:string,attachment_id:string>>"), F.array().cast("array<struct<call_id:string,attachment_id:string>>"))
    inside = [named(items, "call", lambda x: x["call_id"]), named(items, "attachment", lambda x: x["attachment_id"])]
    every = F.concat(F.array(*single), *listed, *inside)
    known = F.filter(every, lambda x: F.coalesce(x["id"].rlike(UUID), F.lit(False)))
    return F.array_distinct(F.transform(known, lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["id"]).alias("id"))))


def price_label(price: Column) -> Column:
    """Prices of axis labels: fewer places for larger prices."""
    places = F.when(price >= 1000, 2).when(price >= 1, 4).otherwise(6)
    text = F.when(places == 2, F.format_number(price, 2)).when(places == 4, F.format_number(price, 4)).otherwise(F.format_number(price, 6))
    return F.regexp_replace(text, r"\.?0+$", "")


def volume_label(volume: Column) -> Column:
    """Volumes in K, M and B with two places at most."""
    scaled = lambda by, unit: F.concat(F.regexp_replace(F.format_number(volume / by, 2), r"\.?0+$", ""), F.lit(unit))
    return F.when(volume >= 1e9, scaled(1e9, "B")).when(volume >= 1e6, scaled(1e6, "M")).when(volume >= 1e3, scaled(1e3, "K")).otherwise(scaled(1, ""))


def without_key(body: Column, *keys: str) -> Column:
    """JSON object text without the named keys."""
    fields = F.from_json(body, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(*keys)))


def merged_json(left: Column, right: Column) -> Column:
    """The fields of two JSON objects; the right one wins."""
    kind = "map<string,string>"
    a, b = F.from_json(left, kind), F.from_json(right, kind)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b))


def has_key(body: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(body), key)


def contains_json(body: Column, wanted: dict[str, str]) -> Column:
    """Whether a JSON object has all the given fields with these values."""
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & F.coalesce(F.get_json_object(body, f"$.{k}") == v, F.lit(False))
    return hit
