"""Operator 1: self-join of documents by n-gram Jaccard similarity, with PartEnum signatures.

A document's set holds the hashes of its distinct shingles of `width` words. Two documents link if
100 * |intersection| >= 75 * |union|. Result: the connected components of all links, exactly.

Plan (every step is a Spark job over partitioned rows; nothing that grows with the corpus is collected):
1. One scan makes sets and PartEnum signatures. Sets are named by a hash of their features, so copies
   are one set from here on. Signatures travel as packed blocks, dealt by band and leading bits.
2. Where two sets meet in a signature, a group is kept. A set that meets others in fewer signatures than
   any similar pair must share is dropped (see partenum.signatures).
3. The remaining sets are read again and keep the features that some other remaining set has; a set
   that keeps under 3/4 of its features cannot link.
4. Each group is a star: the set with the fewest features of its own, its centre, against the others,
   verified on the features. So a family of near copies costs its size, not its square; what most of them
   have in common is likely whole in the centre. First each set meets the best of its stars' centres,
   then, after components of these links are found, those centres that are of another class still.
5. Members of one group in different classes remain. |x & y| <= min(|x & l|, |y & l|) + min of what x
   and y keep outside l, for the group's centre l: pairs that this bound rules out are dropped, and so
   are those whose features, counted by their low bits, are too different. The others are verified, and components are closed over both kinds of links.

Hash collisions apart (64 bits a feature), no link is lost and none is invented.

Cases: a text without words, or null, has an empty set, links with nothing and is its own component;
fewer words than `width` are one shingle; a row without key links like others but gives no component its
name (it has the smallest key it reaches, null if there is none); repeated rows are linked like copies; an
empty table gives no rows; other columns are dropped first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.llm import partenum
from quillbar.llm.bpe import then_unload
from quillbar.llm.common import bounded_count, framed, materialize, slices, table
from quillbar.llm.components import components
from quillbar.llm.words import feature_sets, mix, word_counts

WIDTH = 5
#: Least similarity of a link.
PERCENT = 75
#: Signatures for each block of signatures, and features for each block of features.
SIGNATURES_IN_BLOCK = 800_000
FEATURES_IN_BLOCK = 1_500_000
#: Signatures that a task holds before it sends them, members of a group that one row holds.
HELD = 500_000
CHUNK = 2048
#: Members in a chunk when pairs within a group are looked for.
PAIRED = 128
#: Values of low bits by which a set's features are counted.
MOST_VALUES = 4096
#: Rows of up to 32 bytes that may be broadcast (8 MB); beyond it joins shuffle both sides.
MOST_BROADCAST = 250_000


def linked(shared, a, b, percent: int = PERCENT):
    return 100 * shared >= percent * (a + b - shared)


def set_name(features: np.ndarray) -> int:
    return int((mix(features).sum(dtype=np.uint64) + mix(np.array([len(features)], np.uint64))[0:1]).view(np.int64)[0])


def _blocks(leading: np.ndarray, blocks: int) -> np.ndarray:
    return (((leading >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int32)


def _band_counts(width: int):
    """Batches of texts -> (band, sets): how many sets send signatures to each band, repeated shingles counted."""

    def run(batches):
        total = np.zeros(64, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts, 4 << 20):
                words = word_counts([t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()])
                n = np.maximum(4, words - (width - 1))
                own = np.frexp(n.astype(np.float64))[1] - 1
                total += np.bincount(np.concatenate([own, own[4 * n // 3 >= 2 << own] + 1]), minlength=64)
        band = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(total[band])], ["band", "sets"])

    return run


def _block_ranges(source: DataFrame, width: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each band, so that a block holds about SIGNATURES_IN_BLOCK. A set sends to the
    blocks of its bands only."""
    counted = source.where("text is not null").select("text").mapInArrow(_band_counts(width), "band int, sets long")
    rows = sorted(counted.groupBy("band").agg(F.sum("sets")).collect())  # a row a band
    ranges, first = {}, 0
    for band, count in rows:
        ranges[band] = (first, -(-count * partenum.parts(band) // SIGNATURES_IN_BLOCK))
        first += ranges[band][1]
    return ranges


def _subsets(features: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
    """PartEnum: [(band, signatures)] of a set, and how many it surely shares with a similar set in its own band and the next."""
    found, least = [], [0, 0]
    for band, difference in partenum.bands(len(features)):
        signature, least[band >= len(features).bit_length()] = partenum.signatures(features, band, difference)
        found.append((band, signature))
    return found, least


def _sketch(ranges: dict[int, tuple[int, int]], width: int, sign=_subsets):
    """Batches of (at, no key, text) -> rows of (block, docs, signatures). sign: as _subsets."""
    blocks = max(1, sum(n for _, n in ranges.values()))

    def flush(entries, found):
        of_band = {}
        for x in entries:
            of_band.setdefault(x[1], []).append(x)
        for band, own in of_band.items():
            first, n = ranges.get(band, (0, blocks))
            signature, name = np.concatenate([x[2] for x in own]), np.array([x[0] for x in own], "<i8")
            entry = np.repeat(np.arange(len(own)), [len(x[2]) for x in own])
            block = _blocks(signature, n)
            order = np.argsort(block, kind="stable")
            signature, entry, block = signature[order], entry[order], block[order]
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                sent, count = np.unique(entry[lo:hi], return_counts=True)
                low, wide = signature[lo:hi] & np.uint64((1 << 40) - 1), 1 if count.max() < 256 else 4
                body = [np.array([len(sent), hi - lo, band, wide], "<i4"), name[sent], count.astype(f"<u{wide}"), low.astype("<u4"), (low >> np.uint64(32)).astype("u1")]
                found.append((first + int(block[lo]), None, b"".join(x.tobytes() for x in body)))

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())], ["block", "docs", "signatures"])

    def run(batches):
        entries, held, met = [], 0, set()
        for batch in batches:
            at, without, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for lo, hi in slices(texts, 2 << 20):
                found, names, sizes, surely = [], [], [], []
                for features in feature_sets([t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()], width):
                    name, least = set_name(features), [0, 0]
                    names.append(name)
                    sizes.append(len(features))
                    if name not in met and len(features):
                        met.add(name)
                        signed, least = sign(features)
                        for band, signature in signed:
                            entries.append((name, band, signature))
                            held += len(signature)
                    surely.append(least)
                docs = np.stack([at[lo:hi].astype("<i8"), without[lo:hi].astype("<i8"), np.array(names, "<i8"), np.array(sizes, "<i8"), *np.array(surely, "<i8").T])
                found.append((int(abs(names[0]) % blocks), docs.tobytes(), None))
                if held > HELD:
                    flush(entries, found)
                    entries, held = [], 0
                if len(met) > 200_000:
                    met = set()
                yield batch_of(found)
        if entries:
            found = []
            flush(entries, found)
            yield batch_of(found)

    return run


def _empty(kinds: dict) -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in kinds.items()})


_MEETINGS = {"kind": pa.int32(), "x": pa.int64(), "y": pa.int64(), "z": pa.int64(), "nokey": pa.int32(), "own": pa.int32(), "above": pa.int32(), "members": pa.list_(pa.int64())}


def _rows(kind: int, n: int, **columns) -> pa.Table:
    return pa.table([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.nulls(n, t) for c, t in _MEETINGS.items()], names=list(_MEETINGS))


def _meet(found: pa.Table) -> pa.Table:
    """One block -> its documents (kind 0: key or hash, set, size, whether it has no key, what the set surely shares in its own band and
    the one above), how often each set of a band meets others (kind 1: set, meetings, band) and the groups
    that meet (kind 2: number of the group, members)."""
    block, parts = int(found.column("block")[0].as_py()), []
    for raw in found.column("docs").drop_null().to_pylist():
        x, without, y, z, own, above = np.frombuffer(raw, "<i8").reshape(6, -1)
        parts.append(_rows(0, len(x), x=x, y=y, z=z, nokey=without.astype(np.int32), own=own.astype(np.int32), above=above.astype(np.int32)))
    names, bands, count, signature = [], [], [], []
    for raw in found.column("signatures").drop_null().to_pylist():
        k, m, band, wide = np.frombuffer(raw, "<i4", 4).tolist()
        at = 16 + (8 + wide) * k
        names.append(np.frombuffer(raw, "<i8", k, 16))
        count.append(np.frombuffer(raw, f"<u{wide}", k, 16 + 8 * k).astype(np.int64))
        bands.append(np.full(k, band))
        low, high = np.frombuffer(raw, "<u4", m, at), np.frombuffer(raw, "u1", m, at + 4 * m)
        signature.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
    if names:
        names, bands, count, signature = map(np.concatenate, (names, bands, count, signature))
        entry = np.repeat(np.arange(len(names)), count)
        order = np.lexsort((names[entry], signature))
        signature, entry = signature[order], entry[order]
        name = names[entry]
        fresh = np.concatenate([[True], (signature[1:] != signature[:-1]) | (name[1:] != name[:-1])])
        signature, entry, name = signature[fresh], entry[fresh], name[fresh]
        start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        size = np.diff(np.append(start, len(signature)))
        many = np.repeat(size > 1, size)
        entry, name, size = entry[many], name[many], size[size > 1]
        if len(size):
            order = np.lexsort((bands[entry], name))
            n, b = name[order], bands[entry][order]
            first = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (b[1:] != b[:-1])]))
            met = np.diff(np.append(first, len(n)))
            parts.append(_rows(1, len(first), x=n[first], y=met, z=b[first]))
            # Long groups take several rows of the same number.
            rows = -(-size // CHUNK)
            of = np.repeat(np.arange(len(size)), rows)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
            edges = np.append((np.cumsum(size) - size)[of] + nth * CHUNK, len(name)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(name))
            parts.append(_rows(2, len(of), x=(np.int64(block) << 40) + of, members=lists))
    return pa.concat_tables(parts) if parts else _empty(_MEETINGS)


def _features(blocks: int, width: int):
    """Batches of (set, text) -> rows of (block, features): names, sizes and features dealt by leading bits."""

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0).to_numpy(), batch.column(1)
            for lo, hi in slices(texts, 3 << 20):
                sets = feature_sets([t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()], width)
                kept = [i for i, s in enumerate(sets) if set_name(s) == names[lo + i]]
                if not kept:
                    continue
                size = np.array([len(sets[i]) for i in kept])
                feature, entry = np.concatenate([sets[i] for i in kept]), np.repeat(np.arange(len(kept)), size)
                name = names[lo:hi][kept]
                block = _blocks(feature, blocks)
                order = np.argsort(block, kind="stable")
                feature, entry, block = feature[order], entry[order], block[order]
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                out = []
                for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
                    own, count = np.unique(entry[a:b], return_counts=True)
                    body = [np.array([len(own), b - a], "<i4"), name[own].astype("<i8"), count.astype("<i4"), feature[a:b].astype("<u8")]
                    out.append((int(block[a]), b"".join(x.tobytes() for x in body)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["block", "features"])

    return run


def _common(found: pa.Table) -> pa.Table:
    """One block of features -> for each set those that another set has too."""
    names, feature = [], []
    for raw in found.column("features").to_pylist():
        k, m = np.frombuffer(raw, "<i4", 2)
        name, count = np.frombuffer(raw, "<i8", k, 8), np.frombuffer(raw, "<i4", k, 8 + 8 * k)
        names.append(np.repeat(name, count))
        feature.append(np.frombuffer(raw, "<u8", m, 8 + 12 * k))
    name, feature = np.concatenate(names), np.concatenate(feature)
    order = np.lexsort((name, feature))
    name, feature = name[order], feature[order]
    fresh = np.concatenate([[True], (feature[1:] != feature[:-1]) | (name[1:] != name[:-1])])
    name, feature = name[fresh], feature[fresh]
    start = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    size = np.diff(np.append(start, len(feature)))
    many = np.repeat(size > 1, size)
    name, feature = name[many], feature[many].view(np.int64)
    order = np.argsort(name, kind="stable")
    name, feature = name[order], feature[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(name)).astype(np.int32)), pa.array(feature))
    return pa.table([pa.array(name[first]), lists], names=["s", "part"])


@F.pandas_udf(T.IntegerType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted arrays without repeats."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.BinaryType())
def counts_by_bits(common: pd.Series) -> pd.Series:
    """How many features have each value of their low bits, a byte a value, half as many values as
    features at least and MOST_VALUES at most; empty if a count does not fit."""

    def of(features):
        values = min(MOST_VALUES, 1 << max(0, len(features).bit_length() - 1))
        count = np.bincount(features & (values - 1), minlength=values)
        return count.astype(np.uint8).tobytes() if count.max() < 256 else b""

    return pd.Series([of(np.asarray(x)) for x in common], dtype=object)


def _most_shared(left: list[bytes], right: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the features that left[i] and right[j] share: what they have of each value of the low bits."""
    values = min((len(x) for x in (*left, *right) if x), default=1)
    folded = [np.stack([np.frombuffer(x, np.uint8).reshape(-1, values).sum(0, dtype=np.int32) if x else np.full(values, 1 << 20, np.int32) for x in side]) for side in (left, right)]
    step = max(1, 2_000_000 // values)
    most = np.concatenate([np.minimum(folded[0][i[k : k + step]], folded[1][j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)])
    none = [np.array([not x for x in side]) for side in (left, right)]  # counts that do not fit bound nothing
    return np.where(none[0][i] | none[1][j], np.iinfo(np.int64).max // 16, most)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their sizes and `shared`."""
    left = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("common").alias("fa"))
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("common").alias("fb"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", "na", "nb", F.size("fa").alias("ka"), F.size("fb").alias("kb"), overlap("fa", "fb").alias("shared"))


def _centre_order(name: str, size: str, common: str):
    """Orders candidates for the centre of a star: fewest features of its own, then by a hash."""
    return F.shiftleft((F.col(size) - F.col(common)).cast("long"), 32).bitwiseOR(F.xxhash64(name).bitwiseAND(F.lit(0xFFFFFFFF)))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the classes (node, root) and further links."""
    if not bounded_count(links):
        return classes
    return components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _possible_pairs(batches, percent: int = PERCENT):
    """Rows of (centre, left, right): chunks of a centre's members, left those outside its class. Pairs of different classes that the bound of step 5 does not rule out."""
    for batch in batches:
        out = []
        for centre, left, right in zip(batch.column("l").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
            x, y = ({n: np.asarray(side.values.field(n)) for n in ("s", "n", "w", "a", "root")} for side in (left, right))
            s, n, w, a, root = ((x[f][:, None], y[f][None, :]) for f in ("s", "n", "w", "a", "root"))
            most = np.minimum(*a) + np.minimum(*w)
            ok = (root[0] != root[1]) & (s[0] != s[1]) & ((100 + percent) * most >= percent * (n[0] + n[1])) & (100 * np.minimum(*n) >= percent * np.maximum(*n))
            before = [[[c for c in cs if c < centre] for cs in side.values.field("centres").to_pylist()] for side in (left, right)]
            number = {c: m for m, c in enumerate({c for cs in before[0] for c in cs})}
            if number and ok.any():
                marks = [np.zeros((len(side), len(number)), np.float32) for side in before]
                for mark, side in zip(marks, before, strict=True):
                    for row, cs in zip(mark, side, strict=True):
                        row[[number[c] for c in cs if c in number]] = 1
                ok &= (marks[0] @ marks[1].T) == 0
            i, j = np.nonzero(ok)
            if len(i):
                most = _most_shared(left.values.field("counts").to_pylist(), right.values.field("counts").to_pylist(), i, j)
                able = (100 + percent) * most >= percent * (x["n"][i] + y["n"][j])
                i, j = i[able], j[able]
            if len(i):
                p, q = x["s"][i], y["s"][j]
                out.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0))
        if out:
            found = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_shingles, component_id (smallest key of the component) of every row with a key."""
    return set_components(docs, key, text, width, PERCENT, _subsets, lambda source: _block_ranges(source, width))


def set_components(docs: DataFrame, key: str, text: str, width: int, percent: int, sign, ranges_of) -> DataFrame:
    """The plan above for links of `percent` among the sets that share signatures. sign: as _subranges_of(source): as _block_ranges."""
    # A row without key goes by a hash of its text.
    at, source = F.coalesce("key", F.xxhash64("text")), docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.select(at.alias("at"), F.col("key").isNull().cast("int").alias("nokey"), "text")
    dealt = source.mapInArrow(then_unload(_sketch(ranges_of(source), width, sign)), "block int, docs binary, signatures binary")
    kinds = "kind int, x long, y long, z long, nokey int, own int, above int, members array<long>"
    met = materialize(dealt.groupBy("block").applyInArrow(_meet, kinds), "meetings")
    rows = met.where("kind = 0").select(F.col("x").alias("at"), "nokey", F.when(F.col("nokey") == 0, F.col("x")).alias("key"), F.col("y").alias("s"), F.col("z").alias("n"), "own", "above")

    names = materialize(rows.groupBy("s").agg(F.min("key").alias("key"), F.min("at").alias("at"), F.min("n").alias("n"), F.max("own").alias("own"), F.max("above").alias("above")), "names")
    often = met.where("kind = 1").groupBy(F.col("x").alias("s"), F.col("z").alias("band")).agg(F.sum("y").alias("met"))
    surely = F.when(F.col("band") < F.length(F.bin("n")), F.col("own")).otherwise(F.col("above"))
    able = often.join(names, "s").where(F.col("met") >= F.greatest(surely, F.lit(1)))
    passing = materialize(able.select("s", F.coalesce("key", "at").alias("at"), F.col("key").isNull().cast("int").alias("nokey"), "n").distinct(), "passing")

    total = passing.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("features")).first()
    few = total["rows"] <= MOST_BROADCAST
    small = F.broadcast if few else (lambda df: df)
    wanted = source.join(small(passing.select("at", "nokey", "s")), ["at", "nokey"]).select("s", "text")
    feature_blocks = max(8, -(-total["features"] // FEATURES_IN_BLOCK))
    parts = wanted.mapInArrow(then_unload(_features(feature_blocks, width)), "block int, features binary").groupBy("block").applyInArrow(_common, "s long, part array<long>")
    common = parts.groupBy("s").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("common"))
    sets = materialize(common.join(passing.select("s", "n"), "s").where(100 * F.size("common") >= percent * F.col("n")).withColumn("counts", counts_by_bits("common")), "sets")

    held = small(sets.select("s", "n", F.size("common").alias("k")))
    members = met.where("kind = 2").select(F.col("x").alias("g"), F.explode("members").alias("s")).join(held, "s")
    least = members.groupBy("g").agg(F.min_by("s", _centre_order("s", "n", "k")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1")
    grouped = materialize(members.join(least, "g"), "groups")
    sized = held.select(F.col("s").alias("l"), F.col("n").alias("nl"), F.col("k").alias("kl"))
    possible = f"100 * least(n, nl) >= {percent} * greatest(n, nl) and {100 + percent} * least(k, kl) >= {percent} * (n + nl)"
    star = grouped.where("s <> l").select("l", "s", "n", "k").distinct().join(sized, "l").where(possible)
    star = materialize(star.select(F.col("l").alias("a"), F.col("s").alias("b"), _centre_order("l", "nl", "kl").alias("order")), "star")
    checked = materialize(_verified(star.groupBy("b").agg(F.min_by("a", "order").alias("a")), sets), "checked")
    similar = lambda df: df.where(linked(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    classes = components(similar(checked))
    rooted_as = lambda x: classes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    apart = star.join(checked.select("a", "b"), ["a", "b"], "left_anti").join(rooted_as("a"), "a", "left").join(rooted_as("b"), "b", "left")
    apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    second = materialize(_verified(apart, sets), "checked")
    classes = _joined(classes, materialize(similar(second), "links"))
    checked = checked.unionByName(second)

    # What the star leaves open: groups of three or more whose members are of different classes. All
    # groups of one centre are looked at together, and a pair at the least centre they share only. Tables by
    # centre are written before they are joined, so that a join can split the rows of a hot centre.
    root_of = lambda x, name: small(classes.select(F.col("node").alias(x), F.col("root").alias(name)))
    known = checked.select(F.col("a").alias("l"), F.col("b").alias("s"), "shared")
    stars = grouped.where("m > 2").select("l", "s", "n", "k").distinct().join(root_of("s", "root"), "s", "left").join(root_of("l", "root_l"), "l", "left")
    stars = materialize(stars.withColumn("root", F.coalesce("root", "s")).withColumn("root_l", F.coalesce("root_l", "l")), "stars")
    centres = stars.groupBy("s").agg(F.sort_array(F.collect_list("l")).alias("centres"))
    mixed = materialize(stars.groupBy("l").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("l", "m"), "mixed")
    open_groups = materialize(stars.join(small(mixed), "l").join(known, ["l", "s"], "left"), "open")
    rest = _verified(open_groups.where("shared is null and s <> l").select(F.col("l").alias("a"), F.col("s").alias("b")), sets)
    counted = materialize(rest.select(F.col("a").alias("l"), F.col("b").alias("s"), F.col("shared").alias("late")), "checked")
    # a: features in common with the centre, w: others.
    a = F.coalesce(F.when(F.col("s") == F.col("l"), F.col("k")), F.col("shared"), F.col("late")).cast("long")
    labelled = open_groups.join(counted, ["l", "s"], "left").select("s", "l", "m", "root", "root_l", F.col("n").cast("long").alias("n"), a.alias("a"), (F.col("k") - a).alias("w"))
    span = materialize(labelled.groupBy("l").agg(F.max("a").alias("most_a"), F.max("w").alias("most_w"), F.min("n").alias("least_n")), "span")
    reach = F.least("a", "most_a") + F.least("w", "most_w")
    hopeful = labelled.join(small(span), "l").where((100 + percent) * reach >= percent * (F.col("n") + F.greatest("least_n", F.ceil(percent * F.col("n") / 100))))
    hopeful = hopeful.join(centres, "s").join(sets.select("s", "counts"), "s").withColumn("outside", F.col("root") != F.col("root_l"))
    chunk = F.pmod(F.xxhash64("s"), F.ceil(F.col("m") / PAIRED)).alias("c")
    members = F.collect_list(F.struct("s", "n", "w", "a", "root", "centres", "counts", "outside")).alias("right")
    chunks = materialize(hopeful.groupBy("l", chunk).agg(members).select("l", "right"), "open")
    outside = chunks.select("l", F.filter("right", lambda x: x["outside"]).alias("left")).where(F.size("left") > 0)
    pairs = outside.join(chunks, "l").select("l", "left", "right").mapInArrow(lambda batches: _possible_pairs(batches, percent), "a long, b long").distinct()
    more = _verified(pairs, sets)
    classes = _joined(classes, materialize(similar(more), "links"))

    linked_sets = names.select("s", "key").join(small(classes.withColumnRenamed("node", "s")), "s")
    smallest = materialize(linked_sets.groupBy("root").agg(F.min("key").alias("component_id")), "smallest")
    of_class = linked_sets.join(small(smallest), "root").select("s", "component_id")
    named = names.select("s", "key").join(small(of_class), "s", "left").select("s", F.coalesce("component_id", "key").alias("component_id"))
    named = materialize(named, "named")  # so that the join can split the rows of one text with very many copies
    whole = rows.where("n > 0").join(named, "s").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return whole.unionByName(alone)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose component has an earlier row, by key; of rows that share key and text one
    stays, and rows that share a key alone are documents of their own. Rows without a key all stay."""
    named, _ = framed(docs, key, text)
    found = materialize(jaccard_components(named, "row", "text"), "components")
    gone = materialize(found.where("row <> component_id").select("row").distinct(), "gone")
    hint = F.broadcast if bounded_count(gone) <= MOST_BROADCAST else (lambda df: df)
    kept = named.join(hint(gone), "row", "left_anti")
    if found.where("row is not null").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        kept = kept.where("row is not null").dropDuplicates(["row"]).unionByName(kept.where("row is null"))
    return kept.select("whole.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard": op1}
ORACLES: dict[str, str] = {}
