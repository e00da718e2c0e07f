"""Paged scans and the log of changed sources: restarts, overlaps, changes in the middle."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillbar.operators import dirty
from quillbar.sources import paged


def trades(n, gap=3):
    return [(("a", "b")[i % 2], i, (i // gap) * 10, float(i)) for i in range(n)]


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    """Pages that share moments; more pages after a restart; nothing lost, nothing twice."""
    path, out, state = f"file://{tmp_path}/pages", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    paged.register(spark)
    rows = trades(200)
    schema = paged.SCHEMA

    def run():
        stream = spark.readStream.format("paged_trades").option("path", path).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    paged.serve(spark.createDataFrame(rows[:120], schema), path, 7)
    assert run() == sorted(rows[:120])
    # The last page grows, and others follow it.
    paged.serve(spark.createDataFrame(rows, schema), path, 7)
    assert run() == sorted(rows)
    assert run() == sorted(rows)


def test_a_batch_opens_the_pages_of_its_time_only(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/pages"
    paged.register(spark)
    rows = trades(300)
    paged.serve(spark.createDataFrame(rows, paged.SCHEMA), path, 10)
    read = lambda **o: sorted(tuple(r) for r in spark.read.format("paged_trades").options(**({"path": path} | o)).load().collect())
    assert read() == sorted(rows)
    assert read(**{"from": "200", "to": "400"}) == sorted(r for r in rows if 200 <= r[2] < 400)
    every = paged.PagedBatch({"path": path}).partitions()
    some = paged.PagedBatch({"path": path, "from": "200", "to": "400"}).partitions()
    assert sum(len(p.begins) for p in some) < sum(len(p.begins) for p in every) / 3
    assert read(path=f"file://{tmp_path}/nothing") == []


def test_a_page_without_progress_is_an_error(tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    put = lambda name, ids, at: pq.write_table(pa.table({"at": [at] * len(ids), "id": ids, "price": [1.0] * len(ids)}), folder / f"{name}.parquet")
    put(10, [1, 2], 10)
    pages = paged.Pages(f"file://{tmp_path}")
    assert [r[1] for r in pages.after("s", [10], None, [10, [1, 2]])] == [1, 2]
    with pytest.raises(ValueError, match="page_stalled"):
        list(pages.after("s", [10, 10, 10], None, [10, [1, 2]]))


DOCUMENT = "source_id long, revision long, text string"


def build(spark, sources, fails=False):
    """Documents of the sources as they are when the run reads them."""

    def of(claims):
        now = spark.createDataFrame([(s, t) for s, (_, t) in sources.items()], "source_id long, text string")
        if fails:
            raise RuntimeError("lost")
        return claims.join(now, "source_id").select("source_id", "revision", "text")

    return of


def test_a_change_during_a_build_is_the_next_runs(spark, tmp_path):
    path, state = f"file://{tmp_path}/i", f"file://{tmp_path}/s"
    sources = {i: (1, f"one {i}") for i in range(20)}
    change = lambda ids, revision: dirty.mark(spark.createDataFrame([(i, revision) for i in ids], dirty.LOG), path)
    shown = lambda: {r.source_id: r.text for r in dirty.documents(spark, path, DOCUMENT).collect()}
    waiting = lambda: {(r.source_id, r.revision) for r in dirty.dirty(spark, path).collect()}
    change(range(20), 1)
    assert shown() == {} and len(waiting()) == 20
    dirty.follow(spark, path, state, build(spark, sources)).awaitTermination()
    assert shown() == {i: f"one {i}" for i in range(20)} and not waiting()

    change([3, 4, 5], 2)
    assert set(shown()) == set(range(20)) - {3, 4, 5}  # out of date: hidden
    sources |= {i: (2, f"two {i}") for i in (3, 4, 5)}

    def changed_meanwhile(claims):
        found = build(spark, sources)(claims)
        change([4], 3)
        return found

    dirty.follow(spark, path, state, changed_meanwhile).awaitTermination()
    assert waiting() == {(4, 3)} and set(shown()) == set(range(20)) - {4}
    sources[4] = (3, "three 4")
    dirty.follow(spark, path, state, build(spark, sources)).awaitTermination()
    assert not waiting() and shown()[4] == "three 4" and shown()[3] == "two 3" and len(shown()) == 20


def test_a_run_that_fails_shows_nothing_and_is_done_again(spark, tmp_path):
    path, state = f"file://{tmp_path}/i", f"file://{tmp_path}/s"
    dirty.mark(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], dirty.LOG), path)
    sources = {1: (2, "a"), 2: (1, "b")}
    with pytest.raises(Exception):  # noqa: B017
        dirty.follow(spark, path, state, build(spark, sources, fails=True)).awaitTermination()
    assert dirty.documents(spark, path, DOCUMENT).count() == 0 and dirty.dirty(spark, path).count() == 2
    # Documents without a commit are those of a run that stopped in the middle.
    build(spark, sources)(dirty.dirty(spark, path)).write.parquet(f"{path}/documents/batch=0")
    assert dirty.documents(spark, path, DOCUMENT).count() == 0
    dirty.follow(spark, path, state, build(spark, sources)).awaitTermination()
    assert sorted(tuple(r) for r in dirty.documents(spark, path, DOCUMENT).collect()) == [(1, 2, "a"), (2, 1, "b")]
    del sources[2]  # a source that is gone leaves no document
    dirty.mark(spark.createDataFrame([(2, 5)], dirty.LOG), path)
    dirty.follow(spark, path, state, build(spark, sources)).awaitTermination()
    assert [r.source_id for r in dirty.documents(spark, path, DOCUMENT).collect()] == [1]
    assert dirty.dirty(spark, path).count() == 0
