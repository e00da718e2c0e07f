"""Trades of an account or market that are served in pages, as a data source for batch and streaming reads.

A page begins at a time and holds the rows from it on, in order of (at, id); the next page begins at the last time of the one
before, so rows of that moment come twice. The position of a reader is (last time, ids seen at it) for each symbol: a restart loses and repeats
nothing. A page that brings nothing new although a later one exists, and whose time does not advance, is an error. Pages lie in a folder
for each symbol, named by their first time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, id long, at long, price double"


class Pages:
    """The pages of a folder; `after` gives the rows of a symbol behind a position, up to another."""

    def __init__(self, path: str):
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(path)

    def symbols(self) -> dict[str, list[int]]:
        """Times at which pages begin."""
        selector = pyarrow.fs.FileSelector(self.root, recursive=True, allow_not_found=True)
        found: dict[str, list[int]] = {}
        for f in self.files.get_file_info(selector):
            if f.is_file and f.base_name.endswith(".parquet"):
                symbol, name = f.path.split("/")[-2:]
                found.setdefault(symbol, []).append(int(name[: -len(".parquet")]))
        return {s: sorted(x) for s, x in found.items()}

    def page(self, symbol: str, begins: int) -> list[tuple[int, int, float]]:
        rows = pq.read_table(f"{self.root}/{symbol}/{begins}.parquet", filesystem=self.files, columns=["at", "id", "price"])
        return sorted(zip(*(rows.column(c).to_pylist() for c in ("at", "id", "price")), strict=True))

    def end(self, symbol: str, begins: list[int]) -> list:
        """The position behind all rows that are served now."""
        rows = self.page(symbol, begins[-1])
        last = rows[-1][0] if rows else begins[-1]
        return [last, [i for at, i, _ in rows if at == last]]

    def after(self, symbol: str, begins: list[int], start: list | None, end: list) -> Iterator[tuple[str, int, int, float]]:
        now, seen = (start[0], set(start[1])) if start else (None, set())
        first = 0 if now is None else max((i for i, t in enumerate(begins) if t <= now), default=0)
        ended = set(end[1])
        for place in range(first, len(begins)):
            if begins[place] > end[0]:
                return
            fresh = 0
            rows = self.page(symbol, begins[place])
            for at, number, price in rows:
                if now is not None and (at < now or (at == now and number in seen)):
                    continue
                if at > end[0] or (at == end[0] and number not in ended):
                    return
                if at != now:
                    now, seen = at, set()
                seen.add(number)
                fresh += 1
                yield symbol, number, at, price
            if not fresh and place + 1 < len(begins) and rows and rows[-1][0] == rows[0][0] and begins[place + 1] <= rows[0][0]:
                raise ValueError("page_stalled")


class _Stretch(InputPartition):
    def __init__(self, symbol: str, begins: list[int], start: list | None, end: list):
        self.symbol, self.begins, self.start, self.end = symbol, begins, start, end


class _Reader:
    def __init__(self, options):
        self.path = options["path"]
        # A range of times is pushed to the pages: those outside it are not opened.
        self.low, self.high = (int(options[n]) if options.get(n) else None for n in ("from", "to"))

    def stretches(self, start: dict, end: dict, begins: dict) -> list[_Stretch]:
        return [_Stretch(s, begins[s], start.get(s), end[s]) for s in sorted(end) if start.get(s) != end[s]] or [_Stretch("", [], None, [0, []])]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        rows = Pages(self.path).after(partition.symbol, partition.begins, partition.start, partition.end) if partition.begins else iter(())
        return (r for r in rows if (self.low is None or r[2] >= self.low) and (self.high is None or r[2] < self.high))


class PagedStream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pages = Pages(self.path)
        return {s: pages.end(s, x) for s, x in pages.symbols().items()}

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        return self.stretches(start, end, {s: [t for t in x if s in end and t <= end[s][0]] for s, x in Pages(self.path).symbols().items()})

    def commit(self, end: dict) -> None:
        pass


class PagedBatch(_Reader, DataSourceReader):
    def partitions(self) -> list[_Stretch]:
        pages = Pages(self.path)
        begins = pages.symbols()
        for s, x in begins.items():
            kept = [t for i, t in enumerate(x) if (self.high is None or t < self.high) and (self.low is None or i + 1 == len(x) or x[i + 1] >= self.low)]
            begins[s] = kept
        begins = {s: x for s, x in begins.items() if x}
        return self.stretches({}, {s: pages.end(s, x) for s, x in begins.items()}, begins)


class PagedTrades(DataSource):
    """format("paged_trades"), option path and, for a batch, from and to (microseconds)."""

    @classmethod
    def name(cls) -> str:
        return "paged_trades"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedBatch:
        return PagedBatch(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedTrades)


def serve(trades: DataFrame, path: str, size: int) -> None:
    """Writes trades (symbol, id, at in microseconds, price) as pages of `size` rows; a page repeats the last moment of the one before.
    A page is one group of a stated size."""
    from pyspark.sql import Window as W

    order = W.partitionBy("symbol").orderBy("at", "id")
    numbered = trades.withColumn("page", F.floor((F.row_number().over(order) - 1) / size))
    last = numbered.groupBy("symbol", "page").agg(F.max("at").alias("at"))
    again = numbered.join(last, ["symbol", "page", "at"]).withColumn("page", F.col("page") + 1)
    whole = numbered.unionByName(again.join(numbered.select("symbol", "page").distinct(), ["symbol", "page"], "left_semi").select(*numbered.columns))

    def write(key, rows):
        symbol, _ = (x.as_py() for x in key)
        files, root = pyarrow.fs.FileSystem.from_uri(path)
        moments = rows.column("at").to_pylist()
        begins = min(moments)
        if len(moments) >= size and begins == max(moments):
            raise ValueError("page_stalled")  # a page of one moment cannot be passed
        files.create_dir(f"{root}/{symbol}", recursive=True)
        pq.write_table(rows.select(["at", "id", "price"]), f"{root}/{symbol}/{begins}.parquet", filesystem=files)
        return rows.select(["symbol"]).slice(0, 1)

    whole.groupBy("symbol", "page").applyInArrow(write, "symbol string").write.format("noop").mode("overwrite").save()
