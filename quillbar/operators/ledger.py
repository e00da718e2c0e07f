"""Trade ledger: import conflicts, position cycles, totals, reconciliation."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.functions.decimals import CONTEXT, plain, q, ratio, times, trimmed
from quillbar.operators.bars import covers
from quillbar.operators.folds import folded


def import_rows(stored: DataFrame, staged: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """Distinct staged keys with status new, same or conflict: a conflict has another body than what is
    stored, or several bodies in the stage."""
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    old = stored.select(*keys, digest.alias("_old")).groupBy(*keys).agg(F.min("_old").alias("_old"))
    new = staged.select(*keys, digest.alias("_new")).groupBy(*keys).agg(F.min("_new").alias("_lo"), F.max("_new").alias("_hi"), F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_lo"), "same").otherwise("conflict")
    return new.join(old, keys, "left").select(*keys, status.alias("status"), "n_rows")


def append_new(stored: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the staged rows whose key it lacks; one row a key."""
    fresh = staged.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def fill_error() -> Column:
    """The first rule that a fill breaks, or null."""
    return (
        F.when(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "invalid_side")
        .when(~F.coalesce(F.col("price") > 0, F.lit(False)), "invalid_price")
        .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "invalid_quantity")
        .when(F.col("fee").isNull(), "invalid_fee")
        .when(F.col("trade_id").isNull(), "invalid_trade_id")
    )


PROTOCOL, ZERO = "book-1", Decimal(0)


class Book:
    """Folds one book's fills into cycles of a position that starts and ends flat. checkpoint() is its whole
    state as text; resumed() goes on from there, as if the fills before had just been folded. Sums and differences are those of
    Python's 28 digits, products and ratios have 34."""

    def __init__(self, quantity: Decimal | None = Decimal(0), cost: Decimal | None = None, multiplier: Decimal = Decimal(1), inverse: bool = False, hedge: int = 0):
        self.quantity, self.cost, self.multiplier, self.inverse, self.hedge = quantity, cost, multiplier, inverse, hedge
        self.ordinal, self.last, self.cycles, self.allocations, self.unknown = 0, None, [], [], 0
        self.paid: list[dict] = []  # commissions by asset of each of the cycles
        self.track_venue = True  # a fill without venue result leaves the cycle's venue result unknown
        self._clear()

    def _clear(self):
        self.pnl, self.commissions, self.venue, self.opened, self.direction = Decimal(0), {}, Decimal(0), None, 0

    @property
    def fees(self) -> Decimal:
        """Fees of the open cycle, whatever their assets."""
        return q(sum(self.commissions.values(), Decimal(0)))

    def _charge(self, asset: str, fee: Decimal):
        self.commissions[asset] = self.commissions.get(asset, ZERO) + fee

    def fill(self, at, trade_id: int, side: str, price: Decimal, quantity: Decimal, fee: Decimal, venue_pnl: Decimal | None = None, asset: str = ""):
        if self.last is not None and (at, trade_id) <= self.last:
            raise ValueError("fill_order_unproven")
        self.last = (at, trade_id)
        delta = quantity if side == "BUY" else -quantity
        if self.quantity is None:  # an unknown opening never invents a cycle
            self.unknown += 1
            self._charge(asset, fee)
            self.allocations.append((self.ordinal, trade_id, "opening_unknown", quantity, fee, None))
            return
        closing = self.quantity != 0 and (self.quantity > 0) != (delta > 0)
        closed = min(quantity, abs(self.quantity)) if closing else ZERO
        opened = quantity - closed
        if self.hedge and closing and opened:
            raise ValueError("hedge_over_close")
        closing_fee = (ratio(times(fee, closed), quantity) if opened else fee) if closed else ZERO
        sign = 1 if delta > 0 else -1
        if closed:
            self._close(trade_id, price, closed, closing_fee, venue_pnl, at, sign, asset)
        if opened:
            if not closed and venue_pnl:
                raise ValueError("opening_fill_with_pnl")
            self._open(at, trade_id, price, opened, fee - closing_fee, None if closed else venue_pnl, bool(closed), sign, asset)

    def run(self, *columns: list):
        """fill() of many fills (at, trade id, side, price, quantity, fee, asset) in order, without their allocations: the same operations on
        decimals, in one loop, for books without venue results."""
        if self.quantity is None or self.cost is None and self.quantity or self.inverse or self.hedge or not self.track_venue or self.pnl is None:
            for at, trade_id, side, price, quantity, fee, asset in zip(*columns, strict=True):
                self.fill(at, trade_id, side, price, quantity, fee, asset=asset)
            self.allocations = []
            return
        multiply, divide = CONTEXT.multiply, CONTEXT.divide
        held, cost, pnl, paid, last = self.quantity, self.cost, self.pnl, self.commissions, self.last
        for at, trade_id, side, price, quantity, fee, asset in zip(*columns, strict=True):
            if last is not None and (at, trade_id) <= last:
                raise ValueError("fill_order_unproven")
            last = (at, trade_id)
            buys = (quantity if side == "BUY" else -quantity) > 0
            if not quantity:
                continue
            left, rest, ends = quantity, fee, False
            if held and (held > 0) != buys:
                closed = min(quantity, abs(held))
                left = quantity - closed
                charged = divide(multiply(fee, closed), quantity) if left else fee
                pnl = pnl + multiply(multiply(closed, self.multiplier), price - cost) * (-1 if buys else 1)
                paid[asset] = paid.get(asset, ZERO) + charged
                held = held + (closed if buys else -closed)
                rest = fee - charged
                if ends := not held:
                    self.quantity, self.pnl, self.venue = held, pnl, None
                    self.cycles.append(self._summary(at, "closed"))
                    self.paid.append(paid)
                    self.ordinal, cost = self.ordinal + 1, None
                    self._clear()
                    pnl, paid = self.pnl, self.commissions
            if left:
                before = abs(held)
                if before:
                    after = before + left
                    cost = divide(multiply(before, cost) + multiply(left, price), after)
                else:
                    cost, self.direction, self.opened = price, 1 if buys else -1, at
                paid[asset] = paid.get(asset, ZERO) + rest
                held = held + (left if buys else -left)
            self.venue = Decimal(0) if ends else None
        self.quantity, self.cost, self.pnl, self.last = held, cost, pnl, last

    def _close(self, trade_id, price, closed, fee, venue_pnl, at, sign, asset):
        gained = None
        if self.cost is not None:
            if self.inverse:
                gained = times(times(closed, self.multiplier), q(ratio(Decimal(1), self.cost) - ratio(Decimal(1), price))) * -sign
            else:
                gained = times(times(closed, self.multiplier), price - self.cost) * -sign
        self.pnl = None if gained is None or self.pnl is None else self.pnl + gained
        self.venue = None if venue_pnl is None or self.venue is None else self.venue + venue_pnl
        self._charge(asset, fee)
        self.allocations.append((self.ordinal, trade_id, "close", closed, fee, gained))
        self.quantity = self.quantity + (closed if sign > 0 else -closed)
        if not self.quantity:
            self.cycles.append(self._summary(at, "closed"))
            self.paid.append(self.commissions)
            self.ordinal, self.cost = self.ordinal + 1, None
            self._clear()

    def _open(self, at, trade_id, price, opened, fee, venue_pnl, after_close, sign, asset):
        before = abs(self.quantity)
        after = before + opened
        if not before:
            self.cost, self.direction, self.opened = price, sign, at
        elif self.cost is not None:
            if self.inverse:
                self.cost = ratio(after, q(ratio(before, self.cost) + ratio(opened, price)))
            else:
                self.cost = ratio(times(before, self.cost) + times(opened, price), after)
        if not after_close and venue_pnl is None and self.track_venue:
            self.venue = None
        self._charge(asset, fee)
        self.allocations.append((self.ordinal, trade_id, "open", opened, fee, None))
        self.quantity = self.quantity + (opened if sign > 0 else -opened)

    def _summary(self, closed_at, status: str) -> tuple:
        return (self.ordinal, self.direction, self.opened, closed_at, self.pnl, self.fees, self.venue, status)

    def open_cycle(self):
        return [self._summary(None, "open")] if self.quantity else []

    def checkpoint(self) -> str:
        number = lambda x: None if x is None else str(x)
        state = {k: number(getattr(self, k)) for k in ("quantity", "cost", "multiplier", "pnl", "venue")}
        state |= {k: getattr(self, k) for k in ("inverse", "hedge", "ordinal", "unknown", "direction", "track_venue")}
        state["commissions"] = {k: str(v) for k, v in self.commissions.items()}
        state["opened"] = None if self.opened is None else pd.Timestamp(self.opened).isoformat()
        state["last"] = None if self.last is None else [pd.Timestamp(self.last[0]).isoformat(), self.last[1]]
        return json.dumps({"protocol": PROTOCOL, "state": state}, sort_keys=True)

    @classmethod
    def resumed(cls, checkpoint: str) -> Book:
        found = json.loads(checkpoint)
        if found.get("protocol") != PROTOCOL:
            raise ValueError("book_checkpoint_of_another_protocol")
        state, number = found["state"], lambda x: None if x is None else Decimal(x)
        book = cls(number(state["quantity"]), number(state["cost"]), number(state["multiplier"]), state["inverse"], state["hedge"])
        book.pnl, book.venue = number(state["pnl"]), number(state["venue"])
        for name in ("ordinal", "unknown", "direction", "track_venue"):
            setattr(book, name, state[name])
        book.commissions = {k: Decimal(v) for k, v in state["commissions"].items()}
        book.opened = state["opened"] and pd.Timestamp(state["opened"])
        book.last = state["last"] and (pd.Timestamp(state["last"][0]), state["last"][1])
        return book


STEPS = "row string, ordinal int, trade_id long, kind string, quantity string, fee string, direction string, opened_at timestamp_ntz, closed_at timestamp_ntz, pnl string, fees string, commissions map<string,string>, status string, checkpoint string"


KINDS = ("cycle", "allocation", "checkpoint")
#: Numbers of a fill, and what stands for a missing one among whole numbers.
NUMBERS, ABSENT = ("price", "quantity", "fee"), -(1 << 63)


def books(fills: DataFrame, checkpoints: DataFrame | None = None, key: str = "symbol", kinds: tuple = KINDS) -> DataFrame:
    """One fold of every book in strict order of (time, trade id): rows of kind `cycle` (closed, and the one
    still open), `allocation` (parts of fills that opened or closed a cycle) and `checkpoint` (one a book).
    checkpoints: key, checkpoint of an earlier fold; fills before them must not come again. fills may have
    fee_asset. kinds: the rows that are written out."""
    kind = fills.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in STEPS.split(", "))]
    asset = F.col("fee_asset") if "fee_asset" in fills.columns else F.lit("")
    # Short decimals travel as whole numbers of their last place, which Python takes many times faster.
    places = {c: fills.schema[c].dataType.scale for c in NUMBERS if isinstance(fills.schema[c].dataType, T.DecimalType) and fills.schema[c].dataType.precision <= 18}
    sent = [F.coalesce((F.col(c) * 10 ** places[c]).cast("long"), F.lit(ABSENT)).alias(c) if c in places else F.col(c) for c in NUMBERS]
    rows = fills.select(key, "at", "trade_id", "side", *sent, asset.alias("fee_asset"), F.lit(None).cast("string").alias("checkpoint"))
    if checkpoints is not None:
        nulls = [F.lit(ABSENT if c in places else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:-1]]
        rows = rows.unionByName(checkpoints.select(key, *nulls, "checkpoint"))
    text = lambda x: None if x is None else plain(x)
    nothing = [None] * 8

    def column(pdf: pd.DataFrame, name: str) -> list:
        if name in places:
            unit = Decimal(1).scaleb(-places[name])
            return [None if x == ABSENT else Decimal(x) * unit for x in pdf[name].tolist()]
        return list(pdf[name].dt.to_pydatetime()) if pd.api.types.is_datetime64_any_dtype(pdf[name]) else pdf[name].tolist()

    class Fold:
        def __init__(self, found):
            self.key, self.book = found[0], Book()

        def _cycle(self, c, commissions) -> tuple:
            ordinal, direction, opened, closed, pnl, fees, _, status = c
            return (self.key, "cycle", ordinal, None, None, None, None, "long" if direction > 0 else "short", opened, closed, text(pnl), text(fees), {k: plain(v) for k, v in commissions.items()}, status, None)

        def _taken(self) -> list[tuple]:
            book, out = self.book, []
            if "cycle" in kinds:
                out += [self._cycle(*c) for c in zip(book.cycles, book.paid, strict=True)]
            if "allocation" in kinds:
                out += [(self.key, "allocation", o, t, k, plain(n), plain(fee), *nothing) for o, t, k, n, fee, _ in book.allocations]
            book.cycles, book.paid, book.allocations = [], [], []
            return out

        def push(self, pdf: pd.DataFrame) -> list[tuple]:
            if "allocation" not in kinds and not pdf["checkpoint"].notna().any():
                self.book.run(*(column(pdf, c) for c in ("at", "trade_id", "side", "price", "quantity", "fee", "fee_asset")))
                return self._taken()
            columns = (column(pdf, c) for c in ("checkpoint", "at", "trade_id", "side", "price", "quantity", "fee", "fee_asset"))
            for checkpoint, at, trade_id, side, price, quantity, fee, asset in zip(*columns, strict=True):
                if checkpoint is not None:  # sorted before the fills
                    self.book = Book.resumed(checkpoint)
                else:
                    self.book.fill(at, int(trade_id), side, price, quantity, fee, asset=asset)
            return self._taken()

        def done(self) -> list[tuple]:
            still = [self._cycle(c, self.book.commissions) for c in self.book.open_cycle()] if "cycle" in kinds else []
            state = [(self.key, "checkpoint", *[None] * 12, self.book.checkpoint())] if "checkpoint" in kinds else []
            return [*self._taken(), *still, *state]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=names)
        for c in ("ordinal", "trade_id"):
            found[c] = found[c].astype("Int64")
        for c in ("opened_at", "closed_at"):
            found[c] = pd.to_datetime(found[c])
        return found

    return folded(rows, [key], ["at", "trade_id"], Fold, f"{key} {kind}, {STEPS}", frame)


def cycles_of(steps: DataFrame, key: str = "symbol") -> DataFrame:
    return steps.where("row = 'cycle'").select(key, "ordinal", "direction", "opened_at", "closed_at", "pnl", "fees", "commissions", "status")


def allocations_of(steps: DataFrame, key: str = "symbol") -> DataFrame:
    return steps.where("row = 'allocation'").select(key, "ordinal", "trade_id", "kind", "quantity", "fee")


def checkpoints_of(steps: DataFrame, key: str = "symbol") -> DataFrame:
    return steps.where("row = 'checkpoint'").select(key, "checkpoint")


def positions(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """Cycles of each book."""
    return cycles_of(books(fills, key=key, kinds=("cycle",)), key)


@F.pandas_udf(T.StringType())
def _share(fee: pd.Series, closed: pd.Series, quantity: pd.Series, kind: pd.Series) -> pd.Series:
    """The part of a fee, as a book divides it; null where a fill is in one part (closed is null)."""

    def one(fee, closed, quantity, kind):
        if closed is None:
            return None
        part = ratio(times(fee, closed), quantity)
        return plain(part if kind == "close" else fee - part)

    return pd.Series([one(*x) for x in zip(fee, closed, quantity, kind, strict=True)], dtype=object)


def held(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """fills with what each does to the position of its book, by running sums: ordinal (of the cycle it meets), before (position), closed and opened
    (quantities), ends (whether it ends that cycle; what it opens then belongs to the next). As in a book, (time, trade id) must rise."""
    order = W.partitionBy(key).orderBy("at", "trade_id")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.coalesce("quantity", F.raise_error(F.lit("fill_without_quantity")).cast(fills.schema["quantity"].dataType))
    delta = F.when(F.col("side") == "BUY", n).otherwise(-n)
    again = (F.col("at") == F.lag("at").over(order)) & (F.col("trade_id") == F.lag("trade_id").over(order))
    known = fills.withColumn("_delta", F.when(again, F.raise_error(F.lit("fill_order_unproven")).cast(fills.schema["quantity"].dataType)).otherwise(delta))
    known = known.withColumn("before", F.sum("_delta").over(upto) - F.col("_delta"))
    against = (F.col("before") != 0) & ((F.col("before") > 0) != (F.col("_delta") > 0))
    known = known.withColumn("closed", F.when(against, F.least(F.col("quantity"), F.abs("before"))).otherwise(F.lit(0)))
    known = known.withColumn("opened", F.col("quantity") - F.col("closed")).withColumn("ends", (F.col("closed") > 0) & (F.col("closed") == F.abs("before")))
    ended = F.sum(F.col("ends").cast("int")).over(upto) - F.col("ends").cast("int")
    return known.withColumn("ordinal", ended.cast("int")).drop("_delta")


def spans(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """When each cycle of a book was opened and closed, and its direction: what positions() gives, without costs."""
    known = held(fills.select(key, "at", "trade_id", "side", "quantity"), key)
    own, begins = F.col("ordinal") + F.col("ends").cast("int"), (F.col("opened") > 0) & ((F.col("before") == 0) | F.col("ends"))
    first = F.struct(own.alias("ordinal"), F.when(F.col("side") == "BUY", "long").otherwise("short").alias("direction"), F.col("at").alias("opened_at"), F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    last = F.struct("ordinal", F.lit(None).cast("string").alias("direction"), F.lit(None).cast("timestamp_ntz").alias("opened_at"), F.col("at").alias("closed_at"))
    edges = known.select(key, F.explode(F.filter(F.array(F.when(begins, first), F.when(F.col("ends"), last)), lambda x: x.isNotNull())).alias("_e")).select(key, "_e.*")
    found = edges.groupBy(key, "ordinal").agg(F.max("direction").alias("direction"), F.max("opened_at").alias("opened_at"), F.max("closed_at").alias("closed_at"))
    return found.withColumn("status", F.when(F.col("closed_at").isNull(), "open").otherwise("closed"))


def allocations(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """Parts of fills that opened or closed each cycle: those of books(), by running sums. Only a fee that a fill in two parts divides is
    worked out in Python, as a book does it, and only if it is asked for."""
    known = held(fills.select(key, "at", "trade_id", "side", "quantity", "fee"), key)
    kinds = F.array(F.when(F.col("closed") > 0, "close"), F.when(F.col("opened") > 0, "open"))
    parts = known.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    closes, both = F.col("kind") == "close", (F.col("closed") > 0) & (F.col("opened") > 0)
    share = _share("fee", F.when(both, F.col("closed")), "quantity", "kind")
    return parts.select(
        key,
        F.when(closes, F.col("ordinal")).otherwise(F.col("ordinal") + F.col("ends").cast("int")).alias("ordinal"),
        "trade_id",
        "kind",
        trimmed(F.when(closes, F.col("closed")).otherwise(F.col("opened")).cast("string")).alias("quantity"),
        F.coalesce(share, trimmed(F.col("fee").cast("string"))).alias("fee"),
    )


def cycle_totals(parts: DataFrame, fills: DataFrame, key: str = "symbol") -> DataFrame:
    """Opened and closed quantity and volume-weighted exit price of each cycle."""
    priced = parts.join(fills.select(key, "trade_id", "price"), [key, "trade_id"])
    n = F.col("quantity").cast("decimal(18,4)")
    sum_if = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    exit_price = F.try_divide(sum_if("close", (n * F.col("price")).cast("double")), F.nullif(sum_if("close", n).cast("double"), F.lit(0.0)))
    return priced.groupBy(key, "ordinal").agg(sum_if("open", n).cast("double").alias("opened"), sum_if("close", n).cast("double").alias("closed"), exit_price.alias("exit_vwap"))


def cycle_list(cycles: DataFrame, start=None, end=None, direction: str | None = None, status: str | None = None) -> DataFrame:
    """Cycles that overlap [start, end); open ones last for ever."""
    out = cycles
    if start is not None:
        out = out.where((F.col("opened_at") < end) & F.coalesce(F.col("closed_at") > start, F.lit(True)))
    if direction:
        out = out.where(F.col("direction") == direction)
    return out.where(F.col("status") == status) if status else out


def asset_totals(pnl: DataFrame, fees: DataFrame, funding: DataFrame) -> DataFrame:
    """Amounts by asset of three sources (asset, amount), and how many are missing."""
    both = pnl.unionByName(fees).unionByName(funding)
    return both.groupBy("asset").agg(F.sum("amount").alias("amount"), F.count("amount").alias("n"), F.count_if(F.col("amount").isNull()).alias("n_missing"))


def add_totals(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored totals with those of newly inserted rows added."""
    return stored.unionByName(fresh).groupBy("asset").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"))


def reconcile(ledger: DataFrame, statement: DataFrame, tolerance: float, coverage: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Per asset: our amount against the statement's within a tolerance. Missing amounts and assets that
    only one side has do not match; without proof of coverage nothing is verified. coverage and requests:
    see bars.covers, keyed by asset."""
    ours = ledger.select("asset", F.col("amount").alias("ours"), F.col("n_missing"))
    theirs = statement.select("asset", F.col("amount").alias("theirs"))
    both = ours.join(theirs, "asset", "full_outer")
    ok = F.coalesce((F.col("n_missing") == 0) & (F.abs(F.col("ours") - F.col("theirs")) <= tolerance), F.lit(False))
    if coverage is not None:
        proof = covers(coverage, requests, ["asset"]).groupBy("asset").agg(F.every("covered").alias("covered"))
        both = both.join(proof, "asset", "left")
        covered = F.coalesce("covered", F.lit(False))
    else:
        covered = F.lit(True)
    status = F.when(~covered, "unverified_coverage").when(ok, "matched_declared_range").otherwise("differences")
    return both.select("asset", "ours", "theirs", status.alias("status"))


def current_links(links: DataFrame) -> DataFrame:
    """Execution links that no later link supersedes."""
    gone = links.where("supersedes is not null").select(F.col("supersedes").alias("link_id"))
    return links.join(gone, "link_id", "left_anti")


def month_quota(exports: DataFrame, now: Column, most: int) -> DataFrame:
    """Exports of each owner in the calendar month, and what is left of the quota."""
    inside = F.date_trunc("month", F.col("requested_at")) == F.date_trunc("month", now)
    return exports.groupBy("owner").agg(F.count_if(inside).alias("used")).withColumn("left", F.greatest(F.lit(0), most - F.col("used")))
