"""Formal statistics over frozen samples, and episodes of calls."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions.text import canonical_json, digest
from quillbar.operators.relational import counts_of, exact_median, first_by, optional
from quillbar.operators.rules import STATES


def exclusion(voided: Column, historical: Column, unconfirmed: Column, formation: Column, criteria: Column, confirmed: Column) -> Column:
    """The first reason that keeps a sample out, or null."""
    return (
        F.when(voided, "voided")
        .when(historical, "historical_unverified")
        .when(unconfirmed, "episode_unconfirmed")
        .when(formation, "formation_not_subsequent_validation")
        .when(criteria.isNull(), "no_criteria")
        .when(~confirmed, "criteria_unconfirmed")
    )


@dataclass
class SampleFilters:
    """Optional filters of a frozen sample; None leaves a column open. Times are columns or literals."""

    start_at: Column | None = None
    end_at: Column | None = None
    instrument: str | None = None
    market: str | None = None
    timeframe: str | None = None
    path: str | None = None
    stance: str | None = None
    source_entry: str | None = None
    tag_id: str | None = None
    tag_phase: str | None = None
    playbook_id: str | None = None
    adoption: str | None = None
    result_states: tuple[str, ...] = ()

    def __post_init__(self):
        if self.tag_phase not in (None, "hot", "cold") or self.adoption not in (None, "planned", "executed", "not_executed", "unknown") or not set(self.result_states) <= set(STATES):
            raise ValueError("invalid_sample_filter")


@dataclass
class SampleSources:
    """Tables that only filters and exclusion reasons ask for. tags: call_id, tag_id, phase; adoptions: call_id,
    playbook_id; playbooks: playbook_id, created_at, evidence_call_ids; executions: link_id, call_id, relation,
    supersedes; assessments: call_id, claim_no, state."""

    tags: DataFrame | None = None
    adoptions: DataFrame | None = None
    playbooks: DataFrame | None = None
    executions: DataFrame | None = None
    assessments: DataFrame | None = None


def sample_calls(calls: DataFrame, filters: SampleFilters, sources: SampleSources) -> DataFrame:
    """The calls that pass every filter that is given: comparisons, and semi-joins on call_id."""
    out = calls
    if filters.start_at is not None:
        out = out.where(F.col("submitted_at") >= filters.start_at)
    if filters.end_at is not None:
        out = out.where(F.col("submitted_at") < filters.end_at)
    out = optional(out, **{k: getattr(filters, k) for k in ("instrument", "market", "timeframe", "path", "stance", "source_entry")})
    if filters.tag_id is not None:
        out = out.join(optional(sources.tags, tag_id=filters.tag_id, phase=filters.tag_phase).select("call_id"), "call_id", "left_semi")
    if filters.playbook_id is not None:
        out = out.join(sources.adoptions.where(F.col("playbook_id") == filters.playbook_id).select("call_id"), "call_id", "left_semi")
    if filters.adoption == "planned":
        out = out.join(sources.adoptions.select("call_id"), "call_id", "left_semi")
    elif filters.adoption == "unknown":
        known = sources.executions.where(F.col("relation").isin("executed", "rejected")).select("call_id")
        out = out.join(known, "call_id", "left_anti")
    elif filters.adoption:
        replaced = sources.executions.where("supersedes is not null").select(F.col("supersedes").alias("link_id"))
        wanted = "executed" if filters.adoption == "executed" else "rejected"
        current = sources.executions.join(replaced, "link_id", "left_anti").where(F.col("relation") == wanted)
        out = out.join(current.select("call_id"), "call_id", "left_semi")
    return out


def formation_cases(calls: DataFrame, playbook_id: str, sources: SampleSources) -> DataFrame:
    """call_id of adopting calls that formed the playbook: its evidence, or submitted before it was made."""
    book = sources.playbooks.where(F.col("playbook_id") == playbook_id).select("created_at", "evidence_call_ids")
    adopted = sources.adoptions.where(F.col("playbook_id") == playbook_id).select("call_id").distinct()
    both = calls.select("call_id", "submitted_at").join(adopted, "call_id").crossJoin(F.broadcast(book.limit(1)))  # one playbook
    return both.where(F.array_contains("evidence_call_ids", F.col("call_id")) | (F.col("submitted_at") <= F.col("created_at"))).select("call_id")


def rule_signature(criteria: dict[str, Column], instrument: Column, market: Column) -> Column:
    """sha256 of the canonical JSON of a rule without who selected it, where it applies, and the policies."""
    rule = canonical_json({k: v for k, v in criteria.items() if k != "selected_by"})
    return digest({"criteria": rule, "instrument": instrument, "market": market, "calendar": F.lit("natural_hours"), "price_policy": F.lit("asof_last_eligible_trade")})


def freeze(calls: DataFrame, links: DataFrame, claims: DataFrame, heads: DataFrame | None, filters: SampleFilters | None = None, sources: SampleSources | None = None, grouping: str = "episode_rule") -> DataFrame:
    """Members of a sample: calls with their latest episode link and claims (claim 0 where there is none),
    the head outcome of each, eligibility and representatives. Calls: call_id, submitted_at, voided and, if
    known, historical and the columns that filters name. Links: call_id, episode_id, status, created_at,
    link_id. Claims: call_id, claim_no, signature (null: no criteria). Heads: call_id, claim_no, state; None where
    claims carry their state.
    Groups are episodes that are not only suggested, or calls."""
    filters, sources = filters or SampleFilters(), sources or SampleSources()
    by_episode = F.lit(grouping == "episode_rule")
    chosen = sample_calls(calls, filters, sources)
    latest = first_by(links, ["call_id"], [F.desc("created_at"), F.desc("link_id")]).select("call_id", "episode_id", F.col("status").alias("link_status"))
    formed = F.lit(False)
    base = chosen.join(latest, "call_id", "left").join(claims, "call_id", "left")
    if filters.playbook_id is not None and sources.playbooks is not None:
        cases = formation_cases(chosen, filters.playbook_id, sources).distinct().withColumn("_formed", F.lit(True))
        base, formed = base.join(cases, "call_id", "left"), F.coalesce("_formed", F.lit(False))
    base = base.withColumn("claim_no", F.coalesce("claim_no", F.lit(0)))
    joined = base if heads is None else base.join(heads, ["call_id", "claim_no"], "left")
    confirmed = F.lit(True)
    if sources.assessments is not None:
        joined = joined.join(sources.assessments.select("call_id", "claim_no", F.col("state").alias("processing_state")), ["call_id", "claim_no"], "left")
        confirmed = ~F.coalesce(F.col("processing_state") == "awaiting_input", F.lit(False))
    historical = F.coalesce("historical", F.lit(False)) if "historical" in calls.columns else F.lit(False)
    suggested = by_episode & F.coalesce(F.col("link_status") == "suggested", F.lit(False))
    reason = exclusion(F.col("voided"), historical, suggested, formed, F.col("signature"), confirmed)
    wanted = F.col("state").isin(*filters.result_states) if filters.result_states else F.lit(True)
    found = joined.withColumn("exclusion", reason).withColumn("eligible", F.col("exclusion").isNull())
    if grouping != "episode_rule":
        found = found.withColumn("episode_id", F.lit(None).cast(found.schema["episode_id"].dataType))
    found = found.drop("_formed") if "_formed" in found.columns else found
    return representatives(found).withColumn("selected", F.col("selected") & F.coalesce(wanted, F.lit(False)))


def representatives(members: DataFrame) -> DataFrame:
    """selected: the first eligible member of its (episode or call, signature)."""
    group = F.coalesce(F.col("episode_id"), -F.col("call_id"))
    order = W.partitionBy(group, "signature", "eligible").orderBy("submitted_at", "call_id", "claim_no")
    return members.withColumn("selected", F.col("eligible") & (F.row_number().over(order) == 1))


def with_ordinal(members: DataFrame) -> DataFrame:
    """Members numbered in order of (submitted_at, call_id, claim_no): ranges are numbered apart and
    shifted by the sizes before them, so no task orders everything."""
    day = F.col("submitted_at").cast("date")
    sizes = members.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_day").orderBy("submitted_at", "call_id", "claim_no"))
    dealt = members.withColumn("_day", day).withColumn("_w", within)
    return dealt.join(F.broadcast(sizes.select("_day", before.alias("_before"))), "_day").withColumn("ordinal", F.col("_before") + F.col("_w")).drop("_day", "_w", "_before")


def counts(members: DataFrame) -> DataFrame:
    """One row of counts of a frozen sample."""
    group = F.coalesce(F.col("episode_id"), -F.col("call_id"))
    return members.agg(F.count(F.lit(1)).alias("n_members"), F.count_if("eligible").alias("n_eligible"), F.count_if("selected").alias("n_selected"), F.countDistinct("call_id").alias("n_calls"), F.countDistinct(group).alias("n_groups"), F.countDistinct("signature").alias("n_signatures"))


def state_histogram(members: DataFrame) -> DataFrame:
    return counts_of(members.where("selected"), "state", STATES)


def processing_histogram(members: DataFrame) -> DataFrame:
    """Members by the state of their assessment; `absent` where there is none."""
    return members.groupBy(F.coalesce("processing_state", F.lit("absent")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def group_metrics(members: DataFrame) -> DataFrame:
    """For each signature of selected members: wins, settled, rate, the same of the ten latest settled,
    and whether the rate has fallen by a fifth and asks for a recheck (exact, in integers)."""
    settled = members.where("selected and state in ('realized', 'unrealized')")
    late = W.partitionBy("signature").orderBy(F.desc("submitted_at"), F.desc("call_id"), F.desc("claim_no"))
    ranked = settled.withColumn("_r", F.row_number().over(late))
    won = F.col("state") == "realized"
    n, w = F.count(F.lit(1)), F.count_if(won)
    found = ranked.groupBy("signature").agg(n.alias("n"), w.alias("wins"), F.count_if(F.col("_r") <= 10).alias("recent_n"), F.count_if((F.col("_r") <= 10) & won).alias("recent_wins"))
    recheck = (F.col("recent_n") == 10) & (F.col("wins") * 10 - F.col("recent_wins") * F.col("n") >= F.col("n") * 2)
    return found.select("*", F.try_divide("wins", "n").alias("rate"), F.try_divide("recent_wins", "recent_n").alias("recent_rate"), recheck.alias("recheck"))


def excursion_medians(members: DataFrame) -> DataFrame:
    """Exact medians of mfe and mae of each signature."""
    long = members.where("selected").unpivot(["signature"], ["mfe", "mae"], "measure", "value")
    return exact_median(long, ["signature", "measure"], "value")


def trigger_days(members: DataFrame, at: str) -> DataFrame:
    return members.where(F.col(at).isNotNull()).groupBy("signature", F.date_trunc("day", F.col(at)).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def verdict_status(n: Column) -> Column:
    return F.when(n < 20, "insufficient").when(n % 20 == 0, "verdict_due").otherwise("observing")


def verdicts_due(groups: DataFrame, decided: DataFrame, pending: DataFrame) -> DataFrame:
    """Groups with 20 settled samples more than at their last verdict, and none pending."""
    last = decided.groupBy("signature").agg(F.max("n_decided").alias("last_n"))
    grown = groups.join(last, "signature", "left").where(F.col("n") >= F.coalesce("last_n", F.lit(0)) + 20)
    return grown.join(pending.select("signature"), "signature", "left_anti")


def hit_rate(records: DataFrame, dimension: Column, outcome: str, confidence: str) -> DataFrame:
    """right, wrong, void, rate in per cent of right and wrong, mean confidence of each value of a
    dimension; those without value are unclassified."""
    keyed = records.withColumn("dimension", F.coalesce(dimension, F.lit("unclassified")))
    found = keyed.groupBy("dimension").agg(*[F.count_if(F.col(outcome) == k).alias(k) for k in ("right", "wrong", "void")], F.avg(confidence).alias("mean_confidence"))
    return found.withColumn("rate", F.round(F.try_divide(F.lit(100.0) * F.col("right"), F.col("right") + F.col("wrong"))))


def confidence_calibration(records: DataFrame, outcome: str, confidence: str) -> DataFrame:
    """Rate of right of each confidence bucket of ten, 50 to 90."""
    bucket = F.least(F.greatest(F.floor(F.col(confidence) / 10) * 10, F.lit(50)), F.lit(90)).cast("int")
    judged = records.where(F.col(outcome).isin("right", "wrong"))
    return judged.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(F.col(outcome) == "right"), F.count(F.lit(1))).alias("rate"))


def baseline_origins(claims: DataFrame, bars: DataFrame, days: int = 250) -> DataFrame:
    """For each T1 claim the closes at the same minute 1 to `days` days before it and after the horizon:
    base and end price of samples that end before submission. claims: claim_id, symbol, submitted_at,
    horizon_hours; bars: symbol, end, close. Days before a symbol's first bar are not asked for."""
    since = bars.groupBy("symbol").agg(F.min("end").alias("_first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back = F.least(F.lit(days), F.floor((micros("submitted_at") - micros("_first")) / 86_400_000_000).cast("int"))
    known = claims.join(since, "symbol").withColumn("_back", back).where("_back >= 1").drop("_first")
    day = F.explode(F.sequence(F.lit(1), F.col("_back")))
    asked = known.withColumn("day", day).drop("_back").withColumn("origin", F.col("submitted_at") - F.make_dt_interval(F.col("day")))
    asked = asked.withColumn("until", F.col("origin") + F.make_dt_interval(F.lit(0), F.col("horizon_hours"))).where(F.col("until") < F.col("submitted_at"))
    price = bars.select("symbol", F.col("end").alias("_at"), F.col("close"))
    first = asked.join(price, (asked["symbol"] == price["symbol"]) & (F.col("origin") == F.col("_at"))).select(asked["claim_id"], asked["symbol"], "day", "until", F.col("close").alias("base"))
    return first.join(price, (first["symbol"] == price["symbol"]) & (F.col("until") == F.col("_at"))).select("claim_id", first["symbol"], "day", "base", F.col("close").alias("end_price"))


def baseline_rate(samples: DataFrame, least_return: float | None = None) -> DataFrame:
    """Share of a claim's historical samples that gained at least what the rule asks for: a ratio of the base,
    or, without one, `atr` times `atr_multiple` of each sample (daily ATR14 as of its origin); short rules gain
    by falling. Claims weigh alike."""
    gained = F.col("end_price") - F.col("base")
    if "direction" in samples.columns:
        gained = F.when(F.col("direction") == "S", -gained).otherwise(gained)
    won = gained >= (F.col("base") * least_return if least_return is not None else F.col("atr") * F.col("atr_multiple"))
    each = samples.groupBy("claim_id").agg(F.count_if(won).alias("wins"), F.count(F.lit(1)).alias("n"))
    return each.withColumn("rate", F.try_divide("wins", "n"))


EPISODE_HOURS = 120


def episodes(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Episode of each call: that of the latest anchor at most 120 hours before, else a new one that the
    call anchors (explicit; later calls are suggested). The chain of anchors is sequential: partitions sorted
    by key and time are folded as they stream by."""
    hours = pd.Timedelta(hours=EPISODE_HOURS)

    def run(batches):
        last, anchor, number = None, None, -1
        for pdf in batches:
            out = []
            for key, at in zip(pdf[keys].itertuples(index=False, name=None), pdf["submitted_at"], strict=True):
                if key != last:
                    last, anchor, number = key, None, -1
                new = anchor is None or at > anchor + hours
                if new:
                    anchor, number = at, number + 1
                out.append((number, anchor, "explicit" if new else "suggested"))
            extra = pd.DataFrame(out, columns=["episode_no", "anchor", "link_status"], index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    fields = ", ".join(f"{n} {t}" for n, t in calls.dtypes)
    known = calls.where(" and ".join(f"{k} is not null" for k in keys))
    ordered = known.repartition(*keys).sortWithinPartitions(*keys, "submitted_at", "call_id")
    return ordered.mapInPandas(run, f"{fields}, episode_no int, anchor timestamp_ntz, link_status string")


def review_bucket(draft: Column, reviewed_at: Column, outcome_at: Column, snoozed_until: Column, now: Column) -> tuple[Column, Column]:
    """(bucket, reason) of the review queue."""
    bucket = F.when(draft, "in_progress").when(reviewed_at.isNull() | (outcome_at > reviewed_at), "needs_review").otherwise("completed")
    effective = F.when((bucket == "needs_review") & (snoozed_until > now), "snoozed").otherwise(bucket)
    reason = F.when(draft, "draft").when(reviewed_at.isNull(), "never_reviewed").when(outcome_at > reviewed_at, "new_outcome")
    return effective, reason


def summarized(members: DataFrame) -> DataFrame:
    """Of an exploratory set: settled representatives of each signature, wins, rate and what is due."""
    settled = representatives(members).where("selected and state in ('realized', 'unrealized')")
    found = settled.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "realized").alias("wins"))
    return found.select("signature", "n", "wins", F.try_divide("wins", "n").alias("rate"), verdict_status(F.col("n")).alias("status"))


def collectable(records: DataFrame, references: DataFrame, before: Column, held: DataFrame | None = None) -> DataFrame:
    """Files that garbage collection could take: older than `before`, referred to by nothing and held by no
    open job; a report only. records: record_id, created_at; held: record_id."""
    free = deletion_closure(records.where(F.col("created_at") < before), references)
    return free if held is None else free.join(held.select("record_id").distinct(), "record_id", "left_anti")


def deletion_closure(records: DataFrame, references: DataFrame) -> DataFrame:
    """Records that nothing refers to: a report of what could go, nothing is deleted."""
    return records.join(references.select("record_id").distinct(), "record_id", "left_anti")
