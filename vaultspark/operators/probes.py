"""Golden probes: whether a vault still answers what it has to answer. A probe passes, fails, or is invalid."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.operators.base import checkpointed
from vaultspark.operators.structured import TIERS, recent, tier_rank

#: What a probe of each class has to name.
NEEDS = {"decision_state": ("query",), "currency": ("anchor_id",), "freshness": ("max_age_days",), "tension": ("query", "anchor_id")}


def chain_states(notes: DataFrame, anchors: DataFrame, *, max_tier: str = TIERS[-1], hops: int = 8) -> DataFrame:
    """(anchor, status, head, hops) of each anchor (column anchor): 'head', 'missing', 'broken', 'withheld' or 'corrupt'.

    Successors are followed for at most `hops` links, a join for all anchors at once; those that have ended leave the
    join. Cycles and longer chains are corrupt, a missing successor is a broken chain."""
    known = notes.select(F.col("id").alias("at"), F.lit(True).alias("known"), F.when(F.col("superseded_by") != "", F.col("superseded_by")).alias("next"), (tier_rank("classification") > TIERS.index(max_tier)).alias("withheld"))
    front = anchors.select("anchor").distinct().select("anchor", F.col("anchor").alias("at"), F.array().cast("array<string>").alias("seen"))
    done = None
    for hop in range(hops + 1):
        status = (
            F.when(F.array_contains("seen", F.col("at")), "corrupt")
            .when(F.col("known").isNull(), "missing" if hop == 0 else "broken")
            .when(F.col("withheld"), "withheld")
            .when(F.col("next").isNull(), "head")
            .when(F.lit(hop == hops), "corrupt")
        )
        step = checkpointed(front.join(known, "at", "left").withColumn("status", status))
        ended = step.filter("status IS NOT NULL").select("anchor", "status", F.when(F.col("status") == "head", F.col("at")).alias("head"), F.lit(hop).alias("hops"))
        done = ended if done is None else done.unionByName(ended)
        front = step.filter("status IS NULL").select("anchor", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        if front.isEmpty():
            break
    return done


def score(results: DataFrame, *, threshold: float = 1.0) -> DataFrame:
    """(score, disposition, probes) of results (status, weight): the passed weight over that of what passed or failed.

    Below the threshold it is a regression; else invalid probes, or none that could be scored, need action."""
    weight = lambda *names: F.sum(F.when(F.col("status").isin(*names), F.col("weight").cast("double")))
    found = results.agg(F.coalesce(weight("pass"), F.lit(0.0)).alias("passed"), weight("pass", "fail").alias("scored"), F.count_if(F.col("status") == "invalid").alias("invalid"), F.count(F.lit(1)).alias("probes"))
    value = F.round(F.when(F.col("scored") > 0, F.col("passed") / F.col("scored")), 4)
    disposition = F.when(value < threshold - 1e-9, "regression").when(value.isNull() | (F.col("invalid") > 0), "action_required").otherwise("ok")
    return found.select(value.alias("score"), disposition.alias("disposition"), "probes")


def currency(notes: DataFrame, anchors: DataFrame, *, max_tier: str = TIERS[-1]) -> DataFrame:
    """(anchor, status, head, hops): pass if an anchor's chain ends at a note that isn't retired."""
    states = chain_states(notes, anchors, max_tier=max_tier)
    heads = states.filter("head IS NOT NULL").join(notes.select(F.col("id").alias("head"), "is_latest_version"), "head", "left")
    rows = states.join(heads.select("anchor", F.lower("is_latest_version").alias("latest")), "anchor", "left")
    stale = F.col("latest").eqNullSafe("false")
    status = F.when(F.col("status").isin("missing", "corrupt"), "invalid").when((F.col("status") != "head") | stale, "fail").otherwise("pass")
    return rows.select("anchor", status.alias("status"), "head", F.col("hops").cast("long").alias("hops"))


def freshness(notes: DataFrame, today: str, max_age_days: int, *, max_tier: str = TIERS[-1], last: int = 200) -> tuple[str, str]:
    """(status, reason) by the newest dated note among the last changed ones that the tier may see."""
    seen = recent(notes, last).filter(tier_rank("classification") <= TIERS.index(max_tier))
    day = F.try_to_date(F.substring("updated", 1, 10))
    row = seen.select(F.datediff(F.to_date(F.lit(today)), day).alias("age")).filter("age >= 0").agg(F.min("age").alias("age")).first()
    if row["age"] is None:
        return "fail", "no dated note"
    return ("pass" if row["age"] <= max_age_days else "fail"), f"newest note is {row['age']} days old"


def run_probes(vault, probes: list[dict], *, today: str, threshold: float = 1.0, k: int = 12, max_tier: str = TIERS[-1], dossier: Callable | None = None) -> DataFrame:
    """(probe, class, status, weight, reason, score, disposition): a row per probe, with the run's score and disposition (see score)."""
    dossier = dossier or (lambda query: vault.dossier(query, k=k, max_tier=max_tier))
    notes, spark = vault.notes, vault.spark
    wanted = [p for p in probes if not _fault(p)]
    anchors = sorted({p["anchor_id"] for p in wanted if p.get("anchor_id")})
    chains = {r["anchor"]: r for r in currency(notes, spark.createDataFrame([(a,) for a in anchors], "anchor string"), max_tier=max_tier).collect()} if anchors else {}
    out = []
    for p in probes:
        fault = _fault(p)
        status, reason = ("invalid", fault) if fault else _judge(p, notes, chains, dossier, today, max_tier)
        out.append((str(p.get("id", "?")), str(p.get("class", "?")), status, float(p.get("weight", 1.0)) if not fault else 1.0, reason))
    rows = spark.createDataFrame(out, "probe string, class string, status string, weight double, reason string")
    return rows.crossJoin(F.broadcast(score(rows, threshold=threshold).drop("probes")))


def _fault(p: dict) -> str | None:
    """What makes a probe impossible to judge."""
    if p.get("class") not in NEEDS:
        return f"unknown class {json.dumps(p.get('class'))}"
    missing = [n for n in NEEDS[p["class"]] if p.get(n) is None]
    if missing:
        return "missing " + ", ".join(missing)
    weight = p.get("weight", 1.0)
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not weight > 0:
        return "weight has to be over zero"
    if p["class"] == "decision_state" and not p.get("anchor_id") and not p.get("claim_any"):
        return "anchor_id or claim_any is needed"
    return None


def _judge(p: dict, notes: DataFrame, chains: dict, dossier: Callable, today: str, max_tier: str) -> tuple[str, str]:
    if p["class"] == "freshness":
        return freshness(notes, today, int(p["max_age_days"]), max_tier=max_tier)
    claims = [c.strip().lower() for c in p.get("claim_any") or []]
    chain = chains.get(p.get("anchor_id"))
    if p["class"] == "currency":
        return chain["status"], f"{chain['hops']} hops to {chain['head']}"
    if chain is not None and chain["head"] is None:  # a lost anchor of a decision may still be found by its claim
        if chain["status"] == "fail" or p["class"] == "tension" or not claims:
            return chain["status"], "the anchor's chain has no head"
    head = chain["head"] if chain is not None else None
    decisions = {r["id"]: r["tensions"] for r in dossier(p["query"]).filter("part = 'decision'").collect()}
    if head is not None:
        if head not in decisions:
            return "fail", f"{head} is not among {len(decisions)} decisions"
        if p["class"] == "tension":
            return ("pass" if decisions[head] else "fail"), f"{decisions[head] or 0} newer sources"
        return "pass", f"{head} is a decision of the answer"
    text = F.lower(F.concat_ws(" ", "title", "body"))
    hit = F.lit(False)
    for c in claims:
        hit = hit | F.contains(text, F.lit(c))
    found = notes.filter(F.col("id").isin(sorted(decisions)) & hit).agg(F.min("id").alias("id")).first()["id"] if decisions else None
    return ("pass", f"{found} carries the claim") if found else ("fail", "no decision carries the claim")
