"""Case work as set-based updates: a frame of requests meets a frame of cases or hits, and out comes the frame after.

A request that breaks a rule changes nothing; its `error` says why. Who acts and when are columns of the request.
Several requests for one row: the one with the largest time, then the largest actor, counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .history import EDGES

# Reasons that a disposition may give, and where a decision leads.
REASONS = ("confirmed_no_match", "confirmed_transliteration_variant", "confirmed_different_dob", "confirmed_true_match", "insufficient_evidence")
DECIDED = {"approve": "APPROVED", "reject": "REJECTED", "clear": "CLEARED"}
OPEN = ("PENDING_L1", "PENDING_L2", "ESCALATED")
LOADED = ("PENDING_L1", "PENDING_L2")
#: States that lead nowhere.
TERMINAL = tuple(sorted({b for to in EDGES.values() for b in to} - set(EDGES)))


def newest(requests: DataFrame, key: str) -> DataFrame:
    rest = [c for c in requests.columns if c not in (key, "at", "actor_id")]
    return requests.groupBy(key).agg(F.max(F.struct("at", "actor_id", *rest)).alias("r"))


def assign(cases: DataFrame, people: DataFrame) -> DataFrame:
    """cases with an assignee for each that has none: by tenant and role, round robin from the least loaded.

    people: tenant_id, user_id, role, active. High-risk cases go to senior reviewers, the others to analysts. A batch is
    dealt out by place, so that one person doesn't get all of it.
    """
    role = F.when(F.col("tier") == "high_risk", "senior_reviewer").otherwise("compliance_analyst")
    load = cases.where(F.col("state").isin(*LOADED) & F.col("assignee_id").isNotNull()).groupBy(F.col("tenant_id").alias("t"), F.col("assignee_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    ready = people.where("active").join(load, (F.col("tenant_id") == F.col("t")) & people["user_id"].eqNullSafe(load["user_id"]), "left").select("tenant_id", people["user_id"].alias("person"), "role", F.coalesce("n", F.lit(0)).alias("n"))
    team = W.partitionBy("tenant_id", "role")
    ready = ready.withColumn("seat", F.row_number().over(team.orderBy("n", "person")) - 1).withColumn("seats", F.count(F.lit(1)).over(team)).drop("n")
    waiting = cases.where("assignee_id is null").select("case_id", "tenant_id", role.alias("role"))
    waiting = waiting.withColumn("turn", F.row_number().over(team.orderBy("case_id")) - 1)
    teams = ready.select("tenant_id", "role", "seats").distinct()
    dealt = waiting.join(teams, ["tenant_id", "role"]).withColumn("seat", F.col("turn") % F.col("seats")).join(ready.drop("seats"), ["tenant_id", "role", "seat"]).select("case_id", "person")
    return cases.join(dealt, "case_id", "left").withColumn("assignee_id", F.coalesce("assignee_id", "person")).drop("person").select(*cases.columns)


def dispose(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """hits after requests (hit_id, tenant_id, disposition, reason, actor_id, at), with an error where one was refused."""
    joined = hits.join(newest(requests, "hit_id"), "hit_id", "left")
    r = lambda c: F.col(f"r.{c}")
    error = F.when(~r("reason").isin(*REASONS), "unknown reason").when(r("tenant_id") != F.col("tenant_id"), "other tenant")
    done = F.col("r").isNotNull() & error.isNull()
    return joined.select(
        "hit_id", "case_id", "tenant_id", "score", F.when(done, r("disposition")).otherwise(F.col("disposition")).alias("disposition"),
        F.when(done, r("reason")).otherwise(F.col("reason")).alias("reason"), F.when(F.col("r").isNotNull(), error).alias("error"))


def bulk_clear(hits: DataFrame, threshold: float | Column) -> DataFrame:
    """Pending hits below the threshold become false positives for want of evidence."""
    low = (F.col("score") < threshold) & (F.col("disposition") == "pending")
    return hits.withColumns({"disposition": F.when(low, "false_positive").otherwise(F.col("disposition")), "reason": F.when(low, "insufficient_evidence").otherwise(F.col("reason"))})


def decide(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """cases after decisions (case_id, decision, actor_id, second, at).

    Rejecting a high-risk case takes two people: the first decision only marks it, a second approval by someone else
    rejects it. First decisions belong to the assignee.
    """
    first = newest(decisions.where("not second"), "case_id").withColumnRenamed("r", "f")
    second = newest(decisions.where("second"), "case_id").withColumnRenamed("r", "s")
    j = cases.join(first, "case_id", "left").join(second, "case_id", "left")
    f, s = F.col("f"), F.col("s")
    wrong_person = f.isNotNull() & F.col("assignee_id").isNotNull() & (f["actor_id"] != F.col("assignee_id"))
    taken = f.isNotNull() & ~wrong_person
    dual = (F.col("tier") == "high_risk") & (F.coalesce(F.when(taken, f["decision"]), F.col("decision")) == "reject")
    by = F.when(taken, f["actor_id"]).otherwise(F.col("decided_by"))
    agreed = dual & s.isNotNull() & by.isNotNull() & (s["actor_id"] != by)
    error = (
        F.when(wrong_person, "not the assignee").when(s.isNotNull() & by.isNull(), "no first approval")
        .when(s.isNotNull() & dual & (s["actor_id"] == by), "same person twice")
    )
    table = F.create_map(*[F.lit(x) for kv in DECIDED.items() for x in kv])
    state = F.when(agreed, "REJECTED").when(taken & ~dual, table[f["decision"]]).otherwise(F.col("state"))
    return j.select(
        "case_id", "tenant_id", "tier", state.alias("state"), "assignee_id", F.when(taken, f["decision"]).otherwise(F.col("decision")).alias("decision"),
        by.alias("decided_by"), F.when(agreed, s["actor_id"]).alias("second_approver"), error.alias("error"))


def move(applications: DataFrame, requests: DataFrame, edges: DataFrame) -> DataFrame:
    """applications after requests (application_id, to_state, actor_id, at), with the state before and an error where one was refused.

    edges: before, after. submitted_at is set when a draft is submitted, decided_at at a terminal state.
    """
    kept = [c for c in applications.columns if c not in ("state", "submitted_at", "decided_at")]
    may = edges.select(F.col("before").alias("state"), F.col("after").alias("__to"), F.lit(True).alias("__may")).distinct()
    asked = applications.join(newest(requests, "application_id"), "application_id", "left").withColumn("__to", F.col("r.to_state"))
    j, moves, r = asked.join(may, ["state", "__to"], "left"), F.col("__may").isNotNull(), F.col("r")
    submitted = moves & (F.col("__to") == "SUBMITTED") & (F.col("state") == "DRAFT")
    decided = moves & F.col("__to").isin(*TERMINAL)
    return j.select(
        *kept, F.when(moves, F.col("__to")).otherwise(F.col("state")).alias("state"), F.when(submitted, r["at"]).otherwise(F.col("submitted_at")).alias("submitted_at"),
        F.when(decided, r["at"]).otherwise(F.col("decided_at")).alias("decided_at"), F.col("state").alias("before"), r["actor_id"].alias("actor_id"), r["at"].alias("at"),
        F.when(r.isNotNull() & ~moves, "no such transition").alias("error"))


def ask(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """Cases for which information is requested wait for it."""
    asked = requests.select("case_id").distinct().withColumn("__asked", F.lit(True))
    return cases.join(asked, "case_id", "left").withColumn("state", F.when(F.col("__asked"), "RFI_REQUESTED").otherwise(F.col("state"))).select(*cases.columns)


def breached(cases: DataFrame, as_of: Column) -> DataFrame:
    return cases.withColumn("breached", F.col("state").isin(*OPEN) & F.coalesce(F.col("sla_due_at") < as_of, F.lit(False)))


def opened_by_rescreen(scores: DataFrame, cases: DataFrame, clear_max: float = 72.0) -> DataFrame:
    """customer_id, tier of customers whose new best score needs a case and who have none open."""
    busy = cases.where(F.col("state").isin(*OPEN)).select("customer_id").distinct()
    best = scores.groupBy("customer_id").agg(F.max("score").alias("score")).where(F.col("score") > clear_max)
    return best.join(busy, "customer_id", "left_anti").select("customer_id", F.lit("review").alias("tier"))


def events_of(changed: DataFrame, key: str, kind: str, actor: Column, at: Column, **fields: Column) -> DataFrame:
    """The event rows that a change appends, details as canonical JSON."""
    details = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])) if fields else F.lit("{}")
    return changed.select(F.col(key), F.lit(kind).alias("kind"), actor.alias("actor_id"), at.alias("at"), details.alias("details"))
