"""Usage, quotas, access and state folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("viewer", "editor", "owner")


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of (kind, model, tokens_in, tokens_out) by price per million; unknown models cost nothing and are marked."""
    p = events.join(prices, "model", "left")
    cost = (F.col("tokens_in").cast("decimal(18,0)") * F.col("price_in") + F.col("tokens_out").cast("decimal(18,0)") * F.col("price_out")) / F.lit(1000000).cast("decimal(10,0)")
    return p.withColumn("cost", F.coalesce(cost, F.lit(0)).cast("decimal(20,4)")).withColumn("kind", F.when(F.col("price_in").isNull(), F.concat("kind", F.lit(":unpriced"))).otherwise(F.col("kind"))).drop("price_in", "price_out")


def rollup(events: DataFrame) -> DataFrame:
    """Sums per world and per user in one pass (grouping sets)."""
    out = events.groupingSets([["world_id"], ["user_id"]], "world_id", "user_id").agg(F.count("*").alias("events"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
    return out


def _seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def quota(events: DataFrame, limits: DataFrame, window: int) -> DataFrame:
    """Each event with the count in its trailing window, whether it is over the kind's limit, and when to try again."""
    w = Window.partitionBy("user_id", "kind").orderBy("sec").rangeBetween(-window + 1, 0)
    e = events.withColumn("sec", _seconds("ts")).withColumn("used", F.count("*").over(w)).withColumn("oldest", F.min("sec").over(w))
    e = e.join(limits, "kind", "left")
    denied = F.coalesce(F.col("used") > F.col("limit"), F.lit(False))
    return e.withColumn("denied", denied).withColumn("retry_after", F.when(denied, F.col("oldest") + window - F.col("sec")))


def spend_alerts(events: DataFrame, cap: float, window: int = 86400) -> DataFrame:
    """Events whose user's spend over the trailing day exceeds the cap."""
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-window + 1, 0)
    return events.withColumn("sec", _seconds("ts")).withColumn("spent", F.sum("cost").over(w)).filter(F.col("spent") > cap)


def last_state(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The newest values of each key."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(key).agg(last.alias("s")).select(key, "s.*")


def tiers(subscriptions: DataFrame, now: Column) -> DataFrame:
    paid = F.col("status").isin("active", "trialing") & (F.col("period_end").isNull() | (F.col("period_end") > now))
    return subscriptions.withColumn("tier", F.when(paid, "paid").otherwise("free"))


def visible_worlds(worlds: DataFrame, members: DataFrame, least: str = "viewer") -> DataFrame:
    """(user_id, world_id, role): owners by ownership, others by membership, the higher of both, from the least role on."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("role"))
    both = worlds.select("world_id", F.col("owner_id").alias("user_id"), F.lit("owner").alias("role")).unionByName(members.select("world_id", "user_id", "role"))
    top = both.filter("user_id is not null").groupBy("user_id", "world_id").agg(F.max(rank).alias("rank"))
    return top.filter(F.col("rank") >= RANKS.index(least) + 1).select("user_id", "world_id", F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.col("rank").cast("int")).alias("role"))


def purge_worlds(tables: dict[str, DataFrame], purge: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the purged worlds, and the count of rows that went, by table and world."""
    kept = {n: df.join(purge, "world_id", "left_anti") for n, df in tables.items()}
    counts = None
    for n, df in tables.items():
        part = df.join(purge, "world_id", "left_semi").groupBy("world_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "world_id", "n")
        counts = part if counts is None else counts.unionByName(part)
    return kept, counts


def heirs(worlds: DataFrame, members: DataFrame, leaving: DataFrame) -> DataFrame:
    """What happens to the worlds of accounts that leave: reassigned to the earliest other owner, or purged."""
    own = worlds.join(leaving.withColumnRenamed("user_id", "owner_id"), "owner_id", "left_semi").select("world_id", "owner_id")
    others = members.filter("role = 'owner'").join(leaving, "user_id", "left_anti")
    heir = others.groupBy("world_id").agg(F.min_by("user_id", F.struct("created_at", "user_id")).alias("heir"))
    return own.join(heir, "world_id", "left").withColumn("action", F.when(F.col("heir").isNull(), "purge").otherwise("reassign"))


def run_status(runs: DataFrame, now: Column, patience: int = 90) -> DataFrame:
    """Running runs without a heartbeat for ``patience`` seconds count as failed; the newest run of each world."""
    stale = (F.col("status") == "running") & (_seconds("heartbeat") < now - patience)
    latest = runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
    return last_state(latest, "world_id", ["heartbeat", "run_id"], ["run_id", "status"])


def cost_guard(events: DataFrame, cap: float) -> DataFrame:
    """The first event of each run at which its cost passes the cap; that event is counted."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    total = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("total", total).filter(F.col("total") > cap).withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def run_consistency(results: DataFrame) -> DataFrame:
    """(case_id, run, caught) -> caught every run, some runs, or never."""
    sums = results.groupBy("case_id").agg(F.count_if("caught").alias("caught"), F.count("*").alias("runs"))
    return sums.withColumn("verdict", F.when(F.col("caught") == F.col("runs"), "every").when(F.col("caught") > 0, "some").otherwise("never"))


def consistency_summary(results: DataFrame, wrong: DataFrame, episodes: int) -> DataFrame:
    """Per system: results (system, case_id, run, caught) and wrong findings (system, run, n) over all its runs.

    Mean recall and mean wrong findings an episode over runs, and how many cases were caught in every run, some or none.
    """
    by_run = results.groupBy("system", "run").agg(F.avg(F.col("caught").cast("double")).alias("recall"))
    extra = wrong.groupBy("system", "run").agg(F.sum("n").alias("n"))
    means = by_run.join(extra, ["system", "run"], "left").groupBy("system").agg(
        F.count("*").alias("runs"), F.avg("recall").alias("recall_mean"),
        F.avg(F.coalesce("n", F.lit(0)) / F.lit(episodes)).alias("wrong_per_episode_mean"),
    )
    cases = results.groupBy("system", "case_id").agg(F.countDistinct(F.when(F.col("caught"), F.col("run"))).alias("caught"))
    both = cases.join(means.select("system", "runs"), "system")
    tally = both.groupBy("system").agg(
        F.count_if(F.col("caught") == F.col("runs")).alias("every_run"),
        F.count_if((F.col("caught") > 0) & (F.col("caught") < F.col("runs"))).alias("some_runs"),
        F.count_if(F.col("caught") == 0).alias("never"), F.count("*").alias("cases"),
    )
    return means.join(tally, "system").withColumn("recall_every_run", F.col("every_run") / F.col("cases"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed or changed rows between two snapshots; nulls are values like others."""
    values = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(F.lit(1).alias("here"), *values).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}"))
    both = side(before, "b").join(side(after, "a"), same, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*[F.when(F.col("b").isNotNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys], change.alias("change")).filter("change is not null")


HOUR, DAY = 3600, 86400
# What an account may do, by tier: how often in how many seconds (none: ever); how many pages a script may have, of how many lines.
POLICIES = {
    "free": {"world_create": (1, None), "script_ingest": (1, None), "report_run": (3, DAY), "ask": (20, HOUR)},
    "paid": {"world_create": (25, None), "script_ingest": (100, None), "report_run": (50, DAY), "ask": (500, HOUR)},
}
PAGES = {"free": 130, "paid": 600}
LINES_A_PAGE = 55


def _span(window: int | None) -> str:
    return {None: "per account", DAY: "per day", HOUR: "per hour"}.get(window, f"per {window}s")


def _tiered(df: DataFrame, tiers: DataFrame) -> DataFrame:
    return df.join(tiers.select("user_id", "tier"), "user_id", "left").withColumn("tier", F.coalesce("tier", F.lit("free")))


def decisions(requests: DataFrame, log: DataFrame, tiers: DataFrame, policies: dict[str, dict[str, tuple[int, int | None]]] = POLICIES) -> DataFrame:
    """Requests (request_id, user_id, kind, ts) -> request_id, tier, used, allowed, retry_after, reason.

    ``used`` counts what the log (user_id, kind, ts) holds of the user's actions of that kind up to the request, in the
    window that the user's tier sets, its far end included; a window of none reaches back for ever.  Who has no tier
    is free; kinds without a limit are allowed and not counted (null).  ``retry_after`` are whole seconds, at least
    one, until the oldest counted action leaves its window.  One exchange by user and kind serves all windows.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = requests.select("request_id", "user_id", "kind", at).unionByName(log.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "user_id", "kind", at))
    done = F.col("request_id").isNull()
    windows = sorted({w for kinds in policies.values() for _, w in kinds.values()}, key=lambda w: (w is None, w))
    counted = {}
    for i, w in enumerate(windows):
        over = Window.partitionBy("user_id", "kind").orderBy("at").rangeBetween(Window.unboundedPreceding if w is None else -w * 1_000_000, 0)
        counted[f"n{i}"], counted[f"t{i}"] = F.count(F.when(done, 1)).over(over), F.min(F.when(done, F.col("at"))).over(over)
    asked = _tiered(rows.withColumns(counted).filter(~done), tiers)
    limits = [(t, k, most, windows.index(w), w) for t, kinds in policies.items() for k, (most, w) in kinds.items()]
    pick = lambda value: F.coalesce(*[F.when((F.col("tier") == t) & (F.col("kind") == k), value(t, k, most, i, w)) for t, k, most, i, w in limits])
    used = pick(lambda t, k, most, i, w: F.col(f"n{i}"))
    left = pick(lambda t, k, most, i, w: F.lit(None).cast("long") if w is None else F.greatest(F.lit(1).cast("long"), F.ceil((F.col(f"t{i}") + w * 1_000_000 - F.col("at")) / 1_000_000)))
    reason = pick(lambda t, k, most, i, w: F.lit(f"{t} tier allows {most} {k} {_span(w)}"))
    asked = asked.withColumn("used", used).withColumn("allowed", F.coalesce(F.col("used") < pick(lambda t, k, most, i, w: F.lit(most)), F.lit(True)))
    return asked.select("request_id", "user_id", "kind", "tier", "used", "allowed", F.when(~F.col("allowed"), left).alias("retry_after"), F.when(~F.col("allowed"), reason).alias("reason"))


def page_decisions(scripts: DataFrame, tiers: DataFrame, most: dict[str, int] = PAGES) -> DataFrame:
    """Scripts (doc_id, user_id, text) -> doc_id, tier, pages, allowed, reason: pages are lines by 55, at least one; an unknown tier has no limit."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("tier"))
    each = _tiered(scripts, tiers).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.ceil(lines / LINES_A_PAGE))).withColumn("limit", limit)
    allowed = F.coalesce(F.col("pages") <= F.col("limit"), F.lit(True))
    reason = F.format_string("%s tier accepts scripts up to %d pages (got %d)", "tier", "limit", "pages")
    return each.select("doc_id", "tier", "pages", allowed.alias("allowed"), F.when(~allowed, reason).alias("reason"))
