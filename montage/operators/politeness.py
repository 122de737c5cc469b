"""Rate limits and robots rules for hosts, computed over request times rather than slept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


def host_waits(requests: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """host, at_ms, seq, refused -> adds wait_ms and factor.

    After request k a host may be called again at A_k = max(t_k, A_{k-1}) + gap_k, the gap doubling with each refusal before, up to a cap.
    That recursion is a running maximum: A_k = G_k + max over i <= k of (t_i - G_{i-1}), with G the running sum of gaps.
    """
    order = Window.partitionBy("host").orderBy("at_ms", "seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    refusals = F.coalesce(F.sum(F.col("refused").cast("int")).over(before), F.lit(0))
    factor = F.least(F.lit(params.host_penalty_cap), F.pow(F.lit(2.0), refusals))
    out = requests.withColumn("factor", factor).withColumn("gap", (F.col("factor") * params.host_delay_s * 1000).cast("long"))
    out = out.withColumn("g", F.sum("gap").over(upto))
    out = out.withColumn("allowed", F.col("g") + F.max(F.col("at_ms") - (F.col("g") - F.col("gap"))).over(upto))
    wait = F.greatest(F.lit(0), F.coalesce(F.lag("allowed").over(order), F.lit(0)) - F.col("at_ms"))
    return out.withColumn("wait_ms", wait).drop("g", "gap", "allowed")


def allowed_by_robots(requests: DataFrame, rules: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """requests (id, host, path), rules (host, prefix, allow, fetched_at) -> adds allowed: the longest prefix decides; no live rule allows."""
    live = rules.where(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("fetched_at").cast("timestamp")) < ttl_s)
    hit = requests.join(live, "host").where(F.startswith("path", "prefix")).groupBy("id").agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow").cast("int"))).alias("allow"))
    return requests.join(hit, "id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")
