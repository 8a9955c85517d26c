"""Problem 9: mixing sources to target weights with capped repeats.

Every row gets a 24-bit hash of its id. Sizes are summed by source and the upper 12 bits; in the one bucket of a source
where its budget runs out they are summed again by the lower 12 bits, and only the rows of that one cell are put in
order. What lies below the threshold is taken by a filter; nothing else is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table
from .tokens import encode

BITS = 12
#: Thresholds have one row per target source; up to so many rows they are sent to every executor, else joined.
MOST_SENT = 10_000


def _crossing(sums: DataFrame, at: str, limits: DataFrame) -> DataFrame:
    """Per source the first cell of `at` by which the running sum exceeds `extra`, and the sum before it."""
    w = Window.partitionBy("_s").orderBy(at)
    run = sums.join(limits, "_s").withColumn("_run", F.sum("_size").over(w))
    hit = run.where(F.col("_run") > F.col("_extra"))
    return hit.groupBy("_s").agg(F.min(at).alias(at), F.min_by(F.col("_run") - F.col("_size"), at).alias("_before"))


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None) -> DataFrame:
    """Rows (key, source, size, copies): how often each row is used. targets: (source, target_share, max_repeats).

    A source's budget is target_share x total; total is the size of all rows of targeted sources unless given. A source
    too small for its budget is used max_repeats times and stays short; the report shows it. Within a source every row
    is used k or k + 1 times, the k + 1 being the rows below a hash threshold that keeps within the budget; equal keys
    stand together. Null sources, sources without a target and rows used 0 times are absent; null sizes count as 0.
    An empty input gives no rows.
    """
    goals = targets.select(F.col("source").alias("_s"), F.col("target_share").alias("_share"), F.col("max_repeats").alias("_max")).where("_s IS NOT NULL AND _share > 0 AND _max > 0")
    small = goals.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    mask = (1 << BITS) - 1
    rows = df.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), F.xxhash64(F.col(key)).bitwiseAND((1 << 2 * BITS) - 1).alias("_h"))
    rows = durable(rows.join(sent(goals), "_s").withColumns({"_hi": F.shiftright("_h", BITS), "_lo": F.col("_h").bitwiseAND(mask)}))
    coarse = durable(rows.groupBy("_s", "_hi").agg(F.sum("_size").alias("_size")))
    sums = coarse.groupBy("_s").agg(F.sum("_size").alias("_all"))
    whole = F.lit(float(total)) if total is not None else F.sum("_all").over(Window.partitionBy(F.lit(0)))
    plan = sums.join(goals, "_s").withColumn("_budget", F.col("_share") * whole)
    plan = plan.withColumn("_times", F.when(F.col("_all") > 0, F.least(F.col("_max").cast("long"), F.floor(F.col("_budget") / F.col("_all")))).otherwise(0))
    plan = plan.withColumn("_extra", F.when(F.col("_times") < F.col("_max"), F.col("_budget") - F.col("_times") * F.col("_all")).otherwise(0.0))
    plan = durable(plan.select("_s", "_times", "_extra"))
    hi = durable(_crossing(coarse, "_hi", plan.select("_s", "_extra")).withColumnsRenamed({"_hi": "_hi_at", "_before": "_before_hi"}))
    edge = rows.join(sent(hi), "_s").where(F.col("_hi") == F.col("_hi_at"))
    left = plan.join(hi, "_s").select("_s", (F.col("_extra") - F.col("_before_hi")).alias("_extra"))
    lo = durable(_crossing(edge.groupBy("_s", "_lo").agg(F.sum("_size").alias("_size")), "_lo", left).withColumnsRenamed({"_lo": "_lo_at", "_before": "_before_lo"}))
    last = edge.join(sent(lo), "_s").where(F.col("_lo") == F.col("_lo_at")).join(sent(plan.select("_s", "_extra")), "_s")
    fits = last.withColumn("_run", F.sum("_size").over(Window.partitionBy("_s").orderBy("_h", "_k")))
    fits = fits.where(F.col("_run") + F.col("_before_hi") + F.col("_before_lo") <= F.col("_extra"))
    final = durable(fits.groupBy("_s").agg(F.max("_k").alias("_last")))
    marks = plan.join(hi, "_s", "left").join(lo, "_s", "left").join(final, "_s", "left")
    out = rows.drop("_share", "_max").join(sent(marks), "_s")
    # all below the threshold; without a crossing (budget not reached) a source with something extra is taken whole
    below = (F.col("_hi") < F.col("_hi_at")) | ((F.col("_hi") == F.col("_hi_at")) & ((F.col("_lo") < F.col("_lo_at")) | ((F.col("_lo") == F.col("_lo_at")) & (F.col("_k") <= F.col("_last")))))
    more = F.when(F.col("_extra") <= 0, False).when(F.col("_hi_at").isNull(), True).otherwise(F.coalesce(below, F.lit(False)))
    copies = (F.col("_times") + more.cast("long")).cast("int")
    return out.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_size").alias(size), copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """One row per target: what it got. Absent sources have 0."""
    got = mixed.groupBy(source).agg(F.count("*").alias("rows_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col(size)).alias("tokens"))
    all_ = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(got, source, "left").fillna(0, ["rows_used", "copies", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return all_.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    return mix(encode(docs, keep=["doc_id", "source"], ids="n_tokens", count_only=True), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
