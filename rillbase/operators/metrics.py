"""Counter rates, histograms and three definitions of a percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inclusive upper bounds of the acknowledgement histograms (milliseconds, records) and of the sync histogram.
ACK_MS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0]
LAG_RECORDS = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 500.0, 1000.0, 5000.0, 20000.0, 100000.0]
SYNC_MS = [float(1 << i) for i in range(11)]


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds are below the value: the place of its bucket, len(bounds) for the overflow bucket."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: value > b))


def histogram(df: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """n for each bucket that has values."""
    return df.groupBy(*(keys or []), bucket_of(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, bounds: list[float], q: float, half_up: bool, overflow: float, keys: list[str] | None = None) -> DataFrame:
    """The upper bound of the bucket where the q-th value is.

    The rank is floor(n q + 0.5) with ``half_up``, else floor(n q), and at least 1.
    """
    keys = keys or []
    part = Window.partitionBy(*keys)
    run = F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.greatest(F.floor(F.sum("n").over(part) * q + (0.5 if half_up else 0.0)), F.lit(1))
    upper = F.element_at(F.array(*[F.lit(b) for b in [*bounds, overflow]]), F.col("bucket") + 1)
    return hist.withColumn("run", run).withColumn("rank", rank).where("run >= rank").groupBy(*keys).agg(F.min(F.struct(F.col("bucket"), upper.alias("value")))["value"].alias("value"))


def exact_percentile(df: DataFrame, value: str, q: float, keys: list[str] | None = None) -> DataFrame:
    """sorted[floor(q (n - 1))], from counts of distinct values, so no group's values meet in one array."""
    keys = keys or []
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*keys)
    run = F.sum("n").over(part.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.floor((F.sum("n").over(part) - 1) * q) + 1
    return counts.withColumn("run", run).withColumn("place", place).where("run >= place").groupBy(*keys).agg(F.min("value").alias("value"))


def rate(samples: DataFrame, keys: list[str], counter: str, identity: str | None = None) -> DataFrame:
    """Rate per tick; the sample before must be of the previous tick and, with ``identity``, of the same one; never below 0."""
    w = Window.partitionBy(*keys).orderBy("tick")
    same = F.lag("tick").over(w) == F.col("tick") - 1
    if identity:
        same &= F.lag(identity).over(w) == F.col(identity)
    return samples.withColumn("rate", F.when(same, F.greatest(F.col(counter) - F.lag(counter).over(w), F.lit(0)))).where("rate is not null")


def series(samples: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Like ``rate`` for one counter, but a sample below the one before is dropped."""
    w = Window.partitionBy(*keys).orderBy("tick")
    before = F.lag(counter).over(w)
    return samples.withColumn("delta", F.col(counter) - before).where("delta >= 0")


def last_points(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n ticks of each series."""
    w = Window.partitionBy(*keys).orderBy(F.desc("tick"))
    return points.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def outcomes(results: DataFrame) -> DataFrame:
    """Counts of success, exists and fail; redirects apart, failures split by refusal."""
    redirect = F.col("err_id").isin(1003, 1004)
    fail = (F.col("status") == "fail") & ~redirect
    n = lambda c: F.count(F.when(c, 1))
    return results.agg(
        n(F.col("status") == "success").alias("success"),
        n(F.col("status") == "exists").alias("exists_"),
        n(fail).alias("fail"),
        n(redirect).alias("redirected"),
        *[n(fail & (F.col("err_id") == e)).alias(f"fail_{e}") for e in (1007, 1001, 1008, 1009)],
        n(fail & ~F.col("err_id").isin(1007, 1001, 1008, 1009)).alias("fail_other"),
    )


def mean_ms(df: DataFrame, value_us: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of a histogram's microseconds in milliseconds, from the sum and the number kept beside its buckets; 0 of none."""
    total, n = F.sum(value_us), F.count(value_us)
    return df.groupBy(*(keys or [])).agg(F.when(n > 0, total / n / 1000.0).otherwise(F.lit(0.0)).alias("mean_ms"))


def throughput(answers: DataFrame, keys: list[str], ramp_ms: int, end_ms: int) -> DataFrame:
    """rate and ok_rate a second over the steady window, from ``ramp_ms`` (start-up is left out) to before ``end_ms``.

    answers: keys, at_ms, ok; a group without an answer in the window has 0, and so have all without a window.
    """
    window_s = (end_ms - ramp_ms) / 1000.0
    steady = (F.col("at_ms") >= ramp_ms) & (F.col("at_ms") < end_ms)
    per = lambda c: (F.count(F.when(c, 1)) / window_s) if window_s > 0 else F.lit(0.0)
    return answers.groupBy(*keys).agg(per(steady).alias("rate"), per(steady & F.col("ok")).alias("ok_rate"))


def flush_stats(flushes: DataFrame) -> DataFrame:
    """queue, pending bytes, oldest age and mean wait and service of flush requests."""
    open_ = F.col("done_ms").isNull()
    return flushes.agg(
        F.count(F.when(open_, 1)).alias("queue"),
        F.coalesce(F.sum(F.when(open_, F.col("bytes"))), F.lit(0)).alias("pending_bytes"),
        F.coalesce(F.max(F.when(open_, F.col("now_ms") - F.col("asked_ms"))), F.lit(0)).alias("oldest_ms"),
        F.avg(F.when(~open_, F.col("begun_ms") - F.col("asked_ms"))).alias("wait_ms"),
        F.avg(F.when(~open_, F.col("done_ms") - F.col("begun_ms"))).alias("service_ms"),
    )
