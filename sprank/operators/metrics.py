"""Request metrics over an event log (ts, endpoint, value = duration).

Counters, cumulative histograms, gauges and per-minute series are plain
grouped aggregations; each runs with map-side partial aggregation, so a hot
endpoint holding a third of all rows is pre-combined in every task before the
shuffle. Histograms use one pass of conditional sums (no join with a bucket
table); exact percentiles of large groups select ranks by counts over value
ranges that a quantile sketch chooses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.functions.text import safe_ratio
from sprank.plans.sizing import checked_broadcast

# Default latency buckets of the public Prometheus client (seconds).
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0,
                   2.5, 5.0, 7.5, 10.0)
INF_LABEL = "+Inf"
PERCENTILES = (0.5, 0.95, 0.99)
TAIL_ROWS = 50
# Rows of a group that one task may sort, and distinct values of a range, about; ranges of a group at most.
VALUES_PER_RANGE = 10_000
MAX_RANGES = 10_000
STRIDE = 100


def minute(ts_col: str = "ts", period: str = "1 minute"):
    """Start of the tumbling window holding ``ts`` (as the window's start)."""
    return F.window(F.col(ts_col), period).start


def counters(events: DataFrame, endpoint: str = "event_type", error_value: str = "error") -> DataFrame:
    """requests_total{endpoint, status}: status 'error' for failed requests, else 'ok'."""
    status = F.when(F.col(endpoint) == error_value, F.lit("error")).otherwise(F.lit("ok"))
    return (events.groupBy(F.col(endpoint).alias("endpoint"), status.alias("status"))
            .agg(F.count(F.lit(1)).alias("requests")))


def histogram(events: DataFrame, endpoint: str = "event_type", value: str = "value",
              scale: float = 0.001, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative buckets per endpoint: (endpoint, le, bucket_count, sum, count).
    ``value * scale`` is the observed duration (default: ms -> s)."""
    v = F.col(value) * F.lit(scale)
    aggs = [F.count_if(v <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum")]
    wide = events.groupBy(F.col(endpoint).alias("endpoint")).agg(*aggs)
    labels = [repr(float(b)) for b in buckets] + [INF_LABEL]
    cols = [F.col(f"b{i}") for i in range(len(buckets))] + [F.col("count")]
    pairs = F.array(*[F.struct(F.lit(lab).alias("le"), c.cast("bigint").alias("n"))
                      for lab, c in zip(labels, cols)])
    return wide.select("endpoint", F.inline(pairs), "sum", "count").select(
        "endpoint", "le", F.col("n").alias("bucket_count"), "sum", "count")


def gauge_latest(events: DataFrame, key: str = "event_type", value: str = "value",
                 ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Latest value per key (ties on ts broken by the larger ``tiebreak``)."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    return events.groupBy(F.col(key).alias("endpoint")).agg(
        F.max(ts).alias("last_ts"), F.max_by(F.col(value), order).alias("last_value"))


def index_size(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.agg(F.count_distinct(id_col).alias("index_size"))


def value_counts(events: DataFrame, endpoint: str = "event_type", value: str = "value", ts: str = "ts",
                 period: str = "1 minute") -> DataFrame:
    """(w, endpoint, v, c): how often each value occurs, the additive state of exact percentiles."""
    return (events.groupBy(minute(ts, period).alias("w"), F.col(endpoint).alias("endpoint"), F.col(value).alias("v"))
            .agg(F.count(F.lit(1)).alias("c")))


def latency_percentiles(events: DataFrame, endpoint: str = "event_type", value: str = "value",
                        ts: str = "ts", period: str = "1 minute", pcts=PERCENTILES) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per (window, endpoint). NULL
    values don't count as values (``n`` counts all rows)."""
    return percentiles(events.select(minute(ts, period).alias("w"), F.col(endpoint).alias("endpoint"),
                                     F.col(value).alias("v"), F.lit(1).cast("long").alias("c")), pcts)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet; the keys come from the left."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*[f"__{k}" for k in keys])


def _named(pcts) -> list[str]:
    return [f"p{int(round(x * 100))}" for x in pcts]


def percentiles(counts: DataFrame, pcts=PERCENTILES, keys=("w", "endpoint")) -> DataFrame:
    """Exact interpolated percentiles per group from (keys, v, c), a value and how often it occurs.

    Rows of a value may come in any number, from any number of micro-batches.
    Groups of up to VALUES_PER_RANGE rows are one aggregation. The values of a
    larger group are dealt into ranges of about as many distinct values each,
    whose bounds come from a mergeable quantile sketch of the distinct values,
    so an outlier is in a range with its neighbours in order; counts of the
    ranges, then running counts inside those that hold a wanted rank, give the
    exact values. No task holds the values of a whole group.
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    small = counts
    if most > VALUES_PER_RANGE:
        hot, _ = checked_broadcast(sizes.where(F.col("rows") > VALUES_PER_RANGE).select(*keys), what="large groups")
        small = _null_safe_join(counts, hot, keys, "left_anti")
        large = _large_percentiles(_null_safe_join(counts, hot, keys, "left_semi"), pcts, keys)
    agg = F.percentile("v", [float(x) for x in pcts], F.col("c"))
    out = small.groupBy(*keys).agg(F.sum("c").alias("n"), agg.alias("p")).select(
        *keys, "n", *[F.get("p", F.lit(i)).alias(name) for i, name in enumerate(_named(pcts))])
    return out.unionByName(large) if most > VALUES_PER_RANGE else out


def value_ranges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with their counts, the totals of their group, and the ``range`` they lie in.

    (keys, v, c, n, nv, range): ranges of a group are numbered in the order of
    values, of about VALUES_PER_RANGE distinct values each; NULL comes last.
    """
    cells = counts.groupBy(*keys, "v").agg(F.sum("c").alias("c"))
    most = cells.groupBy(*keys).agg(F.count("v").alias("k")).agg(F.max("k")).first()[0] or 0
    finest = min(MAX_RANGES, max(2, -(-most // VALUES_PER_RANGE)))
    sketch = F.percentile_approx("v", [i / finest for i in range(1, finest)], 10 * finest)
    groups = cells.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("nv"),
        F.count("v").alias("k"), sketch.alias("bounds"))
    own = F.least(F.ceil(F.col("k") / VALUES_PER_RANGE), F.lit(finest)).cast("int")
    # As many bounds as the group needs, then in rows of STRIDE, so that a value is compared with few.
    picked = F.when(own > 1, F.transform(F.sequence(F.lit(1), F.greatest(own, F.lit(2)) - 1), lambda i: F.get(
        F.col("bounds"), (i * finest / own).cast("int") - 1))).otherwise(F.slice("bounds", 1, 0))
    groups = groups.withColumn("bounds", F.coalesce(picked, F.array().cast("array<double>")))
    coarse = F.transform(F.filter("bounds", lambda _, i: i % STRIDE == 0), lambda b: b)
    groups = groups.withColumn("coarse", coarse)
    cells = _null_safe_join(cells, groups.drop("k"), keys)
    row = F.greatest(F.size(F.filter("coarse", lambda b: b < F.col("v"))) - 1, F.lit(0))
    place = row * STRIDE + F.size(F.filter(F.slice("bounds", row * STRIDE + 1, STRIDE), lambda b: b < F.col("v")))
    return cells.select(*keys, "v", "c", "n", "nv", F.when(F.col("v").isNull(), F.size("bounds") + 1).otherwise(place).alias("range"))


def _large_percentiles(counts: DataFrame, pcts, keys: list[str]) -> DataFrame:
    cells = value_ranges(counts, keys)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (cells.groupBy(*keys, "range").agg(F.sum("c").alias("held"))
             .select(*keys, "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base")))
    # Dealt by range, not by group: a group may hold a third of all rows.
    inside = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.repartition(*keys, "range").withColumn("upto", F.sum("c").over(inside))
    cells = (_null_safe_join(cells, bases, [*keys, "range"])
             .withColumn("last", F.col("base") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("c") + 1))

    def at(rank):
        return F.min(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
    spots = [F.lit(float(x)) * (F.col("nv") - 1) for x in pcts]
    aggs = [f(s) for s in spots for f in (lambda s: at(F.floor(s)), lambda s: at(F.ceil(s)))]
    out = cells.groupBy(*keys).agg(F.max("n").alias("n"), F.max("nv").alias("nv"),
                                   *[a.alias(f"x{i}") for i, a in enumerate(aggs)])
    cols = [(F.col(f"x{2 * i}") + (F.col(f"x{2 * i + 1}") - F.col(f"x{2 * i}")) * (s - F.floor(s))).alias(name)
            for i, (name, s) in enumerate(zip(_named(pcts), spots))]
    return out.select(*keys, "n", *cols)


def per_minute(events: DataFrame, endpoint: str = "event_type", value: str = "value",
               ts: str = "ts", period: str = "1 minute") -> DataFrame:
    """Requests, summed and average value per (window, endpoint)."""
    return events.groupBy(minute(ts, period).alias("w"), F.col(endpoint).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(value).alias("total"), F.avg(value).alias("avg"))


def errors_per_minute(events: DataFrame, endpoint: str = "event_type", ts: str = "ts",
                      error_value: str = "error", period: str = "1 minute") -> DataFrame:
    return events.groupBy(minute(ts, period).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col(endpoint) == error_value).alias("errors"))


def run_speedup(events: DataFrame, run_a: str, run_b: str, key: str = "event_type",
                value: str = "value") -> DataFrame:
    """Two runs (rows with key = run_a / run_b): totals, throughput n / time and
    speed-up time_a / time_b, each 0 when its divisor is not positive."""
    a = F.col(key) == run_a
    b = F.col(key) == run_b
    t = events.where(a | b).agg(
        F.count_if(a).alias("n_a"), F.coalesce(F.sum(F.when(a, F.col(value))), F.lit(0.0)).alias("time_a"),
        F.count_if(b).alias("n_b"), F.coalesce(F.sum(F.when(b, F.col(value))), F.lit(0.0)).alias("time_b"))
    return t.select("n_a", "time_a", "n_b", "time_b",
                    safe_ratio(F.col("n_a"), F.col("time_a")).alias("throughput_a"),
                    safe_ratio(F.col("n_b"), F.col("time_b")).alias("throughput_b"),
                    safe_ratio(F.col("time_a"), F.col("time_b")).alias("speedup"))


def log_tail(events: DataFrame, n: int = TAIL_ROWS, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Newest ``n`` rows (a top-n report: per-task top-n, then one merge)."""
    return events.orderBy(F.col(ts).desc(), F.col(tiebreak).asc()).limit(n)


def log_enrich(events: DataFrame, text: str = "props", count: str = "user_id",
               value: str = "value", scale: float = 0.001) -> DataFrame:
    """Structured-log fields: text length, duration in seconds, throughput =
    count / duration guarded to 0 when the duration is not positive."""
    d = F.col(value) * F.lit(scale)
    return events.select("event_id", F.length(text).alias("query_length"),
                         F.col(count).alias("doc_count"), d.alias("duration_seconds"),
                         safe_ratio(F.col(count), d).alias("throughput"))
