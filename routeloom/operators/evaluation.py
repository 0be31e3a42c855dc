"""Evaluation of methods: answers against a reference, times, counters, partition figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import cut
from .paths import path_costs, solve


def check_buckets(found: DataFrame, expected: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One row of counts from (id, cost) and (id, cost).

    Costs within the tolerance are correct with a path; both without are correct without;
    a path that the reference lacks is incorrect with a path, the reverse incorrect without.
    """
    j = found.select("id", F.col("cost").alias("a")).join(expected.select("id", F.col("cost").alias("b")), "id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("a"), F.col("b")
    close = F.abs(a - b) < tolerance
    both = a.isNotNull() & b.isNotNull()
    return j.agg(
        n(both & close).alias("correct_with_path"),
        n(a.isNull() & b.isNull()).alias("correct_no_path"),
        n((both & ~close) | (a.isNotNull() & b.isNull())).alias("incorrect_with_path"),
        n(a.isNull() & b.isNotNull()).alias("incorrect_no_path"),
    )


def mean_times(timings: DataFrame) -> DataFrame:
    """method, setting, mean in milliseconds of (method, setting, time in ns)."""
    return timings.groupBy("method", "setting").agg((F.avg("time") / 1e6).alias("mean_ms"))


def speed_ups(timings: DataFrame, base: str = "normal") -> DataFrame:
    """method, setting, how many times as fast as the base method in the same setting."""
    m = mean_times(timings)
    return m.join(m.where(F.col("method") == base).select("setting", F.col("mean_ms").alias("base_ms")), "setting").select("method", "setting", (F.col("base_ms") / F.col("mean_ms")).alias("speed_up"))


def difference_of_means(timings: DataFrame, a: str, b: str) -> DataFrame:
    """setting, mean milliseconds of method ``a`` less those of ``b``; null where one has no times."""
    m = mean_times(timings).where(F.col("method").isin(a, b)).groupBy("setting").pivot("method", [a, b]).agg(F.first("mean_ms"))
    return m.select("setting", (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("difference_ms"))


def label(column: str, upper: bool = False) -> Column:
    """How a method is written in a report: K-means, other names with a capital, or all in capitals."""
    return F.upper(column) if upper else F.when(F.col(column) == "kmeans", "K-means").otherwise(F.initcap(column))


def experiment_name(column: str, ending: str = "") -> Column:
    """area, partitioner, levels, pch (contracted without a partitioning) as a struct of a file name like ``area-kmeans-4_4[-pch].bin``; null for names of another ending or form."""
    name = F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(F.regexp_replace(name, "-pch$", ""), "-")
    right = F.col(column).endswith(ending) & (F.size(parts) >= 3)
    return F.when(right, F.struct(F.concat_ws("-", F.slice(parts, F.lit(1), F.size(parts) - 2)).alias("area"), F.element_at(parts, -2).alias("partitioner"), F.regexp_replace(F.element_at(parts, -1), "_", ", ").alias("levels"), name.endswith("-pch").alias("pch")))


def timed(g: Graph, queries: DataFrame, methods: Sequence[str], setting: str) -> DataFrame:
    """method, setting, id, time (nanoseconds of the search alone), heap_pops, relaxed_edges of each query and method."""
    runs = [solve(g, queries, m, counters=True).select(F.lit(m).alias("method"), F.lit(setting).alias("setting"), "id", "time", "heap_pops", "relaxed_edges") for m in methods]
    return reduce(DataFrame.unionByName, runs)


def experiment(graphs: dict[str, Graph], queries: DataFrame, methods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The times of all methods on all prepared graphs (setting -> graph), and setting, contracted.

    Each graph is one setting of the matrix (area, partitioner, levels); its queries run as one job for each method.
    """
    times = cut(reduce(DataFrame.unionByName, [timed(g, queries, methods, name) for name, g in graphs.items()]))
    shares = [boundary_nodes(g.nodes).select(F.lit(name).alias("setting"), "contracted") for name, g in graphs.items()]
    return times, reduce(DataFrame.unionByName, shares)


def check(g: Graph, queries: DataFrame, method: str, tolerance: float = 1.0) -> DataFrame:
    """Answers of a method against plain searches, by the costs recomputed along the paths."""
    q = cut(queries.select("id", "start_id", "end_id", "alpha"))
    cost = lambda m: path_costs(solve(g, q, m), g.edges, q).withColumnRenamed("path_cost", "cost")
    return check_buckets(cost(method), cost("normal"), tolerance)


def time_quantiles(timings: DataFrame, exact: bool = True) -> DataFrame:
    """method, q1, median, q3; the approximate form merges sketches of bounded size."""
    q = (F.percentile if exact else F.percentile_approx)("time", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return timings.groupBy("method").agg(q.alias("q")).select("method", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def mean_counters(counts: DataFrame) -> DataFrame:
    return counts.groupBy("method").agg(F.avg("heap_pops").alias("mean_heap_pops"), F.avg("relaxed_edges").alias("mean_relaxed_edges"))


def pivot_first(rows: DataFrame, index: str, column: str, value: str, values: list[str]) -> DataFrame:
    """One column for each of ``values``, the first value found in each."""
    return rows.groupBy(index).pivot(column, values).agg(F.first(value, ignorenulls=True))


def uneven_groups(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Groups that don't have exactly ``n`` rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != n)


def last_of(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The value of the latest run for each key."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))


def boundary_nodes(levels: DataFrame) -> DataFrame:
    """boundary (nodes with a neighbour in another cell), nodes, contracted share of (node_id, level)."""
    boundary = F.sum((F.col("level") >= 1).cast("long"))
    return levels.agg(boundary.alias("boundary"), F.count("*").alias("nodes"), (1 - boundary / F.count("*")).alias("contracted"))


def report(timings: DataFrame, contracted: DataFrame, preprocessing: DataFrame, methods: list[str], base: str = "normal") -> DataFrame:
    """One row a setting: mean times and speed-ups of the methods, contracted percentage, pre-processing minutes.

    contracted: setting, contracted.  preprocessing: setting, seconds.
    """
    means = mean_times(timings).groupBy("setting").pivot("method", methods).agg(F.first("mean_ms"))
    means = means.select("setting", *[F.col(m).alias(f"{m}_ms") for m in methods])
    for m in methods:
        means = means.withColumn(f"{m}_speed_up", F.try_divide(F.col(f"{base}_ms"), F.col(f"{m}_ms")))
    return means.join(contracted.select("setting", (F.col("contracted") * 100).alias("contracted_percent")), "setting", "left").join(preprocessing.select("setting", (F.col("seconds") / 60).alias("minutes")), "setting", "left")


def by_summed_setting(rows: DataFrame, column: str) -> DataFrame:
    """Rows in the order of the sum of the numbers in a setting like ``2^10, 4, 4`` (a power counts as its value)."""
    term = lambda x: F.when(F.contains(x, F.lit("^")), F.pow(F.substring_index(x, "^", 1).cast("double"), F.substring_index(x, "^", -1).cast("double"))).otherwise(x.cast("double"))
    total = F.aggregate(F.transform(F.split(column, r"\s*,\s*"), lambda x: term(F.trim(x))), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("setting_sum", total).orderBy("setting_sum", column)


