"""Operators over ordered rows: depths, matching ends, segments, samples, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_depth(df: DataFrame, keys: list[str], order: list[str], ends: str, heads: str, clamp: bool = True) -> DataFrame:
    """``df`` with ``depth`` after each row: ends are taken off before heads are put on.

    With ``clamp`` the counter is set to 0 where it would be negative, which is the running sum less its running minimum below 0.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__s", F.sum(F.col(heads) - F.col(ends)).over(upto))
    depth = F.col("__s") - F.least(F.lit(0), F.min("__s").over(upto)) if clamp else F.col("__s")
    return df.withColumn("depth", depth).drop("__s")


def matching_end(df: DataFrame, keys: list[str], order: str, head: str, end: str) -> DataFrame:
    """(keys, start, end): for every row with ``head`` > 0 the first row from it on where the heads since are all ended by an end in that row.

    A head counts once for a row, ends count all. Heads without end are left out. The level before a head names the end that comes back
    to it, so both go by level through one window that finds the next end.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.where((F.col(head) > 0) | (F.col(end) > 0)).withColumn("__after", F.sum(F.col(head) - F.col(end)).over(upto))
    rows = rows.withColumn("__before", F.col("__after") - F.col(head) + F.col(end))
    start = F.when(F.col(head) > 0, F.struct(F.col("__before").alias("level"), F.lit(True).alias("opens")))
    stop = F.when(F.col(end) > 0, F.struct(F.col("__after").alias("level"), F.lit(False).alias("opens")))
    marks = rows.select(*keys, F.col(order).alias("start"), F.explode(F.array_compact(F.array(start, stop))).alias("__m"))
    ahead = Window.partitionBy(*keys, "__m.level").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("end", F.min(F.when(~F.col("__m.opens"), F.col("start"))).over(ahead))
    return found.where("__m.opens and end is not null").select(*keys, "start", "end")


def next_flag(df: DataFrame, keys: list[str], order: str, flag: str, name: str) -> DataFrame:
    """``df`` with ``name``: the order of the first row from this one on where ``flag`` holds, null if none."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.min(F.when(F.col(flag), F.col(order))).over(ahead))


def nearest_preceding(df: DataFrame, keys: list[str], order: list[str], flag: Column, value: Column, name: str, strict: bool = True) -> DataFrame:
    """As-of join within one table: ``value`` of the last row before this one (or up to it) where ``flag`` holds."""
    until = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return df.withColumn(name, F.last(F.when(flag, value), ignorenulls=True).over(until))


def marker_segments(df: DataFrame, keys: list[str], order: list[str], marker: Column, least: int) -> DataFrame:
    """``df`` with ``segment``: a marker row begins one; segments of under ``least`` rows join the one before, the first stays."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__seg", F.sum(F.when(marker, 1).otherwise(0)).over(upto))
    sizes = rows.groupBy(*keys, "__seg").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys).orderBy("__seg")
    opens = F.when((F.row_number().over(by) == 1) | (F.col("__n") >= least), 1).otherwise(0)
    sizes = sizes.withColumn("__open", opens).withColumn("segment", F.sum("__open").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.join(sizes.select(*keys, "__seg", "segment"), [*keys, "__seg"]).drop("__seg")


def gap_split(values: Column, gap: int, least: int, most: int) -> Column:
    """Cuts a sorted array of numbers into arrays: at a gap of over ``gap`` once ``least`` are in hand, and whenever ``most`` are.

    Cuts depend on earlier cuts, so it is one pass of ``aggregate`` over each row's array.
    """
    kind = "array<array<bigint>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast("array<bigint>").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["now"]) >= most
        apart = (F.size(acc["now"]) >= least) & (x - F.element_at(acc["now"], -1) > gap)
        cut = (F.size(acc["now"]) > 0) & (full | F.coalesce(apart, F.lit(False)))
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(x)).alias("now"))
        begun = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.array(x).alias("now"))
        return F.when(cut, begun).otherwise(grown)

    end = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
    return F.aggregate(values.cast("array<bigint>"), start, step, end)


def stride_sample(values: Column, k: int) -> Column:
    """At most ``k`` of an array, evenly: every max(1, n div k)-th from the first."""
    step = F.greatest(F.lit(1), F.floor(F.size(values) / k).cast("int"))
    return F.slice(F.filter(values, lambda x, i: i % step == 0), 1, k)


def stride_rows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each key, evenly: every max(1, n div k)-th in order from the first. Ranks stand in for arrays, so no key is collected."""
    by = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(by.orderBy(*order)) - 1, "__n": F.count("*").over(by)})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return rows.where((F.col("__i") % step == 0) & (F.col("__i") < step * k)).drop("__i", "__n")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def floor_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, points): the element at floor(p (n - 1)) of each group's sorted values.

    Counts per value come first, so equal values never travel one by one, and a window over the distinct ones finds the place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("__upto", F.sum("__c").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("__c").over(by))
    at = lambda p: F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), *(at(p).alias(name) for name, p in points.items()))


def interval_patch(hits: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at): the hits and, for every span (start, end) that holds one, its start and end. A window finds the next hit from each start on."""
    both = spans.select(*keys, F.col("start").alias("__at"), "end").unionByName(hits.select(*keys, F.col(at).alias("__at")), allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("__next", F.min(F.when(F.col("end").isNull(), F.col("__at"))).over(ahead))
    edges = both.where("end is not null and __next <= end").select(*keys, F.explode(F.array("__at", "end")).alias(at))
    return hits.select(*keys, at).union(edges).distinct()


def rendered(df: DataFrame, keys: list[str], order: list[str], text: Column, name: str, separator: str = "\n") -> DataFrame:
    """(keys, name): the texts of each key in order, joined."""
    lines = F.array_sort(F.collect_list(F.struct(*order, text.alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["__t"]), separator).alias(name))
