"""As-of and nearest joins of two tables by key and place.

Both sides are put together, sorted into ranges by key and place, and each row of the left side
takes the last row of the right side before it and the first after it in its range. A key may
be longer than a range: what a range can't see is carried over its edges. Only keys that stand in
several ranges have carried values, two of them a range at most, so that these are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..scratch import materialize

#: Rows of a range, about.
RANGE_ROWS = 200_000


def around(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left's columns, before, after: of the right rows (key, at, value) of a row's key, the last at or before its place and the first at or after it, as structs (at, value); null if there is none.

    Right rows that share a place stand by value: before is the last of them, after the first.
    A null key matches nothing, a null place has nothing before or after it, and right rows
    with either null are left out; repeated left rows stay. left's columns must not be named
    before or after.
    """
    names = left.columns
    ours = left.select(F.col(key).alias("k"), F.col(at).alias("p"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    known = right.select(F.col(key).alias("k"), F.col(at).alias("p"), F.col(value).alias("v")).where("k is not null and p is not null")
    places = known.groupBy("k", "p").agg(F.struct(F.first("p").alias("at"), F.min("v").alias("lo"), F.max("v").alias("hi")).alias("there"))
    rows = ours.where("k is not null and p is not null").withColumn("side", F.lit(1)).unionByName(places.withColumn("side", F.lit(0)), allowMissingColumns=True)
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + right.count()) // RANGE_ROWS))
    rows = materialize(rows.repartitionByRange(n, "k", "p", "side", F.xxhash64("row")).withColumn("range", F.spark_partition_id()), "as-of")

    # as many tasks as ranges, so that a task's sorts hold a few of them however many there are
    dealt = lambda some: some.repartition(n, "range")
    # a row of the left side stands after that of its place on the right, from both sides
    own = W.partitionBy("range", "k")
    upto, since = (own.orderBy(*o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (("p", "side"), (F.col("p").desc(), "side")))
    seen = dealt(rows).withColumn("b", F.last("there", ignorenulls=True).over(upto)).withColumn("a", F.last("there", ignorenulls=True).over(since)).where("side = 1")

    edges = dealt(rows.select("k", "range", "there")).groupBy("k", "range").agg(F.max("there").alias("last"), F.min("there").alias("first")).withColumn("ranges", F.count("*").over(W.partitionBy("k"))).where("ranges > 1")
    of = W.partitionBy("k").orderBy("range")
    before_it, after_it = of.rowsBetween(W.unboundedPreceding, -1), of.rowsBetween(1, W.unboundedFollowing)
    carried = edges.select(F.col("k").alias("ck"), F.col("range").alias("cr"), F.last("last", ignorenulls=True).over(before_it).alias("cb"), F.first("first", ignorenulls=True).over(after_it).alias("ca"))
    met = seen.join(F.broadcast(carried), (F.col("k") == F.col("ck")) & (F.col("range") == F.col("cr")), "left")  # two rows a range at most
    b, a = F.coalesce("b", "cb"), F.when(F.col("cb.at") == F.col("p"), F.col("cb")).otherwise(F.coalesce("a", "ca"))
    side = lambda c, v: F.when(c.isNotNull(), F.struct(c["at"].alias("at"), c[v].alias("value")))
    found = met.select("row", side(b, "hi").alias("before"), side(a, "lo").alias("after"))
    none = F.lit(None).cast(found.schema["before"].dataType)
    rest = ours.where("k is null or p is null").select("row", none.alias("before"), none.alias("after"))
    return found.unionByName(rest).select(*[F.col(f"row.`{c}`") for c in names], "before", "after")


def at_or_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left's columns, found: the last right row at or before, or the first if there is none; as around()."""
    return around(left, right, key, at, value).withColumn("found", F.coalesce("before", "after")).drop("before", "after")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left's columns, found: the right row whose place is nearest, before rather than after; as around()."""
    both = around(left, right, key, at, value)
    closer = F.col("before").isNull() | (F.col("after.at") - F.col(at) < F.col(at) - F.col("before.at"))
    return both.withColumn("found", F.when(closer, F.col("after")).otherwise(F.col("before"))).drop("before", "after")
