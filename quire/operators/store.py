"""State as a log of changes and views of its latest rows.

A change is a row with key columns, a version, an operation ('U' to set, 'D' to delete) and
values. Nothing is updated in place: writers append, readers take each key's newest change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# States of an ingestion job and where each may lead.
NEXT_STATES = {"queued": ["extracting", "failed"], "extracting": ["chunking", "failed"], "chunking": ["embedding", "complete", "failed"], "embedding": ["summarizing", "complete", "failed"], "summarizing": ["complete", "failed"], "complete": [], "failed": ["queued"]}


def latest(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Each key's newest change unless it deletes; order runs from old to new."""
    back = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return log.withColumn("__rn", F.row_number().over(back)).where("__rn = 1 and op <> 'D'").drop("__rn")


def tombstones(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Each key whose newest change deletes it, with that change; a key set again afterwards isn't among them."""
    back = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return log.withColumn("__rn", F.row_number().over(back)).where("__rn = 1 and op = 'D'").drop("__rn")


def append_new(rows: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """rows with those of new whose key they lack; of new rows that share a key the first by order.

    A writer that repeats itself after a failure so adds nothing twice. Null keys equal each other.
    """
    first = new.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    known = rows.select(*[F.col(f"`{k}`").alias(f"__known_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [first[k].eqNullSafe(known[f"__known_{k}"]) for k in keys])
    return rows.unionByName(first.join(known, same, "left_anti"))


def latest_with_kept(log: DataFrame, keys: list[str], order: list[Column], kept: list[str]) -> DataFrame:
    """As latest, where a null in a kept column leaves the value that was there before; a delete forgets it."""
    so_far = W.partitionBy(*keys).orderBy(*order)
    out = log.withColumn("__life", F.sum(F.when(F.col("op") == "D", 1).otherwise(0)).over(so_far))
    of_life = W.partitionBy(*keys, "__life").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for name in kept:
        out = out.withColumn(name, F.last(name, ignorenulls=True).over(of_life))
    return latest(out.drop("__life"), keys, *order)


def first_id(log: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The log with each key's first identifier on all its changes: an upsert keeps the row's identity."""
    return log.withColumn(name, F.first(name).over(W.partitionBy(*keys).orderBy(*order)))


def replace_collection(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Rows after a replacement: all of new, and old rows of owners that new doesn't name."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def partial_update(rows: DataFrame, patch: DataFrame, key: str, valid: dict[str, Column] | None = None) -> DataFrame:
    """rows with the values of patch (key and some of rows' columns; one row a key) put in their columns.

    Null keeps what was there, and so does a value for which its condition in valid, over the
    patch's columns, doesn't hold. Keys that rows don't have are left out; rows without a patch
    stay as they are.
    """
    names = [n for n in patch.columns if n != key]
    sound = [F.when((valid or {}).get(n, F.lit(True)), F.col(f"`{n}`")).alias(f"__new_{n}") for n in names]
    both = rows.join(patch.select(F.col(f"`{key}`").alias("__key"), *sound), F.col(f"`{key}`") == F.col("__key"), "left")
    return both.select(*[F.coalesce(f"`__new_{n}`", f"`{n}`").alias(n) if n in names else F.col(f"`{n}`") for n in rows.columns])


def cascade(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent stays."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def set_null(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows with the reference to a deleted parent taken out."""
    gone = deleted.select(F.col(key).alias("__k")).distinct().withColumn("__gone", F.lit(True))
    return rows.join(gone, F.col(key) == F.col("__k"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__k", "__gone")


def job_states(log: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Each job's state: key, status, started_at (its first working state, once), completed_at (when it ended)."""
    working = F.col(status).isin("extracting", "chunking", "embedding")
    ended = F.col(status).isin("complete", "failed")
    return log.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias("status"), F.min(F.when(working, F.col(at))).alias("started_at"), F.max(F.when(ended, F.col(at))).alias("completed_at"))


def can_transition(was: Column, to: Column) -> Column:
    table = F.create_map(*[x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, was), to), F.lit(False))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no result yet under the same keys: a rerun does nothing twice."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
