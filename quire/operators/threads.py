"""Conversation and note trees, of any depth and size, by pointer doubling.

Every node first points at its parent; in each round it takes over what the node that it
points at has found, and points at what that one points at. A round is one join of rows that
are not done yet, and a tree of depth d takes about log2(d) rounds, each written to the
shared folder. Nodes whose ancestors run in a circle never get done and are told by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..scratch import materialize


def climb(tree: DataFrame) -> DataFrame:
    """Per node of tree (id, parent_id): depth (ancestors, an absent parent counting as one), top (the highest node there is), orphan (an ancestor is absent), circle.

    In a circle, or below one, depth and top are null. Ids identify nodes.
    """
    state = tree.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("id").alias("top"), F.lit(False).alias("orphan"))
    state = materialize(state, "tree")
    nodes, reach = state.count(), 1
    while reach <= nodes and not state.where("up is not null").isEmpty():
        upper = state.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"), F.col("top").alias("u_top"), F.col("orphan").alias("u_orphan"))
        met = state.where("up is not null").join(upper, F.col("up") == F.col("u_id"), "left")
        found = F.col("u_id").isNotNull()
        met = met.select(
            "id", F.col("u_up").alias("up"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"),
            F.when(found, F.col("u_top")).otherwise(F.col("top")).alias("top"), F.when(found, F.col("u_orphan")).otherwise(True).alias("orphan"),
        )
        state, reach = materialize(state.where("up is null").union(met), "tree"), 2 * reach
    circle = F.col("up").isNotNull()
    return state.select("id", F.when(~circle, F.col("depth")).alias("depth"), F.when(~circle, F.col("top")).alias("top"), F.when(~circle, F.col("orphan")).otherwise(False).alias("orphan"), circle.alias("circle"))


def _below(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) of what lies below seeds (seed, id), these included.

    A node gathers the seeds among its ancestors, so the work is that of the result. Nodes
    in or below a circle have none.
    """
    climbed = climb(tree)
    planted = seeds.groupBy("id").agg(F.collect_set("seed").alias("s"))
    none = F.array().cast("array<struct<seed: bigint, depth: bigint>>")
    at_node = F.transform("s", lambda s: F.struct(s.cast("long").alias("seed"), F.lit(0).cast("long").alias("depth")))
    live = tree.join(climbed.where("not circle").select("id"), "id", "left_semi")
    state = live.join(planted, "id", "left").select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.coalesce(at_node, none).alias("seeds"))
    state = materialize(state, "tree-seeds")
    while not state.where("up is not null").isEmpty():
        upper = state.select(F.col("id").alias("u_id"), F.col("up").alias("u_up"), F.col("steps").alias("u_steps"), F.col("seeds").alias("u_seeds"))
        met = state.where("up is not null").join(upper, F.col("up") == F.col("u_id"), "left")
        shifted = F.transform(F.coalesce("u_seeds", none), lambda x: F.struct(x["seed"].alias("seed"), (x["depth"] + F.col("steps")).alias("depth")))
        met = met.withColumn("seeds", F.concat("seeds", shifted)).select("id", F.col("u_up").alias("up"), (F.col("steps") + F.coalesce("u_steps", F.lit(0))).alias("steps"), "seeds")
        state = materialize(state.where("up is null").union(met), "tree-seeds")
    return state.select("id", F.explode("seeds").alias("x")).select("x.seed", "id", "x.depth")


def ancestor_depth(tree: DataFrame) -> DataFrame:
    """id and depth: how many ancestors each node has; null in or below a circle."""
    return climb(tree).select("id", "depth")


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth of each root's subtree, itself included; nodes in or below a circle are in none."""
    return _below(tree, roots.select(F.col("id").alias("seed"), "id")).select(F.col("seed").alias("root"), "id", "depth")


def first_reply(turns: DataFrame, conv: str, at: str) -> DataFrame:
    """For each user turn the first assistant turn at or after it in its conversation: id, reply_id."""
    back = W.partitionBy(conv).orderBy(F.col(at).desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    reply = F.last(F.when(F.col("role") == "assistant", F.col("id")), ignorenulls=True).over(back)
    return turns.withColumn("reply_id", reply).where(F.col("role") == "user").select("id", "reply_id")


def thread_subtree(turns: DataFrame, conv: str, at: str, roots: DataFrame) -> DataFrame:
    """root, id of each root's thread: the root, the first reply to it if it has no parent, and all below either."""
    r = turns.join(roots.select("id"), "id", "left_semi")
    top = r.where("parent_id is null").select("id").join(first_reply(turns, conv, at), "id").where("reply_id is not null")
    seeds = r.select(F.col("id").alias("seed"), "id").union(top.select(F.col("id").alias("seed"), F.col("reply_id").alias("id")))
    return _below(turns, seeds).select(F.col("seed").alias("root"), "id").distinct()


def root_of_each(tree: DataFrame) -> DataFrame:
    """id, root of every node below a root; orphans and nodes in circles are left out."""
    return climb(tree).where("not circle and not orphan").select("id", F.col("top").alias("root"))


def may_reply(tree: DataFrame, limit: int = 3) -> DataFrame:
    """id, allowed: a reply to this node stays within the depth limit; never in a circle."""
    return climb(tree).select("id", F.coalesce(F.col("depth") + 1 <= limit, F.lit(False)).alias("allowed"))
