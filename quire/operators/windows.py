"""Folds over a document's order, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def renumber(df: DataFrame, key: str, *order: Column, name: str = "sequence_id") -> DataFrame:
    """A gap-free sequence from 1 within each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def heading_paths(df: DataFrame, key: str, at: str, level: str, text: str, max_depth: int = 6) -> DataFrame:
    """Adds heading_path: what remains of the headings so far when each cuts the path above its level.

    level is null on rows that are no headings. With k the number of headings so far, the
    depth is k plus the least of level - k (at most 0), a running minimum; the entry at each
    depth is the last heading that had it.
    """
    so_far = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    k = F.count(level).over(so_far)
    out = df.withColumn("__k", k).withColumn("__slack", F.min(F.when(F.col(level).isNotNull(), F.col(level) - F.col("__k"))).over(so_far))
    out = out.withColumn("__depth", F.col("__k") + F.least(F.lit(0), F.coalesce("__slack", F.lit(0))))
    for i in range(1, max_depth + 1):
        own = F.when(F.col(level).isNotNull() & (F.col("__depth") == i), F.col(text))
        out = out.withColumn(f"__p{i}", F.last(own, ignorenulls=True).over(so_far))
    parts = [F.when(F.col("__depth") >= i, F.col(f"__p{i}")) for i in range(1, max_depth + 1)]
    return out.withColumn("heading_path", F.array_compact(F.array(*parts))).drop("__k", "__slack", "__depth", *[f"__p{i}" for i in range(1, max_depth + 1)])


def chapter_ranges(starts: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Ranges from one start to before the next, the last to the document's end, and front matter before the first.

    starts: key, title, start; bounds: key, lo, hi. Columns key, index, title, start, end, chunk_count.
    """
    s = starts.join(bounds, key)
    first = F.min("start").over(W.partitionBy(key))
    front = s.withColumn("first", first).where("first > lo").groupBy(key).agg(F.min("lo").alias("start"), (F.min("first") - 1).alias("end")).withColumn("title", F.lit("Front matter"))
    nxt = F.lead("start").over(W.partitionBy(key).orderBy("start"))
    body = s.select(key, "title", "start", F.coalesce(nxt - 1, F.col("hi")).alias("end"))
    both = body.unionByName(front)
    return both.withColumn("index", F.row_number().over(W.partitionBy(key).orderBy("start")) - 1).withColumn("chunk_count", F.col("end") - F.col("start") + 1)


def section_islands(df: DataFrame, key: str, at: str, depth: str) -> DataFrame:
    """Adds section (null before the first): a heading of depth 1 starts one, one of depth 2 only while no depth 1 has come."""
    so_far = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = F.sum(F.when(F.col(depth) == 1, 1).otherwise(0)).over(so_far)
    start = F.when((F.col(depth) == 1) | ((F.col(depth) == 2) & (F.col("__tops") == 0)), 1).otherwise(0)
    out = df.withColumn("__tops", tops).withColumn("__start", start).withColumn("__n", F.sum("__start").over(so_far))
    return out.withColumn("section", F.when(F.col("__n") > 0, F.col("__n"))).drop("__tops", "__start", "__n")


def pair_with_question(turns: DataFrame, key: str, at: str, root: Column | None = None) -> DataFrame:
    """Assistant turns with the user turn before them; pairs whose question is the thread's root are left out."""
    before = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col(at)), ignorenulls=True).over(before)
    out = turns.withColumn("question_at", asked).where((F.col("role") == "assistant") & F.col("question_at").isNotNull())
    return out if root is None else out.where(F.col("question_at") != root)


def history_window(turns: DataFrame, key: str, at: str, max_turns: int, compaction: Column, cut: int) -> DataFrame:
    """The last max_turns turns after the newest compaction, which comes first; texts are cut."""
    whole = W.partitionBy(key)
    t = turns.withColumn("__c", F.max(F.when(compaction, F.col(at))).over(whole))
    recent = t.where(F.col("__c").isNull() | (F.col(at) >= F.col("__c")))
    back = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc()))
    kept = recent.withColumn("__b", back).where((F.col("__b") <= max_turns) | (F.col(at) == F.col("__c")))
    return kept.withColumn("text", F.substring("text", 1, cut)).drop("__c", "__b")


def recent(turns: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """Each key's last n rows."""
    return turns.withColumn("__b", F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc()))).where(F.col("__b") <= n).drop("__b")


def stack_cards(cards: DataFrame, key: list[str], at: str, desired: str, height: str, gap: int) -> DataFrame:
    """Adds top: each card as near to its desired place as those above it leave room for.

    top = max(desired, cursor) with the cursor below the previous card, which is S plus the
    running maximum of desired - S, where S is the height of all cards before.
    """
    w = W.partitionBy(*key).orderBy(at)
    out = cards.withColumn("__s", F.sum(F.col(height) + gap).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(height) - gap)
    lead = F.max(F.col(desired) - F.col("__s")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("top", F.col("__s") + lead).drop("__s")


def page_batches(blocks: DataFrame, key: str, page: str, size: int) -> DataFrame:
    """Adds batch: groups of size pages in order; a missing page counts as page 1."""
    p = F.coalesce(page, F.lit(1))
    return blocks.withColumn("batch", F.floor((F.dense_rank().over(W.partitionBy(key).orderBy(p)) - 1) / size).cast("int"))


def section_inversions(sections: DataFrame, key: str, at: str, numbers: str) -> DataFrame:
    """Rows whose section number is smaller than the one before: the order runs backwards there."""
    before = F.lag(numbers).over(W.partitionBy(key).orderBy(at))
    return sections.withColumn("__b", before).where(F.col("__b").isNotNull() & (F.col(numbers) < F.col("__b"))).drop("__b")
