"""Relational reads: lookups, ranges, paging, latest and first per group, band joins, nests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; one shuffle, with a group limit before it."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def band_join(anchors: DataFrame, rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Rows of the same key at most width away from an anchor (columns anchor_<at>).

    Both sides are cut into cells of the band's width, and an anchor meets three cells,
    so it is an equi-join whose cells are small even where a key has very many rows.
    """
    cell = lambda c: F.floor(F.col(c) / (width + 1))
    a = anchors.select(F.col(key), F.col(at).alias(f"anchor_{at}"))
    a = a.withColumn("__cell", F.explode(F.array(*[cell(f"anchor_{at}") + i for i in (-1, 0, 1)])))
    r = rows.withColumn("__cell", cell(at))
    return a.join(r, [key, "__cell"]).where(F.abs(F.col(at) - F.col(f"anchor_{at}")) <= width).drop("__cell")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an order; TakeOrderedAndProject, so only limit + offset rows meet."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def neighbours(df: DataFrame, key: str, at: str) -> DataFrame:
    """Every row's previous and next position within its key."""
    w = W.partitionBy(key).orderBy(at)
    return df.withColumn("prev_at", F.lag(at).over(w)).withColumn("next_at", F.lead(at).over(w))


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array in a given order, empty where there are none."""
    of = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("__c"))
    nested = F.transform(F.col("__c"), lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    empty = F.array().cast(children.select(F.array(F.struct(*fields)).alias("x")).schema["x"].dataType)
    return parents.join(of, key, "left").withColumn(name, F.coalesce(nested, empty)).drop("__c")


def chapter_level(levels: DataFrame, key: str, level: str) -> DataFrame:
    """The smallest heading level that occurs at least twice, else the smallest, of each key."""
    counts = levels.groupBy(key, level).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col(level))), F.min(level)).alias("chapter_level"))


def claim_first(members: DataFrame, collection: str, position: str, member_position: str, member: str, least: int = 2) -> DataFrame:
    """Members kept when each may be in one collection only: the first one claims it.

    Duplicates go before collections of fewer than least members do, so a member stays
    claimed by a collection that is dropped. Positions are renumbered from 0.
    """
    kept = latest_per(members, member, F.col(position), F.col(member_position))
    size = F.count("*").over(W.partitionBy(collection))
    kept = kept.withColumn("__n", size).where(F.col("__n") >= least).drop("__n")
    return kept.withColumn("ordinal", F.row_number().over(W.partitionBy(collection).orderBy(member_position)) - 1)


def margin_side(notes: DataFrame, key: str, at: str, side: str, reach: int = 6) -> DataFrame:
    """The side with fewer notes within reach of each anchor; ties go right. Columns key, at, chosen.

    Notes are counted by place first, then summed over a range of places: one shuffle of counts.
    """
    count = lambda s: F.count(F.when(F.col(side) == s, 1))
    places = notes.groupBy(key, at).agg(count("left").alias("l"), count("right").alias("r"))
    near = W.partitionBy(key).orderBy(at).rangeBetween(-reach, reach)
    return places.select(key, at, F.when(F.sum("r").over(near) > F.sum("l").over(near), "left").otherwise("right").alias("chosen"))


def link_assets(chunks: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """key, place, ref, asset_id: each image that a chunk (key, image_refs) names, with the asset whose original name it is.

    Of assets (asset_id, original_name) that share a name, the smallest id is linked; a name
    that no asset has is left out.
    """
    known = assets.groupBy("original_name").agg(F.min("asset_id").alias("asset_id"))
    refs = chunks.select(key, F.posexplode("image_refs").alias("place", "ref"))
    return refs.join(known, F.col("ref") == F.col("original_name")).select(key, "place", "ref", "asset_id")


def embedding_gate(chunks: DataFrame, documents: DataFrame, max_tokens: int, enabled: bool = True) -> DataFrame:
    """Whether each document's embeddings can be skipped, and why: feature, kind, no count, too large, fits."""
    total = F.coalesce(F.sum("token_count"), F.lit(0)).cast("long")
    sums = chunks.groupBy("document_id").agg(total.alias("total"))
    d = documents.join(sums, "document_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    reason = (
        F.when(F.lit(not enabled), "feature_disabled").when(F.col("doc_kind") == "book", "doc_kind=book").when(F.col("total") == 0, "no_token_count")
        .when(F.col("total") > max_tokens, F.format_string(f"too_large(%d>{max_tokens})", "total")).otherwise(F.format_string(f"fits(%d<={max_tokens})", "total"))
    )
    return d.select("document_id", reason.alias("reason"), reason.startswith("fits").alias("skip"))


def merge_order(proposed: Column, known: Column) -> Column:
    """A proposed order of ids, first mention wins, with what it misses in ascending order after it."""
    return F.array_distinct(F.concat(proposed, F.array_sort(F.array_except(known, proposed))))


def keep_first_by_url(results: DataFrame, limit: int) -> DataFrame:
    """Search results with a URL, the first of each, by descending score (missing: 0); snippets cut at 500."""
    r = results.where(F.coalesce("url", F.lit("")) != "")
    r = latest_per(r, "url", F.col("position")).withColumn("score", F.coalesce("score", F.lit(0.0)))
    snippet = F.when(F.length("snippet") > 500, F.concat(F.substring("snippet", 1, 500), F.lit("..."))).otherwise(F.col("snippet"))
    return r.withColumn("snippet", snippet).orderBy(F.col("score").desc(), "position").limit(limit)
