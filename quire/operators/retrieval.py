"""Vector, full-text and hybrid retrieval over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def shape_vector(v: Column, size: int) -> Column:
    """Cut and made a unit vector again if longer, padded with zeros if shorter."""
    cut = F.slice(v, 1, size)
    norm = F.sqrt(dot(cut, cut))
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.when(F.size(v) > size, F.transform(cut, lambda x: x / norm)).otherwise(F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(v)))))


def response_vectors(items: Column, inputs: Column, size: int) -> Column:
    """Vectors of a model's response (array of index, embedding) in the order of its inputs, each shaped to size; an error if their number differs."""
    ordered = F.array_sort(F.transform(items, lambda e: F.struct(e["index"].alias("index"), e["embedding"].alias("embedding"))))
    right = F.transform(ordered, lambda e: shape_vector(e["embedding"], size))
    return F.when(F.size(items) == inputs, right).otherwise(F.raise_error(F.concat(F.lit("embeddings: "), F.size(items).cast("string"), F.lit(" for inputs: "), inputs.cast("string"))).cast("array<array<double>>"))


def cosine_top_k(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """id, similarity of the k rows most like one vector; one pass, and k rows a task to merge."""
    scored = vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6)).where("similarity is not null")
    return scored.orderBy(F.col("similarity").desc(), "id").limit(k).select("id", "similarity")


def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """id, similarity, rrf_score: reciprocal ranks of two lists (id, similarity) and (id, rank) added up.

    Of either list, the first max(3 * limit, 15) count. Without text hits the vector list stands
    as it is, with null scores. Rows of the text list alone have similarity 0; ties keep the
    vector list's order.
    """
    fetch = max(3 * limit, 15)
    v = by_vector.orderBy(F.col("similarity").desc(), "id").limit(fetch).withColumn("vr", F.row_number().over(W.orderBy(F.col("similarity").desc(), "id")) - 1)
    f = by_text.orderBy(F.col("rank").desc(), "id").limit(fetch).withColumn("fr", F.row_number().over(W.orderBy(F.col("rank").desc(), "id")) - 1).select("id", "fr")
    any_text = f.agg((F.count("*") > 0).alias("any_text"))
    both = v.select("id", "similarity", "vr").join(f, "id", "full_outer").crossJoin(F.broadcast(any_text))
    part = lambda r: F.coalesce(F.lit(1.0) / (k + F.col(r) + 1), F.lit(0.0))
    score = F.when(F.col("any_text"), part("vr") + part("fr"))
    ranked = both.withColumn("rrf_score", F.round(score, 9)).orderBy(F.col("rrf_score").desc_nulls_last(), F.col("vr").asc_nulls_last(), F.col("fr").asc_nulls_last())
    return ranked.limit(limit).select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "rrf_score")


def figure_hits(ranked: DataFrame, assets: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Ranked chunks (id, similarity) that have images, else the first figures in document order: id, images.

    The chunks that are wanted are found first, and only their images are nested.
    """
    near = ranked.join(assets.select("id"), "id", "left_semi").select("id", F.lit(0).alias("leg"), (-F.col("similarity")).alias("o"))
    rest = chunks.join(assets.select("id"), "id", "left_semi").orderBy("sequence_id").limit(limit).select("id", F.lit(1).alias("leg"), F.col("sequence_id").cast("double").alias("o"))
    both = near.union(rest).withColumn("first_leg", F.min("leg").over(W.partitionBy()))
    wanted = both.where("leg = first_leg").orderBy("o", "id").limit(limit)
    images = assets.join(F.broadcast(wanted), "id").groupBy("id", "o").agg(F.array_sort(F.collect_list("image")).alias("images"))  # limit rows
    return images.orderBy("o", "id").select("id", "images")
