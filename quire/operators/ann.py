"""Approximate nearest vectors from lists of product-quantised residuals.

Centroids, about the square root of the number of vectors, deal the unit vectors to lists. What
is left of a vector after its centroid is cut into sub-vectors, and each is told by the nearest
of CODES code words: a vector is then a few bytes. A query adds up, from a small table, what each
code word gives with its own sub-vectors, over the lists nearest to it; the exact vectors are
read of the best REFINED candidates a neighbour wanted only, and ranked by exact cosine.

Centroids and code words are fitted to a sample of a bounded size; every vector is in the index.
Lists and queries meet in cells of bounded size: long lists are cut by a hash, queries are dealt
to blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..scratch import new_folder
from .retrieval import cosine, dot

#: Vectors that centroids and code words are fitted to at most, and lists at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Components of a sub-vector, code words of one, and rounds of fitting.
PART, CODES, ROUNDS = 4, 128, 8
#: Lists that are probed of ten: vectors without clusters, as the driver's are, ask for most of them; clustered ones for far fewer.
PROBED = 8
#: Exact vectors that are read for each neighbour wanted.
REFINED = 6
#: Vectors of a list, and queries, that meet in a cell at most, about.
CELL = 4096
STORED = "id long, list int, code binary, unit array<float>"


@dataclass
class Quantiser:
    centroids: np.ndarray
    books: np.ndarray  # sub-vectors x CODES x PART

    def near(self, units: np.ndarray, lists: int) -> np.ndarray:
        """For each vector the lists whose centroids are nearest, the nearest first."""
        return np.argsort(-(units @ self.centroids.T) + 0.5 * (self.centroids**2).sum(1), axis=1, kind="stable")[:, :lists]

    def codes(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = _cut(units - self.centroids[lists], self.books.shape[2])
        return np.stack([_nearest(left[:, s], self.books[s]) for s in range(len(self.books))], 1).astype(np.uint8)


@dataclass
class Index:
    """The stored vectors (STORED), what their codes mean, and the length of each list."""

    path: str
    quantiser: Quantiser | None
    sizes: dict[int, int]


def _cut(x: np.ndarray, part: int) -> np.ndarray:
    """rows x sub-vectors x part, zeros at the end."""
    more = -x.shape[1] % part
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, part)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k means of x, from rows of it; centres that nothing is near stay where they are."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(at, x[:, d], k) / np.maximum(n, 1), c[:, d])
    return c


def _unit(vectors: DataFrame) -> DataFrame:
    """id, unit of vectors (id, embedding) that are not null, empty or zero."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.where(norm > 0).select("id", F.transform("embedding", lambda v: (v / norm).cast("float")).alias("unit"))


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """The index of vectors (id, embedding) in the shared folder; lists: the square root of their number unless told otherwise.

    Vectors that are null or have no direction are in no list. All vectors have one length.
    """
    spark, path = vectors.sparkSession, new_folder(vectors.sparkSession, "vectors")
    units = _unit(vectors)
    n = units.count()
    few = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["unit"]
    if not len(few):
        spark.createDataFrame([], STORED).write.parquet(path)
        return Index(path, None, {})
    x = np.stack(few).astype(float)
    centroids = _centres(x, min(lists or math.ceil(math.sqrt(n)), MOST_LISTS, len(x)))
    left = _cut(x - centroids[_nearest(x, centroids)], PART)
    quantiser = Quantiser(centroids, np.stack([_centres(left[:, s], min(CODES, len(x))) for s in range(left.shape[1])]))
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = np.array(batch.column(1).to_pylist(), float)
                at = shared.value.near(u, 1)[:, 0]
                code = [c.tobytes() for c in shared.value.codes(u, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(code, pa.binary()), batch.column(1)], names=["id", "list", "code", "unit"])

    units.mapInArrow(encode, STORED).repartitionByRange("list", "id").sortWithinPartitions("list").write.parquet(path)
    sizes = spark.read.schema(STORED).parquet(path).groupBy("list").count().collect()
    return Index(path, quantiser, {r["list"]: r["count"] for r in sizes})


def candidates(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, id, q: for each query (id, embedding) the REFINED * k others that the codes of the lists nearest to it promise most of."""
    spark, quantiser, most = queries.sparkSession, index.quantiser, REFINED * k
    probes = probes or -(-PROBED * len(quantiser.centroids) // 10)
    shared = spark.sparkContext.broadcast(quantiser)
    asked = _unit(queries)
    blocks = max(1, math.ceil(asked.count() / CELL))
    slices = F.create_map(*[F.lit(v) for kv in sorted(index.sizes.items()) for v in (kv[0], math.ceil(kv[1] / CELL))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.near(np.array(batch.column(1).to_pylist(), float), probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    probed = asked.mapInArrow(probe, "query_id long, q array<float>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    probed = probed.withColumn("slice", F.explode(F.sequence(F.lit(1), F.coalesce(F.try_element_at(slices, "list"), F.lit(1)))))
    codes = spark.read.schema(STORED).parquet(index.path).select("id", "list", "code", (F.pmod(F.xxhash64("id"), F.try_element_at(slices, "list")) + 1).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def promise(own: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(listed):
            books, ids = shared.value.books, listed["id"].to_numpy()
            code = np.frombuffer(b"".join(listed["code"]), np.uint8).reshape(len(listed), -1).astype(int)
            centroid = shared.value.centroids[int(listed["list"].iloc[0])]
            for query, q in zip(own["query_id"], own["q"]):
                q = np.asarray(q, float)
                gives = np.einsum("scp,sp->sc", books, _cut(q[None], books.shape[2])[0])
                said = gives[np.arange(len(books)), code].sum(1) + q @ centroid
                said[ids == query] = -np.inf
                best = np.argsort(-said, kind="stable")[:most]
                out.append(pd.DataFrame({"query_id": query, "id": ids[best], "promise": said[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "promise": pd.Series(dtype=float)})

    cell = ["list", "slice", "block"]
    found = probed.groupBy(*cell).cogroup(codes.groupBy(*cell)).applyInPandas(promise, "query_id long, id long, promise double").where("promise > -2")
    best = W.partitionBy("query_id").orderBy(F.col("promise").desc(), "id")
    few = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("query_id", "id")
    return few.join(asked.withColumnsRenamed({"id": "query_id", "unit": "q"}), "query_id")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, rank, id, similarity: for each query (id, embedding) about the k most like, itself left out; PROBED of ten lists unless told otherwise. Queries without direction have no row."""
    stored = queries.sparkSession.read.schema(STORED).parquet(index.path).select("id", "unit")
    if index.quantiser is None:
        return stored.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("similarity"))
    scored = candidates(index, queries, k, probes).join(stored, "id").select("query_id", "id", F.round(cosine(F.col("q"), F.col("unit")), 6).alias("similarity"))
    best = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
