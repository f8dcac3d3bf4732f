"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are quantised to integers. An index segment holds a few thousand of them as
postings: for each impact level (the number of bits of a component's size) and each
dimension, the vectors whose component has that level, and the components. A block of
queries is run against a segment by adding up its posting lists from the highest impact
level down. After a level, what is missing from a score is at most the product of the
query's norm and the norm of the vector's components that are still to come, so every
score has a lower and an upper bound. The scan stops when few vectors, for each query,
have an upper bound that reaches its k-th best lower bound; only these can be among the
best, and they are scored again exactly.

Scale: segments are cut inside the input partitions, without a shuffle, and written to the
shared folder. Queries are dealt to groups of QUERY_GROUP, and the work is a grid of (segment,
group) cells, each of them a task's unit: a segment goes to as many cells as there are groups
and is read once in each, while the group's queries are run past it a block at a time.
Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, pick, table

SCALE, SEGMENT, QUERY_BLOCK, QUERY_GROUP = 1024, 8192, 256, 4096
#: Components of a segment at most: long vectors make segments of fewer.
SEGMENT_COMPONENTS = 1 << 20
#: Scores are added up in doubles, which are exact below this.
EXACT = float(1 << 53)
#: The scan stops when at most this share of the pairs may still be among the best.
RESCORE_SHARE = 0.02
INDEX_SCHEMA = "segment long, n int, dims int, n_queries int, ids binary, nulls binary, vectors binary, starts binary, docs binary, values binary"
HITS_SCHEMA = "query_segment long, query_row int, query_id long, vec_id long, score long"


def quantise(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of the usable vectors as doubles, zero-padded to dims, and which ones they are."""
    usable, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            usable.append(i)
            rows.append(np.floor(SCALE * x))
    out = np.zeros((len(rows), dims))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, np.array(usable, np.int64)


def postings(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists by descending impact level, then dimension: starts (level, dim, begin), vector numbers, components."""
    level = np.frexp(np.abs(x))[1] * (x != 0)
    docs, dims = np.nonzero(x)
    order = np.lexsort((docs, dims, -level[docs, dims]))
    docs, dims = docs[order], dims[order]
    lv = level[docs, dims]
    cut = np.flatnonzero(np.r_[True, (lv[1:] != lv[:-1]) | (dims[1:] != dims[:-1])]) if len(docs) else np.empty(0, np.int64)
    return np.stack([lv[cut], dims[cut], cut], 1).astype("<i8"), docs.astype("<i4"), x[docs, dims].astype("<f8")


def _indexer(every: int | None):
    def segment(number: int, ids: list, vectors: list) -> pa.RecordBatch:
        dims = max((len(v) for v in vectors if v is not None), default=0)
        x, used = quantise(vectors, dims)
        keys = [ids[i] for i in used]
        starts, docs, values = postings(x)
        chosen = sum(1 for i in keys if i is not None and (every is None or i % every == 0))
        row = (
            (TaskContext.get().partitionId() << 32) + number, len(keys), dims, chosen, np.array([i or 0 for i in keys], "<i8").tobytes(),
            np.array([i is None for i in keys], np.uint8).tobytes(), x.astype("<f8").tobytes(), starts.tobytes(), docs.tobytes(), values.tobytes(),
        )
        kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        number = 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            longest = max((len(v) for v in vectors if v is not None), default=1)
            most = max(1, min(SEGMENT, SEGMENT_COMPONENTS // max(1, longest)))
            while len(ids) >= most:
                yield segment(number, ids[:most], vectors[:most])
                ids, vectors, number = ids[most:], vectors[most:], number + 1
        if ids:
            yield segment(number, ids, vectors)

    return run


def build_index(vectors: DataFrame, every: int | None) -> DataFrame:
    """Index segments of vectors (vec_id, embedding); every: ids divisible by it are queries, None: all."""
    return pick(vectors, ["vec_id", "embedding"]).mapInArrow(_indexer(every), INDEX_SCHEMA)


def _query_blocks(every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                nulls = np.frombuffer(r["nulls"], np.uint8)
                rows = np.flatnonzero((nulls == 0) & (True if every is None else ids % every == 0))
                x = np.frombuffer(r["vectors"], "<f8").reshape(len(ids), r["dims"])
                for at in range(0, len(rows), QUERY_BLOCK):
                    k = rows[at : at + QUERY_BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([r["segment"]]), pa.array([r["dims"]], pa.int32()), pa.array([ids[k].tobytes()]), pa.array([k.astype("<i4").tobytes()]), pa.array([x[k].tobytes()])], names=["q_segment", "q_dims", "q_ids", "q_rows", "q_vectors"])

    return run


def search_segment(q: np.ndarray, x: np.ndarray, starts: np.ndarray, docs: np.ndarray, values: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
    """For each query, the numbers of all vectors that can be among its k best; own: its own number, or -1.

    q (queries, dims), x (vectors, dims) integers in doubles, of equal width.
    """
    n, m = len(x), len(q)
    acc = np.zeros((n, m))
    qt = np.ascontiguousarray(q.T)
    q_norm = np.sqrt((q * q).sum(1))
    left = (x * x).sum(1)
    # beyond what doubles hold exactly, allow for rounding; 0 otherwise
    whole = np.where(left * (q_norm**2).max(initial=0) < EXACT**2 / max(1, x.shape[1]), 0, left)
    top = float(1 << 63)  # scores are held to the range of a long, and tie at its ends
    allowed = np.ones((n, m), bool)
    has = own >= 0
    allowed[own[has], np.flatnonzero(has)] = False
    ends = np.r_[starts[1:, 2], len(docs)] if len(starts) else np.empty(0, np.int64)
    want = min(k, n)
    maybe = allowed
    i = 0
    while i < len(starts):
        level = starts[i, 0]
        while i < len(starts) and starts[i, 0] == level:
            d, b, e = starts[i, 1], starts[i, 2], ends[i]
            who, v = docs[b:e], values[b:e]
            acc[who] += v[:, None] * qt[d]
            left[who] -= v * v
            i += 1
        # a level's postings are in; bound what is still to come (a unit more than rounding can lose)
        slack = (np.sqrt(np.maximum(left, 0) + 1e-10 * whole) + 1e-10 * np.sqrt(whole))[:, None] * q_norm * (1 + 1e-12) + 1
        low = np.where(allowed, np.clip(acc - slack, -top, top), -np.inf)
        bar = np.partition(low, n - want, axis=0)[n - want]
        maybe = allowed & (np.clip(acc + slack, -top, top) >= bar)
        if maybe.sum() <= max(RESCORE_SHARE * n * m, k * m):
            break
    return [np.flatnonzero(maybe[:, j]) for j in range(m)]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q; doubles where these are exact, else Python's integers, held to the range of a long."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in x.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in whole], np.int64)


def _search(k: int):
    """Hits of a cell: the segments of one side, each against all queries of the other."""

    def run(segments: pa.Table, queries: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in HITS_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
        empty = pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        tables = [empty]
        blocks = queries.to_pylist()
        for r in segments.to_pylist():
            dims = max([r["dims"], *(q["q_dims"] for q in blocks)])
            n, ids, nulls = r["n"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8).astype(bool)
            x = np.zeros((n, dims))
            x[:, : r["dims"]] = np.frombuffer(r["vectors"], "<f8").reshape(n, r["dims"])
            lists = np.frombuffer(r["starts"], "<i8").reshape(-1, 3), np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["values"], "<f8")
            for at, block in _blocks_of(blocks):
                q = np.zeros((len(at), dims))
                own, homes, rows, q_ids = np.full(len(at), -1), [], [], []
                for b, first, last in block:
                    o = len(rows)
                    here = slice(o, o + last - first)
                    q[here, : b["q_dims"]] = np.frombuffer(b["q_vectors"], "<f8").reshape(-1, b["q_dims"])[first:last]
                    rows += np.frombuffer(b["q_rows"], "<i4")[first:last].tolist()
                    q_ids += np.frombuffer(b["q_ids"], "<i8")[first:last].tolist()
                    homes += [b["q_segment"]] * (last - first)
                    if b["q_segment"] == r["segment"]:
                        own[here] = rows[here]
                out: list[tuple] = []
                for j, who in enumerate(search_segment(q, x, *lists, k, own)):
                    scores = exact_scores(x[who], q[j])
                    best = np.lexsort((ids[who], nulls[who], -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[:k]
                    out += [(homes[j], rows[j], q_ids[j], None if nulls[who[b]] else int(ids[who[b]]), int(scores[b])) for b in best]
                if out:
                    tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names))
        return pa.concat_tables(tables)

    return run


def _blocks_of(blocks: list[dict]) -> Iterator[tuple[range, list[tuple[dict, int, int]]]]:
    """Runs of at most QUERY_BLOCK queries, as spans of the rows that hold them."""
    held: list[tuple[dict, int, int]] = []
    size = 0
    for b in blocks:
        n, first = len(b["q_ids"]) // 8, 0
        while first < n:
            last = min(n, first + QUERY_BLOCK - size)
            held.append((b, first, last))
            size, first = size + last - first, last
            if size == QUERY_BLOCK:
                yield range(size), held
                held, size = [], 0
    if held:
        yield range(size), held


def top_k(vectors: DataFrame, k: int = 10, every: int | None = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other rows.

    vectors: vec_id, embedding; other columns are ignored. Components are floor(1024 * x);
    shorter vectors count as padded with zeros. Vectors that are null or hold null or
    non-finite components take no part, as query or as candidate; an empty vector scores 0.
    Ties go to the smaller vec_id, null last. A repeated row is a candidate for its copies,
    and each copy is a query. Scores beyond a long are held to its range. With fewer than k
    other rows all are returned; an empty table gives no rows.
    """
    index = materialize(build_index(vectors, every), "topk-index").where("n > 0")
    segments, wanted = index.agg(F.count("*"), F.coalesce(F.sum("n_queries"), F.lit(0))).first()
    groups = max(1, -(-wanted // QUERY_GROUP))
    queries = index.where("n_queries > 0").select("segment", "dims", "ids", "nulls", "vectors").mapInArrow(_query_blocks(every), "q_segment long, q_dims int, q_ids binary, q_rows binary, q_vectors binary")
    # every group of queries meets every cell of segments, which is one segment, or a few that share a hash
    queries = queries.withColumn("q_group", F.pmod(F.xxhash64("q_segment", "q_rows"), F.lit(groups))).withColumn("cell", F.explode(F.expr(f"sequence(0L, {max(1, segments) - 1}L)")))
    dealt = index.drop("n_queries").withColumn("cell", F.pmod(F.xxhash64("segment"), F.lit(max(1, segments)))).withColumn("q_group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    hits = dealt.groupBy("cell", "q_group").cogroup(queries.groupBy("cell", "q_group")).applyInArrow(_search(k), HITS_SCHEMA)
    best = W.partitionBy("query_segment", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows by integer inner product for every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), 10, 100)


SQL = {
    "op8_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z : z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""
}
QUERIES = {"op8_exact_topk": op8_exact_topk}
