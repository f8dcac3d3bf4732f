"""Target-distribution importance resampling over hashed word features.

Documents and a target corpus become sparse row-by-bucket count matrices, kept as blocks of
compressed sparse rows (row pointers, column indices, counts). Column sums of the two give
smoothed distributions; the floored log ratio of a bucket is its gain, and the product of the
documents' matrix with the vector of gains is their log importance weight. Gumbel noise from a
hash of the document's id is added, and the highest scores are a draw without replacement.

Words are runs of letters of ASCII, digits and everything beyond ASCII, with A-Z lower-cased;
features are all runs of 1 to `longest` consecutive words, joined by one space, and a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets.

Scale: texts are read once and never shuffled; a block is one row of the matrix table in the
shared folder, and both passes over it (column sums, product) are map-side, with numpy. What
meets in a shuffle is a task's column sums. Gains, one number a bucket, reach the driver and go
out to the tasks: their size is a parameter, not the corpus. The draw is a range sort of
numbers; one row a range meets in a window.

Null or empty text has no features, weight 0, and is never drawn unless min_words is 0. A null
id is read as empty text by the hash; repeated rows and ids are documents of their own, and rows
that tie in score and id are drawn by their numbers of features. Other columns are ignored. An
empty corpus gives no rows; an empty target gives gains from the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, parts, remembered, table

#: A block ends after so many rows or so many stored counts.
BLOCK_ROWS, BLOCK_COUNTS = 4096, 1 << 20
#: Bytes of a text that are cut into words at once; features whose buckets a worker remembers, and the bytes of the longest.
PIECE, REMEMBERED, LONGEST_KEPT = 1 << 22, 1 << 18, 64

_WORD_BYTE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BLOCKS = "ids array<bigint>, n_words binary, pointers binary, indices binary, counts binary"


def words_of(text: bytes) -> Iterator[bytes]:
    """The words of a whole text, cut piece by piece at what is no word."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        piece = text[start:stop].translate(_WORD_BYTE)
        if stop < len(text):
            at = piece.rfind(b" ") + 1
            while not at:  # a word longer than a piece
                stop += PIECE
                piece = text[start:stop].translate(_WORD_BYTE)
                at = piece.rfind(b" ") + 1 if stop < len(text) else len(piece)
            piece, stop = piece[:at], start + at
        yield from piece.split()
        start = stop


def features_of(words: Iterator[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    if longest == 1:
        yield from words
        return
    last: list[bytes] = []
    for w in words:
        last = [*last[-longest + 1 :], w]
        yield from (b" ".join(last[i:]) for i in range(len(last)))


def _row(text: bytes, buckets: int, longest: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket indices in ascending order, their counts, and the number of words of one text."""
    total, n_words = None, 0
    words = words_of(text)
    features = features_of(words, longest)
    while some := list(islice(features, PIECE // 8)):
        found = list(map(known.get, some))
        if None in found:
            for i in [i for i, b in enumerate(found) if b is None]:
                found[i] = zlib.crc32(some[i]) % buckets
                if len(some[i]) <= LONGEST_KEPT:
                    known[some[i]] = found[i]
            if len(known) > REMEMBERED:
                known.clear()
        n_words += len(some) if longest == 1 else sum(b" " not in f for f in some)
        if total is None and len(some) < PIECE // 8:
            index, counts = np.unique(found, return_counts=True)
            return index, counts, n_words
        total = np.bincount(found, minlength=buckets) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    index = np.flatnonzero(total)
    return index, total[index], n_words


def _to_blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("resampling").setdefault((buckets, longest), {})
        ids, rows, held = [], [], 0

        def block() -> pa.RecordBatch:
            pointers = np.cumsum([0, *(len(r[0]) for r in rows)]).astype("<i4")
            index = np.concatenate([r[0] for r in rows]).astype("<i4").tobytes()
            counts = np.concatenate([r[1] for r in rows]).astype("<i8").tobytes()
            n_words = np.array([r[2] for r in rows], "<i8").tobytes()
            cols = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in (n_words, pointers.tobytes(), index, counts))]
            return pa.RecordBatch.from_arrays(cols, names=["ids", "n_words", "pointers", "indices", "counts"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                rows.append(_row(text.as_py() or b"", buckets, longest, known))
                held += len(rows[-1][0])
                if len(rows) >= BLOCK_ROWS or held >= BLOCK_COUNTS:
                    yield block()
                    ids, rows, held = [], [], 0
        if rows:
            yield block()

    return run


def count_matrix(rows: DataFrame, ident: str, buckets: int, longest: int = 1) -> DataFrame:
    """Blocks of the sparse count matrix of rows' texts, in the shared folder: BLOCKS; little-endian integers."""
    slim = rows.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return materialize(slim.mapInArrow(_to_blocks(buckets, longest), BLOCKS), "count-matrix")


def column_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of a matrix, n over all rows; buckets without a count are left out. A task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for index, counts in zip(batch.column(0), batch.column(1)):
                np.add.at(sums, np.frombuffer(index.as_py(), "<i4"), np.frombuffer(counts.as_py(), "<i8"))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["bucket", "n"])

    return blocks.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of every bucket, target over corpus, from column sums."""
    spark = corpus.sparkSession
    side = lambda sums, k: sums.select("bucket", *[(F.col("n") if i == k else F.lit(0)).cast("long").alias(c) for i, c in enumerate("st")])
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = every.unionByName(side(corpus, 0)).unionByName(side(target, 1)).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).toPandas()
    share = lambda c: F.lit(float(counts[c].sum() + buckets))
    ratio = (F.col("t") + 1) * share("s") / ((F.col("s") + 1) * share("t"))
    found = spark.createDataFrame(counts).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"]] = found["gain"]
    return out


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """The matrix times the vector of gains: id, n_words, n_features, weight of every row."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            for ids, n_words, pointers, index, counts in zip(*batch.columns):
                at, n = np.frombuffer(pointers.as_py(), "<i4"), np.frombuffer(counts.as_py(), "<i8")
                row = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[at])
                cols = [pa.array(ids.as_py(), pa.int64()), *(pa.array(v, pa.int64()) for v in (np.frombuffer(n_words.as_py(), "<i8"), row(n), row(n * of[np.frombuffer(index.as_py(), "<i4")])))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(ident: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u a hash of seed and id in (0, 1)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296)) * -1000)


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored (id, n_features, weight, score, ...) with rank: of the eligible rows the floor(percent * N / 100) with the highest scores, from 1; null elsewhere."""
    spark, names = scored.sparkSession, scored.columns
    rows = materialize(scored.withColumn("eligible", eligible).withColumn("n", F.monotonically_increasing_id()), "resampling-scores")
    count = rows.where("eligible").count()
    order = [F.col("score").desc(), F.col("id"), F.col("n_features"), F.col("weight"), F.col("n")]
    ranged = rows.where("eligible").drop("eligible").repartitionByRange(parts(spark, 40 * count), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(*names, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "resampling-order")
    sums = ranged.groupBy("range").agg(F.count("*").alias("held"))
    sums = sums.select("range", (F.sum("held").over(W.orderBy("range")) - F.col("held")).alias("before"))  # one row a range
    place = F.col("before") + F.col("place") + 1
    ranked = ranged.join(sums, "range").select(*names, F.when(place <= percent * count // 100, place).alias("rank"))
    return ranked.unionByName(rows.where("not eligible").select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int, buckets: int = 10000, longest: int = 1, min_words: int = 20, seed: str = "2024", ident: str = "doc_id", target_ident: str = "item_id") -> DataFrame:
    """Every document with its weight, score and rank in the draw: id, n_words, n_features, weight, score, rank."""
    matrix = count_matrix(docs, ident, buckets, longest)
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, target_ident, buckets, longest), buckets), buckets)
    scored = weigh(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return draw(scored, F.col("n_words") >= min_words, percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against all benchmark texts; a tenth of those with 20 words or more is drawn."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def sql_crc32(data: str) -> str:
    """DuckDB: CRC-32 of a blob expression, in a query that also reads the one row of SQL_CRC_TABLE."""
    byte = f"list_transform(range(octet_length({data})), lambda i: ('0x' || substr(hex({data}), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce({byte}, lambda a, b: xor(crc_table.steps[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


_STEP = "c"
for _ in range(8):
    _STEP = f"list_transform({_STEP}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
SQL_CRC_TABLE = f"crc_table AS MATERIALIZED (SELECT {_STEP} AS steps FROM (SELECT list_transform(range(256), lambda c: c::BIGINT) AS c))"

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "op13_importance_resampling": rf"""
WITH {SQL_CRC_TABLE},
w AS MATERIALIZED (SELECT true AS of_docs, doc_id AS id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_a_z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT false, item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_a_z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
x AS MATERIALIZED (SELECT of_docs, n, unnest(ws) AS word FROM w),
v AS MATERIALIZED (SELECT word, {sql_crc32("encode(word)")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM x), crc_table),
b AS (SELECT bucket, count(*) FILTER (of_docs) AS s, count(*) FILTER (NOT of_docs) AS t FROM x JOIN v USING (word) GROUP BY bucket),
n AS (SELECT count(*) FILTER (of_docs)::DOUBLE AS s_all, count(*) FILTER (NOT of_docs)::DOUBLE AS t_all FROM x),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM b, n),
d AS (SELECT n, sum(gain)::BIGINT AS weight FROM x JOIN v USING (word) JOIN g USING (bucket) WHERE of_docs GROUP BY n),
r AS (SELECT id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (n) WHERE of_docs),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT floor(10 * count(*) / 100) FROM r WHERE n_features >= 20) THEN place END AS rank FROM o"""
}
QUERIES = {"op13_importance_resampling": op13_importance_resampling}
