"""Document fingerprints: quartile bucket digests.

Every run of three bytes of a text is hashed into one of BUCKETS buckets. A bucket's count
is coded by the quartile of all counts that it falls into (two bits), and the text's length
by its logarithm (one byte). Digests are compared code by code; the difference is bounded,
so that texts without likeness score 0 and equal texts 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parts, pick, table

BUCKETS = 512
#: A difference of three quartiles counts as six; lengths differ by so many steps at most; digests that differ by BOUND in all have likeness 0.
FAR, LENGTH_STEPS, BOUND = 6, 24, 2 * BUCKETS
NEIGHBOUR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed byte triplets of data; all 0 below three bytes."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = b[:-2] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h += b[1:-1] * np.uint32(0x85EBCA77)
    h += b[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)


def digest(text: str | None) -> np.ndarray:
    """Codes of the whole text: its length's code and then one quartile (0 to 3) a bucket. Null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    codes = np.zeros(BUCKETS + 1, np.uint8)
    codes[0] = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    for q in (1, 2, 3):
        codes[1:] += counts > ranked[q * BUCKETS // 4 - 1]
    return codes


def to_text(codes: np.ndarray) -> str:
    """Two hexadecimal digits of length, then the quartile codes, two bits each."""
    quads = codes[1:].reshape(-1, 4)
    return f"{codes[0]:02x}" + (quads @ np.array([64, 16, 4, 1], np.uint8)).astype(np.uint8).tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.r_[raw[:1], ((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()].astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 minus the difference of two digests' codes as a share of BOUND, 0 at least."""
    step = np.abs(a[1:].astype(np.int16) - b[1:])
    different = int(np.where(step == 3, FAR, step).sum()) + min(LENGTH_STEPS, abs(int(a[0]) - int(b[0])))
    return max(0.0, 1 - different / BOUND)


def _fingerprinter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [to_text(digest(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text): map-side, nothing shuffled.

    Null text has the fingerprint of the empty text; equal texts have equal fingerprints.
    Repeated rows and null ids are kept, other columns ignored.
    """
    return pick(docs, ["doc_id", "text"]).mapInArrow(_fingerprinter, "doc_id long, fingerprint string")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NEIGHBOUR_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # part, doc_id, text, codes of the row that waits for the next one
    done = None  # part whose first row of the following part has come
    for batch in batches:
        out = []
        for part, extra, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            if done == part:
                continue
            text = text.as_py() or ""
            codes = digest(text)
            if held and held[0] == part:
                _, at, own, own_codes = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_codes = digest(edited)
                out.append((at, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own_codes), to_text(edited_codes), likeness(own_codes, edited_codes), likeness(own_codes, codes)))
            held = (part, doc_id, text, codes)
            if extra:
                done, held = part, None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _at_or_above(bounds: list[int], x: Column, equal: bool = True) -> Column:
    """How many of these sorted bounds are x or more (or more, if not equal): one step over the least of each chunk of bounds, one inside a chunk."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    rest = len(bounds) % width
    cuts = [*([0] if rest else []), *range(rest, len(bounds), width)]
    chunks = [bounds[i:j] for i, j in zip(cuts, [*cuts[1:], len(bounds)])]
    longs = lambda xs: F.array(*[F.lit(b).cast("long") for b in xs])
    counts = lambda b: (b >= x) if equal else (b > x)
    above = F.size(F.filter(longs([c[0] for c in chunks]), counts))
    split = F.get(F.array(*[longs(c) for c in chunks]), F.lit(len(chunks) - 1) - above)
    of_chunks = F.get(longs([0, *np.cumsum([len(c) for c in chunks[::-1]]).tolist()]), above)
    return of_chunks + F.coalesce(F.size(F.filter(split, counts)), F.lit(0))


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    Documents go by descending doc_id, null last, equal ids by the hash of their text; the
    first follows the last. The edited text has its last half (rounded down, in code points)
    replaced by as much of the beginning of the next document. Null text is empty. One
    document is its own next. An empty table gives no rows; other columns are ignored.

    Scale: texts are shuffled once, by ranges of doc_id whose bounds come from a scan of
    the ids alone; an id that bounds several ranges, and the null id, are dealt over as many
    by the hash that orders them. The first row of a range is sent to the range before it as
    well. Only one id a range reaches the driver.
    """
    spark = docs.sparkSession
    rows = pick(docs, ["doc_id", "text"]).withColumn("h", F.xxhash64("text"))
    count, nulls, size = rows.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1)), F.sum(F.octet_length("text"))).first()
    n = parts(spark, size or 0)
    at = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(rows.agg(F.percentile_approx("doc_id", at, 100 * n).alias("b")).first()["b"] or [])
    # how far a row's hash lies, from 0 to 1
    share = (F.shiftright("h", 32) + F.lit(1 << 31)).cast("double") / float(1 << 32)
    low = _at_or_above(bounds, F.col("doc_id"))
    times = low - _at_or_above(bounds, F.col("doc_id"), equal=False)
    of_null = max(1, math.ceil(nulls * n / max(1, count)))
    part = F.when(F.col("doc_id").isNull(), n + F.floor(share * of_null)).when(times > 1, low - times + 1 + F.floor(share * times)).otherwise(low).cast("int")
    placed = rows.withColumn("part", part)
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head")
    heads = {r["part"]: (r["head"]["doc_id"], ~r["head"]["h"]) for r in placed.groupBy("part").agg(first).collect()}
    order = sorted(heads)
    before = dict(zip(order, [order[-1], *order])) if order else {}
    every = range(n + of_null)
    head_id = F.get(F.array(*[F.lit(heads.get(p, (None, 0))[0]).cast("long") for p in every]), F.col("part"))
    head_hash = F.get(F.array(*[F.lit(heads.get(p, (None, 0))[1]).cast("long") for p in every]), F.col("part"))
    to = F.array(*[F.lit(before.get(p, 0)) for p in every])
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.get(to, F.col("part")).alias("part"), F.lit(True).alias("extra"))
    places = F.when(F.col("doc_id").eqNullSafe(head_id) & (F.col("h") == head_hash), F.array(own, copy)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "h", F.explode(places).alias("p")).select("doc_id", "text", "h", "p.part", "p.extra")
    dealt = dealt.repartitionById(n + of_null, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "h")
    return dealt.select("part", "extra", "doc_id", "text").mapInArrow(_edits, NEIGHBOUR_SCHEMA)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return against_next(table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
