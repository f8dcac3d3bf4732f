"""Packing documents into training sequences along a space-filling curve.

A document is a vector of hashed three-byte counts. A fixed random projection takes it to
DIMS dimensions, the cell of its place has a Hilbert key, and a global range sort by that
key lays documents out so that neighbours on the curve are alike. Each range is then cut
into sequences in curve order, so a sequence holds documents that resemble one another.
Ranges are bounded by bytes of text, so that long documents that lie together on the curve,
and a key that very many documents share, are dealt over several ranges.

A range's last ids fill sequences whose lengths are powers of two, which need no padding;
padding is therefore zero however many ranges there are. A repeated document lies next to
its copies on the curve; a copy waits until the sequence that holds the one before is full.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import materialize, parts, pick, table
from .tokens import encoder

BUCKETS, DIMS, LEVEL_BITS, REACH = 64, 4, 8, 0.5
WORD_BPE, WORD_BPE_END, SEQUENCE = "word_bpe_49k.json", 2, 4096
#: Sequences of ids that a task gathers before it cuts them, and copies' ids that may wait besides.
GATHER = 64
#: Waiting copies that are looked through for one that may go.
LOOK = 64
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection() -> np.ndarray:
    """The fixed projection: orthonormal columns from a seeded generator."""
    return np.linalg.qr(np.random.default_rng(20240601).standard_normal((BUCKETS, DIMS)))[0]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), each coordinate of so many bits.

    Skilling's transform: undo the rotations from the highest bit down, then Gray-decode.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of hashed three-byte counts; without three bytes the zero vector."""
    out = np.zeros((len(texts), BUCKETS))
    for k, text in enumerate(texts):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(b) >= 3:
            h = b[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)
            h += b[1:-1] * np.uint32(0x85EBCA77)
            h += b[2:] * np.uint32(0xC2B2AE3D)
            out[k] = np.bincount((h >> np.uint32(26)).astype(np.uint8), minlength=BUCKETS)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def curve_keys(texts: list[str | None]) -> np.ndarray:
    vectors = document_vectors(texts)
    spread = (vectors - 1 / np.sqrt(BUCKETS)) @ projection() / REACH
    cells = np.clip(((spread + 1) / 2 * (1 << LEVEL_BITS)).astype(np.int64), 0, (1 << LEVEL_BITS) - 1)
    return hilbert_keys(cells, LEVEL_BITS)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = curve_keys(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "curve"])


def byte_ranges(keyed: DataFrame) -> tuple[list[int], list[int], list[int], int]:
    """Bounds of ranges of the curve that hold as many bytes each: keys, and the first and last range that a key falls into.

    keyed: curve, text. A range may begin inside a key, whose documents are then dealt over
    the ranges by a hash. Bytes are summed by key, then over the curve in three steps: the
    keys of a stretch of 256, the stretches under one high half, and the high halves, of
    which there are 65,536 at most; a few keys a range reach the driver.
    """
    cells = materialize(keyed.groupBy("curve").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).withColumn("stretch", F.shiftright("curve", 8)), "pack-cells")
    total = cells.agg(F.sum("size")).first()[0] or 0
    n = parts(keyed.sparkSession, total)
    before = lambda w: F.sum("size").over(w) - F.col("size")
    stretches = cells.groupBy("stretch").agg(F.sum("size").alias("size")).withColumn("high", F.shiftright("stretch", 8))
    highs = stretches.groupBy("high").agg(F.sum("size").alias("size")).select("high", before(W.orderBy("high")).alias("before_high"))
    stretches = stretches.select("high", "stretch", before(W.partitionBy("high").orderBy("stretch")).alias("inside_high")).join(highs, "high")
    placed = cells.withColumn("inside", before(W.partitionBy("stretch").orderBy("curve"))).join(stretches, "stretch").withColumn("before", F.col("before_high") + F.col("inside_high") + F.col("inside"))
    first = F.least(F.floor(F.col("before") * F.lit(n) / F.lit(max(1, total))), F.lit(n - 1)).cast("int")
    last = F.least(F.floor((F.col("before") + F.col("size") - 1) * F.lit(n) / F.lit(max(1, total))), F.lit(n - 1)).cast("int")
    placed = placed.select("curve", first.alias("first"), last.alias("last"))
    # of the keys that lie in one range whole, the least bounds it; keys that span ranges bound them too
    whole = placed.where("first = last").groupBy("first", "last").agg(F.min("curve").alias("curve")).select("curve", "first", "last")
    bounds = sorted(tuple(r) for r in whole.union(placed.where("first < last")).collect())
    return [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds], n


def _dealer(keys: list[int], first: list[int], last: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, a, b = np.array(keys, np.int64), np.array(first, np.int64), np.array(last, np.int64)
        for batch in batches:
            curve, h = batch.column("curve").to_numpy(), batch.column("h").to_numpy().astype(np.uint64)
            at = np.searchsorted(k, curve, "right") - 1
            # a key after one that spans ranges, and before the next bound, goes to the last of them
            spread = np.where(k[at] == curve, b[at] - a[at] + 1, 1).astype(np.uint64)
            part = np.where(k[at] == curve, a[at], b[at]) + ((h >> np.uint64(32)) * spread >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def sequence_lengths(n: int, sequence: int) -> list[int]:
    """Lengths of the sequences for n ids: full ones, then the powers of two that add up to the rest."""
    full, rest = divmod(n, sequence)
    return [sequence] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, end_id: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids before, ids of the document, ids left
        n_waiting = n_placed = 0
        copies: deque[tuple[list[int], int | None, bytes]] = deque()  # copies that wait; the list holds where the next one of its document may go
        n_copies = 0
        latest: tuple[int | None, bytes] | None = None
        free = [0]

        def cut(lengths: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, waiting, n_waiting
            rows: list[tuple] = []
            at, used = 0, 0  # in waiting; ids of waiting[at] that are out
            for length in lengths:
                offset = 0
                while offset < length:
                    doc_id, before, total, ids = waiting[at]
                    take = min(len(ids) // width - used, length - offset)
                    piece = np.frombuffer(ids, enc.dtype, take, used * width).astype("<u4").tobytes()
                    rows.append((doc_id, before + used, take, total, sequence_id, offset, piece))
                    offset, used = offset + take, used + take
                    if used * width == len(ids):
                        at, used = at + 1, 0
                sequence_id += 1
            waiting = waiting[at:]
            if used:
                doc_id, before, total, ids = waiting[0]
                waiting[0] = (doc_id, before + used, total, ids[used * width :])
            n_waiting -= sum(lengths)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

        def place(doc_id: int | None, ids: bytes) -> None:
            nonlocal n_waiting, n_placed
            waiting.append((doc_id, 0, len(ids) // width, ids))
            n_waiting += len(ids) // width
            n_placed += len(ids) // width

        def release(most: int) -> None:
            """Places copies that may go, and the first ones whatever they follow while more than so many ids wait."""
            nonlocal n_copies
            while copies:
                k = next((k for k in range(min(len(copies), LOOK)) if copies[k][0][0] <= n_placed), 0 if n_copies > most else None)
                if k is None:
                    return
                after, doc_id, ids = copies[k]
                del copies[k]
                n_copies -= len(ids) // width
                place(doc_id, ids)
                after[0] = -(-n_placed // sequence) * sequence  # where the sequence ends that holds this one's end

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode(text.as_py()) + end
                if latest == (doc_id, ids):
                    copies.append((free, doc_id, ids))
                    n_copies += len(ids) // width
                else:
                    place(doc_id, ids)
                    latest, free = (doc_id, ids), [-(-n_placed // sequence) * sequence]
                release(GATHER * sequence)
                if n_waiting >= GATHER * sequence:
                    yield from cut([sequence] * (n_waiting // sequence))
        release(0)
        yield from cut(sequence_lengths(n_waiting, sequence))

    return run


def pack_sequences(docs: DataFrame, vocabulary: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of the packed sequences of docs (doc_id, text), with their ids (uint32, little-endian).

    A document's ids are those of its whole text (null: none) and the end id; documents are
    cut where a sequence ends. Sequences have `sequence` ids, a power of two, or a smaller
    power of two. Equal texts share a curve key and are told apart by doc_id, then by hash.
    Repeated rows and repeated ids are packed as often as they come, copies of a row in
    different sequences as long as other documents of the range can stand between them; null
    ids are kept. An empty table gives no pieces. Other columns are ignored.

    Scale: texts are written once with their keys and shuffled once, by ranges of the curve
    that hold as many bytes each; a task holds GATHER sequences, and as many ids of copies.
    """
    keyed = materialize(pick(docs, ["doc_id", "text"]).mapInArrow(_with_keys, "doc_id long, text string, curve long"), "pack-keys")
    keys, first, last, n = byte_ranges(keyed)
    if not keys:
        return docs.sparkSession.createDataFrame([], PIECE_SCHEMA)
    hashed = keyed.withColumn("h", F.xxhash64("doc_id", "text"))
    dealt = hashed.mapInArrow(_dealer(keys, first, last), "doc_id long, text string, curve long, h long, part int")
    placed = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("curve", "doc_id", "h").select("doc_id", "text")
    return placed.mapInArrow(_packer(vocabulary, end_id, sequence), PIECE_SCHEMA)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with checksums."""
    import public_tokenizers

    pieces = pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), WORD_BPE_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_pack_sequences": op5_pack_sequences}
