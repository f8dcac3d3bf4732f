"""Token ids in bit-packed files.

Every id takes the fewest bits that hold the vocabulary. A shard holds whole documents,
about SHARD_TOKENS ids, in blocks of BLOCK ids; each block starts at a byte boundary that
the shard's block offsets name, so a reader unpacks any span with numpy from the blocks
that it touches. A file is a Parquet container of shards, written by Spark's committer:
a lost executor leaves no half-written file, and any store that Spark reads will do.

A shard row: part and shard (its place: parts follow one another in document order, and
shards within a part), bits, doc_ids, doc_lengths (packed int64, nullable ids by mask),
n_tokens, block_offsets (packed int64), data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import new_folder, parts, pick, table, text_bytes
from .tokens import encoder

BLOCK = 4096
SHARD_TOKENS = 1 << 20
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 2

FILE_SCHEMA = "part int, shard int, bits int, n_docs int, n_tokens long, doc_ids binary, doc_nulls binary, doc_lengths binary, block_offsets binary, data binary"
READ_SCHEMA = "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, bits: int) -> tuple[np.ndarray, bytes]:
    """Block offsets and the packed bytes of ids, most significant bit first."""
    offsets = np.arange(0, max(1, -(-len(ids) // BLOCK)), dtype="<i8") * (BLOCK * bits // 8)
    if bits % 8 == 0:
        raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :]
        return offsets, raw.tobytes()
    out = []
    for at in range(0, len(ids), BLOCK * 16):
        raw = np.unpackbits(ids[at : at + BLOCK * 16].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(raw[:, 32 - bits :].ravel()).tobytes())
    return offsets, b"".join(out)


def unpack(data: bytes, offsets: np.ndarray, bits: int, start: int, length: int) -> np.ndarray:
    """ids[start : start + length], from the blocks that hold them only."""
    if length <= 0:
        return np.empty(0, "<u4")
    first, last = start // BLOCK, (start + length - 1) // BLOCK
    low = int(offsets[first])
    high = int(offsets[last + 1]) if last + 1 < len(offsets) else len(data)
    raw = np.frombuffer(data, np.uint8, high - low, low)
    if bits % 8 == 0:
        width = bits // 8
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        ids = wide.view(">u4").ravel()
    else:
        n = len(raw) * 8 // bits
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits :] = np.unpackbits(raw)[: n * bits].reshape(n, bits)
        ids = np.packbits(wide, axis=1).view(">u4").ravel()
    return ids[start - first * BLOCK :][:length].astype("<u4")


def _packer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = max(1, int(max(enc.vocab_size - 1, end_id)).bit_length())
        end = np.array([end_id], enc.dtype).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            offsets, data = pack(np.frombuffer(b"".join(held), enc.dtype), bits)
            row = (part, shard, bits, len(ids), tokens, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array(lengths, "<i8").tobytes(), offsets.tobytes(), data)
            kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                got = enc.encode(text.as_py()) + end
                held.append(got)
                ids.append(doc_id)
                lengths.append(len(got) // enc.dtype.itemsize)
                tokens += lengths[-1]
                if tokens >= SHARD_TOKENS:
                    yield flush()
                    shard, ids, lengths, held, tokens = shard + 1, [], [], [], 0
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order and write the files to path.

    vocabulary: path of a tokenizer file, the same on all machines. Null text is an empty
    document of one id, the end id. Null ids come last; equal ids follow the hash of their
    text. An empty table writes an empty dataset. Other columns are ignored.
    """
    text_key = F.xxhash64("text")
    rows = pick(docs, ["doc_id", "text"]).withColumn("h", text_key)
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    placed = rows.repartitionByRange(parts(docs.sparkSession, text_bytes(rows)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(_packer(vocabulary, end_id), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _reader(with_ids: bool):
    """Unpacks shards; with their ids, documents follow one another as the shards do, without them only their checksums leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["doc_lengths"], "<i8")
                offsets = np.frombuffer(r["block_offsets"], "<i8")
                starts = np.cumsum(lengths) - lengths
                nulls = np.frombuffer(r["doc_nulls"], np.uint8).astype(bool)
                ids = np.frombuffer(r["doc_ids"], "<i8")
                all_ids = memoryview(unpack(r["data"], offsets, r["bits"], 0, r["n_tokens"]).tobytes())
                for at in range(0, len(ids), 2000):
                    k = slice(at, at + 2000)
                    spans = [all_ids[4 * s : 4 * (s + n)] for s, n in zip(starts[k].tolist(), lengths[k].tolist())]
                    n = len(spans)
                    columns = [pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()), pa.array(ids[k], mask=nulls[k]), pa.array(starts[k]), pa.array(lengths[k]), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, spans), pa.binary())] * with_ids, names=names)

    return run


def _starts(files: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids in all shards before each; one row a shard (about a million ids)."""
    of_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    of_part = of_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    shards = files.select("part", "shard", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("shard_start"))
    return shards.join(of_part, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files at path: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and ids (uint32, little-endian) unless not wanted.

    Every id is unpacked either way; without ids only numbers are shuffled to the shards' starts.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    docs = files.mapInArrow(_reader(with_ids), READ_SCHEMA + ", ids binary" * with_ids)
    return docs.join(_starts(files), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_span(spark: SparkSession, path: str, part: int, shard: int, start: int, length: int) -> np.ndarray:
    """Random access: ids [start, start + length) of one shard, unpacking only the blocks they touch."""
    r = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("part") == part) & (F.col("shard") == shard)).select("bits", "block_offsets", "data").first()
    return unpack(r["data"], np.frombuffer(r["block_offsets"], "<i8"), r["bits"], start, length)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token files and returns, read back from them, each document's place, length and checksum."""
    import public_tokenizers

    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), BYTE_BPE_END)
    return read_token_files(spark, path, with_ids=False)


QUERIES = {"op2_token_files": op2_token_files}
