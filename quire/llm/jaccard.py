"""N-gram Jaccard join: all links between documents whose shingle sets are alike, and their components.

The overlaps are entries of the product of the sparse matrix of documents by n-grams with
its transpose. The product is blocked so that only blocks that can hold a link are formed:

1. Equal sets are one row of the matrix.
2. Two sets that are alike enough share SHARED n-grams among the first few of either, in any
   one order of all n-grams; how many follows from the sets' sizes. The order is by how many
   documents have an n-gram, as counted in hashed cells, so passages that recur everywhere
   and turns of phrase bring nothing together.
   Rows that share so many of them, and whose sizes allow a link, are put into one block: a
   single n-gram that texts have in common by chance would, in a large corpus, connect most
   of it. An n-gram that more than FEW rows have among their first ones is enough by itself.
3. Within a block, overlap counts are accumulated over n-grams: frequent columns by dense
   products of column ranges, rare ones by counting the pairs they hold. Pairs below the
   bound that their sizes give are discarded; the rest are links, exactly.

A block larger than a tile is cut into bands of sizes that allow links, bands are cut into
tiles, and each pair of tiles of the same or of neighbouring bands is a cell of its own; a
family of near copies is thereby dealt over many tasks. What the table of counts calls hot
among the n-grams is salted before rows that share it are brought together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import WORD, materialize, pick, remembered, table
from .graph import components, forest

#: Blocks, or bands of them, of up to TILE_ROWS rows are one tile; larger ones about SPREAD tiles, or more of WIDE_ROWS rows; and no tile has more shingles.
TILE_ROWS, WIDE_ROWS, SPREAD, TILE_SHINGLES = 128, 1024, 16, 1_000_000
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: N-grams that are counted so often, in these steps (8 log2), are salted so many times.
HOT_STEP, SALTS = 128, 16
#: N-grams are counted in so many cells (a table of 16 MB), which are summed in blocks.
CELL_BITS, CELL_BLOCK = 24, 1 << 16
#: Rows that bring each other into a block share so many of their first n-grams, or one that more than FEW rows have.
SHARED, FEW = 3, 32
#: A table of keys has so many bits (16 MB), whatever the corpus.
KEY_BITS = 27
#: Shingles that a worker counts at a time.
COUNT_AT_ONCE = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a chunk."""
    kept = remembered("jaccard")
    if not kept:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            t = np.full(CHUNK + 1, base, np.uint64)
            t[0] = 1
            kept[name] = np.multiply.accumulate(t)
    return kept["up"], kept["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of at most CHUNK bytes that end in white space or at the end of the data."""
    up, down = _power_tables()
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long_word(a: np.ndarray) -> np.ndarray:
    """Hash of one word of any length, in pieces."""
    up, _ = _power_tables()
    total = 0
    for at in range(0, len(a), CHUNK):
        piece = a[at : at + CHUNK]
        total += int(((piece + np.uint64(1)) * up[: len(piece)]).sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return _mixed(np.array([(total + len(a)) % (1 << 64)], np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes that end in white space; the memory it takes besides its result is a chunk's."""
    a = np.frombuffer(data, np.uint8)
    hashes, starts = [], []
    at = 0
    while at < len(a):
        end = min(len(a), at + CHUNK)
        if end < len(a) and not _SPACE[a[end - 1]]:
            inside = np.flatnonzero(_SPACE[a[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                while not _SPACE[a[end]]:
                    end += 1
                hashes.append(_long_word(a[at:end]))
                starts.append(np.array([at]))
                at = end
                continue
        h, s = _word_hashes(a[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _chunks(docs: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for d in docs:
        held.append(d)
        size += len(d) + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The set of each text's k-word shingles, as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer than k
    words has its whole sequence as its one shingle; null and blank texts have none.
    """
    for docs in _chunks([(t or b"").translate(_LOWER) for t in texts]):
        h, starts = word_hashes(b" ".join(docs) + b" ")
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in docs]))
        g = h
        for j in range(1, k):
            g = _mixed(g[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[j:]) if len(h) > j else h[:0]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= k:
                yield np.unique(g[lo : hi - k + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    short = _mixed((np.array([short]) * np.uint64(0xA0761D6478BD642F)) ^ x)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set, which, with its size, tell it from others."""
    size = np.uint64(len(s))
    one = _mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ _mixed(np.array([size]))[0]
    two = np.bitwise_xor.reduce(_mixed(s * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xD6E8FEB86659FD93)), initial=np.uint64(0))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def need(n1, n2, percent: int):
    """Smallest overlap of sets of these sizes whose Jaccard similarity is percent / 100 or more."""
    return -(-(percent * (n1 + n2)) // (100 + percent))


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def _cell_counter(k: int):
    """(block, salt, counts): of each run of documents, in how many distinct sets the n-grams of each cell are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def fold() -> None:
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                counts[at] += n.astype(np.uint32)

        for batch in batches:
            for s in shingle_sets(_bytes(batch, "text"), k):
                if len(s) and (key := set_hash(s)) not in seen:
                    seen.add(key)
                    held.append(_cells(s))
                    size += len(s)
                    if size >= COUNT_AT_ONCE:
                        fold()
                        held, seen, size = [], set(), 0
        fold()
        salt = TaskContext.get().partitionId() % 64
        for block, part in enumerate(counts.reshape(-1, CELL_BLOCK)):
            if part.any():
                packed = zlib.compress(part.astype("<u4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed])], names=["block", "salt", "counts"])

    return run


def _sum_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELL_BLOCK, np.uint32)
    for raw in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(raw), "<u4")
    return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def common_order(docs: DataFrame, k: int) -> np.ndarray:
    """How common n-grams are: a step for each of the cells they are hashed to, by the logarithm of its count over all documents.

    The table has one byte a cell whatever the corpus. It only puts n-grams in an order that
    is the same for all documents; that n-grams share a cell costs time, no link.
    """
    parts = docs.select("text").mapInArrow(_cell_counter(k), "block int, salt int, counts binary")
    once = parts.groupBy("block", "salt").applyInPandas(_sum_blocks, "block int, counts binary")
    steps = np.zeros((1 << CELL_BITS) // CELL_BLOCK * CELL_BLOCK, np.uint8).reshape(-1, CELL_BLOCK)
    for r in once.groupBy("block").applyInPandas(_sum_blocks, "block int, counts binary").toLocalIterator():
        n = np.frombuffer(zlib.decompress(r["counts"]), "<u4")
        steps[r["block"]] = np.minimum(255, 8 * np.log2(1.0 + n)).astype(np.uint8)
    return steps.ravel()


def _prefixes(k: int, percent: int, order: Broadcast):
    """Per document: its key and id, set size, set hashes, and its first shingles in the common order, hot ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = order.value
        for batch in batches:
            sizes, one, two, first, hot = [], [], [], [], []
            for s in shingle_sets(_bytes(batch, "text"), k):
                n = len(s)
                sizes.append(n)
                a, b = set_hash(s) if n else (None, None)
                one.append(a)
                two.append(b)
                take = n - -(-percent * n // 100) + SHARED if n else 0
                step = steps[_cells(s)]
                at = np.lexsort((s, step))[:take]
                often = step[at] >= HOT_STEP
                s = s[at].astype(np.int64)
                first.append(s[~often])
                hot.append(s[often])
            lists = pa.list_(pa.int64())
            columns = [batch.column("key"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (sizes, one, two)], pa.array(first, lists), pa.array(hot, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_shingles", "one", "two", "first", "hot"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a tile's sets: the matrix product, accumulated over n-grams."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if m < 2:
        return out
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    width = np.diff(np.r_[cut, len(values)])
    flat = np.zeros(m * m, np.int64)
    for w in range(2, 13):
        at = cut[width == w]
        if len(at):
            members = rows[at[:, None] + np.arange(w)]
            for i in range(w):
                for j in range(i + 1, w):
                    np.add.at(flat, members[:, i] * m + members[:, j], 1)
    out += flat.reshape(m, m)
    out += flat.reshape(m, m).T
    wide = np.flatnonzero(width >= 13)
    for at in range(0, len(wide), 4096):
        columns = wide[at : at + 4096]
        a = np.zeros((m, len(columns)), np.float32)
        for c, k in enumerate(columns.tolist()):
            a[rows[cut[k] : cut[k] + width[k]], c] = 1
        out += a @ a.T
    return out


def _cell_links(k: int, percent: int):
    """Links of a cell: of a tile with itself, or of two tiles with each other."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, *i = key[:3]
        j = list(key[3:])
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        sets = list(shingle_sets(texts, k))
        hashes = [set_hash(s) if len(s) else (0, 0) for s in sets]
        nodes = pdf["node"].to_numpy(np.int64)
        keep = np.flatnonzero([h == w for h, w in zip(hashes, zip(pdf["one"].tolist(), pdf["two"].tolist()))])
        keep = keep[np.sort(np.unique(nodes[keep], return_index=True)[1])]
        sets, nodes = [sets[x] for x in keep], nodes[keep]
        copies, low = pdf["copies"].to_numpy(np.int64)[keep], ((pdf["band"] == i[0]) & (pdf["tile"] == i[1])).to_numpy()[keep]
        sizes = np.array([len(s) for s in sets], np.int64)
        linked = overlaps(sets) >= need(sizes[:, None], sizes[None, :], percent)
        np.fill_diagonal(linked, False)
        if i != j:  # pairs inside a tile are counted where it meets itself
            linked &= low[:, None] != low[None, :]
        a, b = np.nonzero(np.triu(linked))
        roots = forest(nodes[a].tolist(), nodes[b].tolist())
        links = linked @ copies if len(copies) else np.zeros(0, np.int64)
        return pd.DataFrame({"node": nodes, "root": [roots.get(x, x) for x in nodes.tolist()], "links": links})

    return run


def row_key(names: list[str]) -> Column:
    """Two 64-bit hashes of these columns; a null is told from every value."""
    cols = [c for n in names for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"))


def _band(n: Column, percent: int) -> Column:
    """Sets whose sizes allow a link are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else n.cast("int")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect classes which share enough of their first n-grams and whose sizes allow a link.

    Under an n-gram of up to FEW rows all pairs are counted, and those kept that share SHARED
    n-grams, or as many as a link of their sizes needs. Under one of more rows, neighbours in
    the order of sizes are connected, which is enough. A hot n-gram's rows are dealt by band
    of sizes and a salt: each goes to the least node of its salt, and these to each other,
    one row a salt and band.
    """
    postings = classes.select("node", "n", F.explode("first").alias("shingle"))
    by_size = W.partitionBy("shingle").orderBy("n", "node")
    after = F.collect_list(F.struct("node", "n")).over(by_size.rowsBetween(1, FEW - 1))
    # n-grams of one row are most of them, and go before anything is made of them
    several = postings.withColumn("rows", F.count("*").over(W.partitionBy("shingle"))).where("rows > 1")
    near = several.select("node", "n", "rows", F.lag("node").over(by_size).alias("other"), F.lag("n").over(by_size).alias("other_n"), after.alias("after"))
    near = materialize(near.withColumn("after", F.when(F.col("rows") <= FEW, F.col("after"))), "jaccard-shared")
    chains = near.where((F.col("rows") > FEW) & (F.col("other_n") * 100 >= F.col("n") * percent)).select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = near.where("rows <= " + str(FEW)).select(F.col("node").alias("a"), "n", F.explode("after").alias("o")).where(F.col("n") * 100 >= F.col("o.n") * percent)
    shared = pairs.groupBy("a", F.col("o.node").alias("b"), "n", F.col("o.n").alias("m")).count()
    overlap = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    chains = chains.union(shared.where(F.col("count") >= F.least(F.lit(SHARED), overlap)).select("a", "b"))

    hot = classes.select("node", "n", _band(F.col("n"), percent).alias("band"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"), F.explode("hot").alias("shingle"))
    salted = hot.select(F.col("node").alias("a"), F.min("node").over(W.partitionBy("shingle", "band", "salt")).alias("b")).where("a <> b")
    hubs = hot.groupBy("shingle", "band", "salt").agg(F.min("node").alias("hub"), F.min("n").alias("low"), F.max("n").alias("high"))
    per_band = hubs.groupBy("shingle", "band").agg(F.collect_set("hub").alias("hubs"), F.min("hub").alias("hub"), F.min("low").alias("low"), F.max("high").alias("high"))
    joined = per_band.select(F.explode("hubs").alias("a"), F.col("hub").alias("b")).where("a <> b")
    bands = W.partitionBy("shingle").orderBy("band")
    across = per_band.select(F.col("hub").alias("a"), F.lag("hub").over(bands).alias("b"), "low", F.lag("high").over(bands).alias("below")).where(F.col("b").isNotNull() & (F.col("below") * 100 >= F.col("low") * percent)).select("a", "b")
    return chains.union(salted).union(joined).union(across)


def _may_be_among(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs with __may, false only where key isn't in the one column of keys.

    The keys are a table of bits, sent to every task, so docs aren't shuffled. Keys that
    share a bit cost time: what may be among them is joined with them.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << KEY_BITS))
    at = bit(F.col(keys.columns[0]))
    bits = keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    own = bit(F.col(key))
    joined = docs.withColumn("__bucket", F.bitmap_bucket_number(own)).join(F.broadcast(bits), "__bucket", "left")
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn("__may", may).drop("__bucket", "__bits")


def _cells_of(members: DataFrame, percent: int) -> DataFrame:
    """members (block, node, n and what else they have) with band and tile, and each once for every cell p (low band and tile, high band and tile) it belongs to."""
    banded = members.withColumn("band", _band(F.col("n"), percent))
    rows, mass = F.count("*").alias("rows"), F.sum("n").alias("mass")
    bands = banded.groupBy("block", "band").agg(rows, mass)
    most = F.greatest(F.lit(TILE_ROWS), F.least(F.lit(WIDE_ROWS), F.ceil(F.col("rows") / SPREAD)))
    tiles = F.greatest(F.ceil(F.col("rows") / most), F.ceil(F.col("mass") / TILE_SHINGLES)).cast("int")
    # a few bands a block, whatever its size: a size of 2^31 is in band 204 at 90 %
    blocks = bands.groupBy("block").agg(F.sum("rows").alias("all_rows"), F.sum("mass").alias("all_mass"), F.map_from_entries(F.collect_list(F.struct("band", tiles))).alias("tiles"))
    lone = (F.col("all_rows") <= TILE_ROWS) & (F.col("all_mass") <= TILE_SHINGLES)
    blocks = blocks.select("block", lone.alias("lone"), F.when(~lone, F.col("tiles")).otherwise(F.create_map(F.lit(0), F.lit(1))).alias("tiles"))
    placed = banded.join(blocks, "block").withColumn("band", F.when(F.col("lone"), 0).otherwise(F.col("band")))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.try_element_at("tiles", F.col("band"))).cast("int"))

    def meet(step: int) -> Column:
        """Cells with the tiles of the band this many above."""
        other = F.coalesce(F.try_element_at("tiles", F.col("band") + step), F.lit(0))
        place = lambda band, tile: [F.col("band") + band if band else F.col("band"), tile]
        cell = lambda lo, hi: F.struct(lo[0].alias("bi"), lo[1].cast("int").alias("i"), hi[0].alias("bj"), hi[1].cast("int").alias("j"))
        own = F.col("tile")

        def of(t: Column) -> Column:
            if step == 0:
                return cell(place(0, F.least(t, own)), place(0, F.greatest(t, own)))
            return cell(place(0, own), place(1, t)) if step > 0 else cell(place(-1, t), place(0, own))

        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(other, F.lit(1)) - 1), lambda t: t < other), of)

    return placed.withColumn("p", F.concat(meet(0), meet(1), meet(-1))).drop("lone", "tiles", "n")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per document with its key, and per class of equal sets with its component.

    docs: key, doc_id, text; rows of one key have one id and one text. Classes have the root
    of their component, the first document of theirs (smallest id, null last, then key), how
    many documents they are and how many links these have to other classes.
    """
    order = docs.sparkSession.sparkContext.broadcast(common_order(docs, k))
    schema = "key struct<a: long, b: long>, doc_id long, n_shingles long, one long, two long, first array<long>, hot array<long>"
    nodes = materialize(docs.mapInArrow(_prefixes(k, percent, order), schema), "jaccard-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    grouped = nodes.where("one is not null").groupBy("one", "two", F.col("n_shingles").alias("n")).agg(first.alias("least"), F.count("*").alias("copies"), F.first("first").alias("first"), F.first("hot").alias("hot"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    blocks = components(_candidates(classes, percent)).withColumnRenamed("root", "block")

    members = materialize(classes.select("node", "n", "one", "two", "copies", F.col("least.key").alias("of")).join(blocks, "node"), "jaccard-blocks")
    placed = _cells_of(members, percent)
    # a merge join at every size: what is placed grows with the corpus; rows of one key lie together after it, and one of them is enough
    wanted = _may_be_among(docs.select("key", "text"), "key", members.select("of")).where("__may").drop("__may")
    texts = wanted.join(placed.hint("merge"), F.col("key") == F.col("of")).dropDuplicates(["key"]).withColumn("p", F.explode("p"))
    groups = texts.select("block", "p.bi", "p.i", "p.bj", "p.j", "band", "tile", "node", "one", "two", "copies", "text").groupBy("block", "bi", "i", "bj", "j")
    found = materialize(groups.applyInPandas(_cell_links(k, percent), "node long, root long, links long"), "jaccard-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return nodes, classes.select("node", "one", "two", "n", "least", "copies").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    docs: doc_id, text; other columns are ignored. Two documents are linked when the Jaccard
    similarity of their sets of k-word shingles is percent / 100 or more; component_id is the
    smallest doc_id that links reach, its own included, and n_links the number of documents
    linked to this one. Null and blank texts have no shingles, are linked with nothing and
    are their own component. Repeated rows and ids are documents of their own, linked as
    equal texts; a null id is never a component's id unless all its documents' are null. An
    empty table gives no rows. Sets, and pairs of id and text, are told apart by two 64-bit
    hashes (sets also by their sizes), n-grams by one.

    Scale: only texts in blocks of several rows are shuffled, once for each cell; the rest moves
    the first tenth (at 90 %) of each set's hashes. Groups of equal texts are one row from
    the first shuffle on, in which each task sends a set once. Common n-grams don't bring
    rows together unless rows consist of them; large blocks are dealt out by pairs of tiles.
    """
    docs = pick(docs, ["doc_id", "text"])
    nodes, classes = _classes(docs.select(row_key(docs.columns).alias("key"), "doc_id", "text"), k, percent)
    least = classes.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    of_set = classes.join(least, "root").select("one", "two", F.col("n").alias("n_shingles"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = nodes.where("one is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return nodes.where("one is not null").join(of_set, ["one", "two", "n_shingles"]).select("doc_id", "n_shingles", "component_id", "n_links").union(alone)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stand for a component: one each.

    It is the row with the smallest doc_id (null last), then the smallest hash of the whole
    row, so reruns keep the same. Rows without shingles are their own component and stay.
    """
    names = docs.columns
    keyed = docs.withColumn("__key", row_key(names))
    nodes, classes = _classes(keyed.select(F.col("__key").alias("key"), "doc_id", "text"), k, percent)
    classes = materialize(classes.select("root", "one", "two", "n", "least", "copies"), "jaccard-components")
    groups = classes.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("rows"))
    of_several = classes.join(groups.where("rows > 1").select("root"), "root", "left_semi").select("one", "two", F.col("n").alias("n_shingles"))
    marked = _may_be_among(keyed, "__key", nodes.join(of_several, ["one", "two", "n_shingles"], "left_semi").select("key"))
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    alone = marked.where(~F.col("__may") | ~has_words)
    # rows of one key are the same in every column: any of them will do
    kept = groups.select(F.col("least.key").alias("__of"))
    first = marked.where(F.col("__may") & has_words).join(kept.hint("merge"), F.col("__key") == F.col("__of")).dropDuplicates(["__key"])
    return pick(first, names).union(pick(alone, names))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 90 % of 3-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
