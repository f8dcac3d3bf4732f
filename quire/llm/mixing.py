"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are shuffled by a hash and served in packets of
QUANTUM words at most, and each packet gets the virtual time at which a fair queue would
finish serving it: the source's cumulative words divided by the source's target. Ordering
all packets by that time interleaves the sources in proportion to their targets. The mix is
cut where the words in that order reach the total budget, which is the sum of all sizes; a
source is then within a packet of its target. A source whose target exceeds its size is
served again from the start, up to max_repeats times.

Scale: the text is read once, for its word count. Cumulative sums run in hash buckets
of a source whose number grows with the row count, so that a source with a third of
all rows is summed by many tasks; only one row per (source, bucket) meets in a window.
The global order is a range sort; words are summed by range, then inside ranges. Sources
themselves are ranked in one task: thousands of them are no trouble, but a column with about
as many values as rows, such as a page's address, is no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, parts, pick, table, text_bytes, word_count

HASH_SPACE = 65536
ROWS_PER_BUCKET = 512
#: Words of a packet at most; bytes that a packet takes in a shuffle, about.
QUANTUM, PACKET_BYTES = 32, 48


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: int) -> DataFrame:
    """Targets of (source, source_size) rows: skey, source_size, target.

    Sources in code point order, null last, take the weights in turn. The budget is the
    sum of all sizes. With r = cap / weight, sources are capped in ascending order of r,
    and the level at which the uncapped ones share what is left has a closed form over
    prefix sums, so no rounds of resharing are needed.
    """
    n = len(weights)
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("r", F.col("cap") / F.col("w"))
    by_r = W.orderBy("r")
    total = W.partitionBy()
    level = (
        ranked.withColumn("budget", F.sum("source_size").over(total).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_r) - F.sum("cap").over(by_r.rangeBetween(W.currentRow, W.currentRow)))
        .withColumn("free_w", F.sum("w").over(total) - (F.sum("w").over(by_r) - F.sum("w").over(by_r.rangeBetween(W.currentRow, W.currentRow))))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("free_w"))
        # the level that holds is the first one that the next source to be capped does not reach
        .withColumn("holds", F.when(F.col("level") <= F.col("r"), F.struct("r", "level")))
    )
    best = F.min("holds").over(total)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(best * F.col("w"), F.col("cap"))))
    return level.withColumn("target", target).select(_source_key(F.col("source")).alias("skey"), "source_size", "target")


def schedule(docs: DataFrame, weights: list[float] = (5, 2, 1), max_repeats: int = 3, seed: str = "") -> DataFrame:
    """The service schedule: one row per document, copy and packet that starts before virtual time 1.

    docs: doc_id, text, source, and row_id if rows have a number already; other columns are
    ignored. Documents that are never served have one row with null copy. Columns: row_id,
    doc_id, source, size, source_size, target, copy, packet, start, finish (virtual times),
    place (words before the packet in the global order), words (how many of the packet's
    words the mix takes before it has the budget: all, none, or a part of one packet).

    Null text and text of white space have size 0 and are never served. A null source is a
    source. Repeated rows and repeated ids are documents of their own. An empty table gives
    an empty schedule. Documents are shuffled, and packets that finish together ordered, by a hash
    of id and text, then of source; only true copies tie there, and for them it doesn't matter,
    so that the mix is the same however the rows are dealt to files.
    """
    of_rows, packets, _ = _schedule(docs, weights, max_repeats, seed)
    return of_rows.join(packets, "row_id", "left").withColumn("words", F.coalesce("words", F.lit(0).cast("long")))


def _schedule(docs: DataFrame, weights: list[float], max_repeats: int, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their source's target, the packets with their places, and the budget in words."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    key = F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("k")
    row_id = F.col("row_id") if "row_id" in docs.columns else F.monotonically_increasing_id().alias("row_id")
    slim = materialize(docs.select(row_id, "doc_id", "source", word_count(F.col("text")).alias("size"), key), "mix-sizes")
    count, budget = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, min(HASH_SPACE, count // ROWS_PER_BUCKET))
    slim = slim.withColumn("skey", _source_key(F.col("source")))
    dealt = slim.select("row_id", "size", "k", "skey", F.floor(F.shiftright("k", 44) * buckets / HASH_SPACE).cast("int").alias("bucket"), "source")
    per_bucket = materialize(dealt.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source")), "mix-buckets")
    offsets = per_bucket.select(
        "skey", "bucket", (F.sum("bucket_size").over(W.partitionBy("skey").orderBy("bucket")) - F.col("bucket_size")).alias("before_bucket")
    )
    targets = source_targets(per_bucket.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")), list(weights), max_repeats)
    before = F.sum("size").over(W.partitionBy("skey", "bucket").orderBy("k", "row_id")) - F.col("size")
    placed = dealt.drop("source").where("size > 0").withColumn("inside", before).join(offsets.join(targets, "skey"), ["skey", "bucket"]).withColumn("before", F.col("before_bucket") + F.col("inside"))
    begun = lambda c: c * F.col("source_size") + F.col("before")
    copies = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda c: begun(c).cast("double") < F.col("target"))
    served = placed.withColumn("copy", F.explode(copies)).withColumn("begun", begun(F.col("copy")))
    packets = F.filter(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / QUANTUM)), lambda p: (F.col("begun") + p * QUANTUM).cast("double") < F.col("target"))
    served = served.withColumn("packet", F.explode(packets))
    first, held = F.col("packet") * QUANTUM, F.least(F.lit(QUANTUM), F.col("size") - F.col("packet") * QUANTUM)
    served = served.select("row_id", "k", F.xxhash64("skey").alias("tie"), "copy", "packet", held.alias("held"), ((F.col("begun") + first).cast("double") / F.col("target")).alias("start"), ((F.col("begun") + first + held).cast("double") / F.col("target")).alias("finish"))
    order = ["finish", "k", "tie", "copy", "packet", "row_id"]
    ranges = parts(spark, (budget // QUANTUM + count) * PACKET_BYTES)
    ranged = materialize(served.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-order")
    sums = ranged.groupBy("range").agg(F.sum("held").alias("all"))
    sums = sums.select("range", (F.sum("all").over(W.orderBy("range")) - F.col("all")).alias("before_range"))
    inside = F.sum("held").over(W.partitionBy("range").orderBy(*order)) - F.col("held")
    done = ranged.withColumn("inside", inside).join(F.broadcast(sums), "range").withColumn("place", F.col("before_range") + F.col("inside"))  # one row a range
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("held"), F.lit(budget) - F.col("place")))
    of_rows = slim.join(targets, "skey").select("row_id", "doc_id", "source", "size", "source_size", "target")
    return of_rows, done.select("row_id", "copy", "packet", "start", "finish", "place", taken.alias("words")), budget


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), max_repeats: int = 3, names: tuple[str, str] = ("mix_copy", "mix_place")) -> DataFrame:
    """The mixed documents themselves, whole, with every column of docs, then mix_copy (from 0) and mix_place, as names says.

    Should docs have a column of either name, in any case, underscores are put after the new one.

    A document that is served k times is k rows. Of the documents that the end of the mix
    cuts, a copy stays when at least half of it is served. mix_place is how many words of the
    mix come before the copy is served whole; rows are range-partitioned and sorted by it, so
    reading the partitions in order is reading the mix in order. Repeated rows and ids are
    documents of their own. An empty table gives no rows.

    Scale: rows are written once with a number, then shuffled to their places in the mix.
    """
    spark, columns, new = docs.sparkSession, docs.columns, []
    for name in names:
        while name.lower() in {c.lower() for c in [*columns, *new]}:
            name += "_"
        new.append(name)
    rows = materialize(docs.select(F.struct(*[F.col(f"`{n}`") for n in columns]).alias("row"), F.monotonically_increasing_id().alias("row_id")), "mix-rows")
    slim = rows.select("row_id", "row.doc_id", "row.text", "row.source")
    of_rows, packets, budget = _schedule(slim, weights, max_repeats, "")
    served = packets.where("words > 0").groupBy("row_id", "copy").agg(F.sum("words").alias("words"), F.max("place").alias("mix_place"))
    kept = served.join(of_rows.select("row_id", "size"), "row_id").where("words * 2 >= size")
    n = parts(spark, text_bytes(slim))
    part = F.least(F.floor(F.col("mix_place") * n / max(1, budget)), F.lit(n - 1)).cast("int")
    placed = rows.join(kept.select("row_id", F.col("copy").alias("mix_copy"), "mix_place", part.alias("part")), "row_id")
    placed = placed.repartitionById(n, F.col("part")).sortWithinPartitions("mix_place", "row_id")
    return placed.select(*[F.col(f"row.`{c}`") for c in columns], F.col("mix_copy").alias(new[0]), F.col("mix_place").alias(new[1]))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    of_rows, packets, _ = _schedule(pick(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"]), [5, 2, 1], 3, "")
    taken = packets.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return of_rows.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


SQL = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS r, (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM w),
l AS (SELECT a.r, (any_value(a.budget) - coalesce(sum(b.cap) FILTER (b.r < a.r), 0)) / sum(b.w) FILTER (b.r >= a.r) AS level FROM r a, r b GROUP BY a.source, a.r),
h AS (SELECT level FROM l WHERE level <= r ORDER BY r, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT level FROM h) * w, cap)) END AS target FROM r),
c AS (SELECT doc_id, size, source, k, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
f AS (SELECT c.*, t.source_size, t.target FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, k, size, target, copy, copy * source_size + before AS begun, unnest(range((size + 31) // 32)) AS packet FROM f, range(3) AS n(copy)),
o AS (SELECT doc_id, least(32, size - packet * 32) AS held, sum(least(32, size - packet * 32)) OVER (ORDER BY (begun + packet * 32 + least(32, size - packet * 32))::DOUBLE / target, k, doc_id, copy, packet ROWS UNBOUNDED PRECEDING) AS place
  FROM p WHERE (begun + packet * 32)::DOUBLE < target),
m AS (SELECT doc_id, sum(greatest(0, least(held, (SELECT sum(size) FROM d) - (place - held)))) AS taken FROM o GROUP BY doc_id)
SELECT f.doc_id, f.size, f.source_size, f.target, coalesce(m.taken, 0)::BIGINT AS taken FROM f LEFT JOIN m USING (doc_id)"""
}
QUERIES = {"op1_mix_sources": op1_mix_sources}
