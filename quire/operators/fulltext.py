"""Ranked full text over stems, with an index whose blocks bound what they can contribute.

Documents are dealt to pages by the length of their text and a hash of their id, so that a page
holds PAGE documents of like length, about. The index has a row a stem and page: the documents
and positions, and the most often that a document of the page has the stem. A search for the k
best bounds every page's best rank from these numbers alone, reads the most promising pages,
and then only those whose bound the k-th best rank so far doesn't beat: an exact answer.

Rank: if all of a query has to match (no OR) and it has two stems or more, pairs of positions of
different stems add up by nearness; else each stem adds by its number of positions. Both are
the usual ranking of text search in SQL databases, with one weight for all positions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stems import stem

# English words that a full-text index leaves out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were "
    "be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
STOP_WORDS, WORD = frozenset(STOP), re.compile("[a-z0-9]+")
#: Documents of a page, about; classes of lengths an octave; folders that stems are dealt to, by a hash; pages that are written together.
PAGE, CLASSES, BUCKETS, SLICE = 64, 4, 64, 1024
# Fixed values of the rank: the weight of a position, the most positions of a stem that count, and the sum of 1 / n^2.
WEIGHT, MOST_POSITIONS, ZETA2 = 0.1, 256, 1.64493406685
PAGE_ROWS = "stem string, page long, documents long, max_tf int, entries struct<ids: array<bigint>, starts: array<int>, positions: array<int>>"
INDEX = f"{PAGE_ROWS}, bucket int"
#: Pages that are read before others are ruled out.
FIRST_PAGES = 4


def paged(docs: DataFrame) -> DataFrame:
    """docs (id, text) with their page. Only the number of documents in each class of lengths is counted; nothing is shuffled."""
    kind = F.floor(F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1) * CLASSES).cast("int")
    counts = {r["kind"]: r["count"] for r in docs.groupBy(kind.alias("kind")).count().collect()}
    most = max(counts, default=0)
    pages = [math.ceil(counts.get(i, 0) / PAGE) or 1 for i in range(most + 1)]
    first = [sum(pages[:i]) for i in range(most + 1)]
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), kind + 1)
    return docs.select("id", "text", (at(first) + F.pmod(F.xxhash64("id"), at(pages))).alias("page"))


def bucket(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    """Writes the index of docs (id, text): dealt by a hash of the stem, sorted by stem and page, so that a read of few stems opens few folders and row groups.

    Texts are shuffled to their pages; a page, a bounded number of documents, becomes its rows of
    the index in one call, which looks up the stem of each different word once. Only those rows
    are shuffled to their places: a bucket of stems by SLICE pages, so no stem is one task's and
    nothing is sampled first. Null texts have no words; a repeated id is one document that has all
    the words of its rows.
    """
    texts = paged(docs).select("page", F.col("id").cast("long").alias("id"), F.lower("text").alias("text"))
    rows = texts.groupBy("page").applyInArrow(index_page, PAGE_ROWS).withColumn("bucket", bucket(F.col("stem")))
    rows.repartition("bucket", F.expr(f"page div {SLICE}")).sortWithinPartitions("bucket", "stem", "page").write.mode("overwrite").partitionBy("bucket").parquet(path)


def index_page(texts: pa.Table) -> pa.Table:
    """PAGE_ROWS of a page's texts (page, id, text in lower case): of each stem the ids in order, where each one's positions start (from 1, and an end), and the positions."""
    words = [WORD.findall(t) if t else [] for t in texts["text"].to_pylist()]
    n = np.fromiter(map(len, words), np.int64, len(words))
    every = pa.array(chain.from_iterable(words), pa.string(), size=n.sum()).dictionary_encode()
    stems = [None if w in STOP_WORDS else stem(w) for w in every.dictionary.to_pylist()]
    names = sorted({s for s in stems if s is not None})
    code_of = {s: i for i, s in enumerate(names)} | {None: -1}
    code = np.array([code_of[s] for s in stems], np.int64)[every.indices.to_numpy()]
    known = texts["id"].unique().sort()  # null last
    place = pc.index_in(texts["id"], known).to_numpy()
    # code, place of the id and position in one number each, which are sorted
    low, high = int(n.max(initial=0)).bit_length(), len(known).bit_length()
    keys = (code << (low + high)) + np.repeat(place << low, n) + np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    keys = np.sort(keys[code >= 0])
    runs = np.flatnonzero(np.diff(keys >> low, prepend=-1))
    ids = keys[runs] >> low
    first = np.flatnonzero(np.diff(ids >> high, prepend=-1))
    lengths, documents = np.diff(runs, append=len(keys)), np.diff(first, append=len(runs))
    # a stem has a start for each of its documents, and the end of the last
    begins, total = runs[first], np.append(runs, len(keys))
    at = np.repeat(first, documents + 1) + np.arange(len(runs) + len(first)) - np.repeat(first + np.arange(len(first)), documents + 1)
    starts = total[at] - np.repeat(begins, documents + 1) + 1
    listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    entries = pa.StructArray.from_arrays(
        [
            listed(np.append(first, len(runs)), known.take(pa.array(ids & ((1 << high) - 1)))),
            listed(np.append(first + np.arange(len(first)), len(starts)), pa.array(starts, pa.int32())),
            listed(np.append(begins, len(keys)), pa.array(keys & ((1 << low) - 1), pa.int32())),
        ],
        ["ids", "starts", "positions"],
    )
    most = np.maximum.reduceat(lengths, first) if len(first) else first
    return pa.table({"stem": pa.array(names, pa.string()), "page": pa.repeat(texts["page"][0], len(names)), "documents": pa.array(documents, pa.int64()), "max_tf": pa.array(most, pa.int32()), "entries": entries})


@dataclass
class Query:
    """stems: all of them, in order. ways: of each alternative, the stems that must and must not be there, and phrases, by their places in stems."""

    stems: list[str]
    ways: list[tuple[list[int], list[int], list[list[tuple[int, int]]]]]

    @property
    def near(self) -> bool:
        """Whether rank is by nearness."""
        return len(self.ways) == 1 and len(self.stems) > 1


def parse_query(q: str) -> list[tuple[list[str], list[str], list[list[tuple[str, int]]]]]:
    """A web-style query: alternatives, parted by OR, of words that must match, words that must not, and phrases (words with their distances from the first)."""
    ways: list[tuple[list[str], list[str], list]] = [([], [], [])]
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if word.lower() == "or" and not neg:
            ways.append(([], [], []))
            continue
        every = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        found = [(w, i) for i, w in enumerate(every) if w not in STOP]
        must, never, phrases = ways[-1]
        (never if neg else must).extend(w for w, _ in found)
        if len(found) > 1 and not neg:
            phrases.append([(w, i - found[0][1]) for w, i in found])
    return [w for w in ways if w[0]]


def stemmed(spark: SparkSession, q: str) -> Query:
    """The query with stems for words; a query of stop words and exclusions only has no alternatives."""
    ways = parse_query(q)
    words = sorted({w for must, never, _ in ways for w in [*must, *never]})
    of = {w: stem(w) for w in words}
    stems = sorted(set(of.values()))
    at = lambda w: stems.index(of[w])
    return Query(stems, [(sorted({at(w) for w in must}), sorted({at(w) for w in never}), [[(at(w), i) for w, i in p] for p in phrases]) for must, never, phrases in ways])


def read_index(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """The rows of a query's stems, with k, the stem's place in the query."""
    stored = spark.read.schema(INDEX).parquet(path)
    if not query.stems:
        return stored.limit(0).withColumn("k", F.lit(0))
    wanted = spark.range(1).select(F.array(*[bucket(F.lit(s)) for s in query.stems])).first()[0]
    rows = stored.where(F.col("bucket").isin(sorted(set(wanted))) & F.col("stem").isin(query.stems))
    return rows.withColumn("k", (F.array_position(F.array(*[F.lit(s) for s in query.stems]), F.col("stem")) - 1).cast("int"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def nearness(distance: Column) -> Column:
    """What a pair of positions adds: sqrt of both weights and a falling function of the words between; next to nothing beyond 100."""
    return F.lit(WEIGHT) * F.sqrt(F.when(distance > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))))


def _positions(k: int) -> Column:
    return F.sort_array(F.flatten(F.transform(F.filter("all", lambda x: x["k"] == k), lambda x: x["positions"])))  # an id may be on several pages


def _shifted(k: int, distance: int) -> Column:
    return F.transform(f"p{k}", lambda p: p - distance)


def _apart(some: Column, others: Column) -> Column:
    """What is left of 1 once every pair of positions has taken its share of the rest."""

    def pair(left: Column, p: Column, q: Column) -> Column:
        return F.when(p == q, left).otherwise(left * (1 - nearness(F.abs(p - q).cast("double"))))

    return F.aggregate(some, F.lit(1.0), lambda left, p: F.aggregate(others, left, lambda rest, q: pair(rest, p, q)))


def matches(rows: DataFrame, query: Query) -> DataFrame:
    """id, rank of the documents among index rows that match."""
    if not query.ways:
        return rows.limit(0).select(F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("rank"))
    n = len(query.stems)
    start = lambda i: F.get("entries.starts", i)
    each = F.transform("entries.ids", lambda x, i: F.struct(x.alias("id"), F.slice("entries.positions", start(i), start(i + 1) - start(i)).alias("positions")))
    hits = rows.select("k", F.explode(each).alias("e")).groupBy("e.id").agg(F.collect_list(F.struct("k", "e.positions")).alias("all"))
    hits = hits.select("id", *[_positions(i).alias(f"p{i}") for i in range(n)])
    has = lambda i: F.size(f"p{i}") > 0

    def together(phrase: list[tuple[int, int]]) -> Column:
        return F.size(reduce(F.array_intersect, [_shifted(i, d) for i, d in phrase])) > 0

    ok = _any([_all([has(i) for i in must] + [~has(i) for i in never] + [together(p) for p in phrases]) for must, never, phrases in query.ways])
    first = [F.slice(f"p{i}", 1, MOST_POSITIONS) for i in range(n)]
    if query.near:
        pairs = [_apart(first[i], first[k]) for i in range(n) for k in range(i)]
        rank = 1 - reduce(lambda a, b: a * b, pairs)
    else:
        rank = reduce(lambda a, b: a + b, [F.aggregate(F.sequence(F.lit(0), F.size(f)), F.lit(0.0), lambda a, j: F.when(j > 0, a + 1 / (j * j)).otherwise(a)) for f in first]) * WEIGHT / ZETA2 / n
    return hits.where(ok).select("id", F.round(rank, 6).alias("rank"))


def page_bounds(rows: DataFrame, query: Query) -> DataFrame:
    """page, bound: no document of the page has a higher rank; pages that can't match are left out. Entries aren't read."""
    n = len(query.stems)
    tf = [F.least(F.col(f"t{i}"), F.lit(MOST_POSITIONS)) for i in range(n)]
    pages = rows.groupBy("page").agg(*[F.coalesce(F.max(F.when(F.col("k") == i, F.col("max_tf"))), F.lit(0)).alias(f"t{i}") for i in range(n)])
    pages = pages.where(_any([_all([F.col(f"t{i}") > 0 for i in must]) for must, _, _ in query.ways]))
    if query.near:
        closest = math.log(1 - WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2))))
        pairs = reduce(lambda a, b: a + b, [tf[i] * tf[k] for i in range(n) for k in range(i)])
        bound = 1 - F.exp(pairs * closest)
    else:
        sums = [0.0]
        for j in range(1, MOST_POSITIONS + 1):
            sums.append(sums[-1] + 1 / j**2)
        table = F.array(*[F.lit(s) for s in sums])
        bound = reduce(lambda a, b: a + b, [F.element_at(table, t + 1) for t in tf]) * WEIGHT / ZETA2 / n
    return pages.select("page", (bound + 1e-6).alias("bound"))  # ranks are rounded to so much


def full_text(spark: SparkSession, path: str, q: str) -> DataFrame:
    """id, rank of every document of a stored index that matches a web-style query."""
    query = stemmed(spark, q)
    return matches(read_index(spark, path, query), query)


def top_pages(spark: SparkSession, path: str, query: Query, k: int) -> list[DataFrame]:
    """The index rows that hold the k best: those of the most promising pages, and those of the others that can still hold one."""
    rows = read_index(spark, path, query)
    bounds = page_bounds(rows, query)
    first = [r["page"] for r in bounds.orderBy(F.col("bound").desc(), "page").limit(FIRST_PAGES).collect()]
    read = rows.where(F.col("page").isin(first))
    least = matches(read, query).orderBy(F.col("rank").desc(), "id").limit(k).agg(F.when(F.count("*") == k, F.min("rank"))).first()[0]
    left = bounds.where(~F.col("page").isin(first) & (F.lit(True) if least is None else F.col("bound") >= least))
    return [read, rows.join(left.select("page"), "page", "left_semi")]


def full_text_top(spark: SparkSession, path: str, q: str, k: int) -> DataFrame:
    """id, rank of the k best matches of a web-style query, ties to the smaller id: what full_text has first, from fewer rows."""
    query = stemmed(spark, q)
    if not query.ways:
        return matches(read_index(spark, path, query), query)
    some, others = top_pages(spark, path, query, k)
    return matches(some.unionByName(others), query).orderBy(F.col("rank").desc(), "id").limit(k)
