"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased, what is no letter is a space, and its features are the hashed runs of 3 to
6 characters inside a word with the space before and after it. The naive Bayes ratio of a feature
is the log of its smoothed share among toxic texts over that among the others. A text's vector
holds the ratio of every feature that it has, scaled to length 1, and a logistic model with an L1
penalty is fitted to these vectors, toxic texts weighing more, as they are fewer.

The model is fitted to a bounded sample of labelled texts (SAMPLE); what reaches the driver of
them is the features that have a place in the model. Scoring is map-side: no shuffle, and a text
of any length is hashed block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop_folder, new_folder, pick, remembered, table

#: Labelled texts that are learnt from, at most, and how many labels' worth of documents are looked at to find them.
SAMPLE, SPARE = 20_000, 1.2
BUCKETS = 1 << 18
SHORTEST, LONGEST = 3, 6
#: A feature has a place in the model if so many sample texts have it and its ratio is as far from 0; the furthest, if there are more than FEATURES.
MIN_TEXTS, MIN_RATIO, FEATURES = 3, 1.0, 1 << 16
PENALTY, ROUNDS, MOST_WEIGHT = 1e-4, 300, 3.0
#: Characters hashed at once.
BLOCK = 1 << 17


def _letters() -> np.ndarray:
    """Which code points are letters."""
    known = remembered("toxicity")
    if "letters" not in known:
        known["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return known["letters"]


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, block by block; a feature may come again."""
    a = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    a = np.where(_letters()[a], a, np.uint32(32))
    space = a == 32
    a = a[~(space & np.concatenate(([False], space[:-1])))]
    for start in range(0, len(a), BLOCK):
        b = a[start : start + BLOCK + LONGEST - 1].astype(np.uint64)
        first = min(BLOCK, len(b))
        spaces = np.concatenate(([0], np.cumsum(b == 32)))
        h = np.zeros(len(b), np.uint64)
        for n in range(1, min(LONGEST, len(b)) + 1):
            h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :]
            if n >= SHORTEST:
                m = min(len(h), first)
                inner = spaces[n - 1 : n - 1 + m] == spaces[1 : m + 1]  # no space but at the ends
                g = h[:m][inner]
                g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield ((g ^ (g >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


def features(text: str | None, known: np.ndarray | None = None) -> np.ndarray:
    """The features of a whole text, each once, in ascending order; only those that known marks, if given."""
    seen, held = [np.zeros(0, np.int32)], 0
    for g in hashed(text):
        seen.append(g if known is None else g[known[g]])
        held += len(seen[-1])
        if held > 4 * BLOCK:
            seen, held = [np.unique(np.concatenate(seen))], 0
    return np.unique(np.concatenate(seen))


@dataclass
class Model:
    """ratio and weight of every bucket (0 if it has no place), and the bias. A model that has seen one label only gives `only`."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    only: float | None = None

    def score(self, text: str | None) -> float:
        """0 to 1: higher, the likelier toxic. A text without features is told by the bias."""
        if self.only is not None:
            return self.only
        f = features(text, self.ratio != 0)
        r = self.ratio[f]
        m = self.bias + (float(r @ self.weight[f]) / math.sqrt(float(r @ r)) if len(f) else 0.0)
        return 1 / (1 + math.exp(-m)) if m > -700 else 0.0


def fit_vectors(index: np.ndarray, pointers: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model by accelerated proximal steps; texts are rows of a sparse matrix (index, pointers)."""
    n, row, value = len(toxic), np.repeat(np.arange(len(toxic)), np.diff(pointers)), ratio[index]
    value = value / np.sqrt(np.maximum(np.bincount(row, value**2, n), 1e-12))[row]
    heavy = min(MOST_WEIGHT, max(1.0, (n - toxic.sum()) / toxic.sum()))
    share = np.where(toxic == 1, heavy, 1.0) / n
    size, v = len(ratio), np.ones(len(ratio))
    for _ in range(12):  # the largest eigenvalue bounds the steps
        v = np.bincount(index, value * (share * np.bincount(row, value * v[index], n))[row], size)
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-300)
    rate = 4 / (1.1 * top + share.sum())
    w, b, z, zb, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(ROUNDS):
        m = np.bincount(row, value * z[index], n) + zb
        slope = (1 / (1 + np.exp(-np.clip(m, -50, 50))) - toxic) * share
        nw = z - rate * np.bincount(index, value * slope[row], size)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * PENALTY, 0)
        nb, nt = zb - rate * slope.sum(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


FEATURED = "toxic int, h long, features binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("h"), pa.array(found, pa.binary())], names=["toxic", "h", "features"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have a bucket, by label: a task's sums."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for y, f in zip(batch.column("toxic").to_pylist(), batch.column("features")):
            counts[y, np.frombuffer(f.as_py(), "<i4")] += 1
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "clean", "toxic"])


def candidates(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE) -> DataFrame:
    """About `texts` labelled texts, or somewhat more: text, toxic, their hash h, no two alike in text and label.

    Labels are taken by the hash of their id, somewhat more than are wanted, as some have no
    document; they are few enough to go to every task, so that no text moves but these.
    """
    said = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    share = min(1.0, SPARE * texts / max(1, said.count()))
    few = said.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    own = pick(docs, ["doc_id", "text"]).where("text is not null").join(F.broadcast(few), "doc_id")
    kept = own.select("text", "toxic", F.xxhash64("text", "toxic").alias("h"), F.md5(F.col("text").cast("binary")).alias("same"))
    return kept.dropDuplicates(["same", "toxic"]).drop("same")


def sample(featured: DataFrame, texts: int = SAMPLE) -> DataFrame:
    """The `texts` rows with the smallest hashes."""
    last = featured.select("h").orderBy("h").limit(texts).agg(F.max("h")).first()[0]
    return featured.where(F.col("h") <= F.lit(last))


def fit(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic); nothing else of the rows is read.

    Null ids, texts and labels, and labels other than 0 and 1, teach nothing; a document with both
    labels is learnt as both; copies of a text with a label count once. Without labels every score
    is 0, with one label only it is that label.
    """
    spark, none = docs.sparkSession, np.zeros(BUCKETS)
    folder = new_folder(spark, "toxic-sample")
    candidates(docs, labels, texts).mapInArrow(_featured, FEATURED).write.parquet(folder)
    rows = sample(spark.read.schema(FEATURED).parquet(folder), texts)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        drop_folder(spark, folder)
        return Model(none, none, 0.0, float(max(n, default=0)))
    sums = rows.select("toxic", "features").mapInArrow(_counted, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = sums.toPandas()  # a row a bucket at most
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    clean[counts["bucket"]], toxic[counts["bucket"]] = counts["clean"], counts["toxic"]
    ratio = np.log((toxic + 1) / (toxic.sum() + BUCKETS)) - np.log((clean + 1) / (clean.sum() + BUCKETS))
    ratio[(clean + toxic < MIN_TEXTS) | (np.abs(ratio) < MIN_RATIO)] = 0
    ratio[np.argsort(-np.abs(ratio), kind="stable")[FEATURES:]] = 0
    shared = spark.sparkContext.broadcast(ratio != 0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f.as_py(), "<i4") for f in batch.column("features")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[shared.value[f]].tobytes() for f in found], pa.binary())], names=["toxic", "features"])

    own = rows.select("toxic", "features").mapInArrow(placed, "toxic int, features binary").orderBy("features", "toxic").collect()
    drop_folder(spark, folder)
    each = [np.frombuffer(r["features"], "<i4") for r in own]
    index, pointers = np.concatenate(each), np.cumsum([0, *map(len, each)])
    weight, bias = fit_vectors(index, pointers, np.array([r["toxic"] for r in own], float), ratio)
    return Model(ratio, weight, bias)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, toxic_score (0 to 1) of the whole text of each row.

    Null and empty texts, and texts without a letter, have the score of a text without features.
    Equal texts get equal scores; repeated rows stay, other columns go unless kept, and an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            found = pa.array([of.score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "toxic_score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), "toxic_score double"]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels of those that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
