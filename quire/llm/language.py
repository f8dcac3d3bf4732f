"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample texts. A text is compressed
with every dictionary, in blocks, and the language whose dictionary leaves the fewest
bytes wins; texts of every length go the same way. A text whose margin is narrow is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import pick, table

#: The fitting sample is bounded: so many labelled texts of a language, and so many languages.
SAMPLE_TEXTS, LANGUAGES = 128, 200
#: Longer texts, in bytes, are not learnt from, so that the sample is bounded in bytes too.
LONGEST_LEARNT = 1 << 17
#: Lengths, in characters, of texts that are taken first.
FITTING = (100, 8000)
LEVEL, BLOCK = 6, 4096
MIN_MARGIN = 0.005
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> bytes:
    """Lower-case letters of the whole text, each run of anything else one space; empty if it has no letter."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language from rows (text, lang) with neither null; nothing else of the rows is read.

    Of each language, the `texts` different texts with the smallest hashes are taken, those
    whose length is FITTING first, and whole. Should there be more languages than `languages`,
    those with the most texts are learnt, and texts beyond LONGEST_LEARNT are not. Only the sample reaches the driver: a first pass
    counts the texts of languages, and a second one keeps about three times the rows that
    are wanted. No labelled text, no dictionaries.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST_LEARNT)).select("lang", "text", F.xxhash64("text", F.lit("fit")).alias("h"))
    fits = F.length("text").between(*FITTING)
    counted = rows.groupBy("lang").agg(*[F.approx_count_distinct(F.when(c, F.col("h"))).alias(n) for n, c in (("fit", fits), ("other", ~fits))])
    counts = {r["lang"]: (r["fit"], r["other"]) for r in counted.orderBy((F.col("fit") + F.col("other")).desc(), "lang").limit(languages).collect()}
    if not counts:
        return {}
    near = lambda n: min(1.0, 3 * texts / max(1, n))
    place = F.pmod(F.col("h"), F.lit(1_000_000)) / 1_000_000
    wanted = [(F.col("lang") == lang) & fits & (place < near(n)) for lang, (n, _) in sorted(counts.items())]
    wanted += [(F.col("lang") == lang) & ~fits & (place < near(m)) for lang, (n, m) in sorted(counts.items()) if n < 2 * texts]
    few = rows.where(reduce(lambda a, b: a | b, wanted)).dropDuplicates(["lang", "h"])
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.when(fits, 0).otherwise(1), "h"))
    samples: dict[str, bytes] = {}
    for r in few.withColumn("k", first).where(F.col("k") <= texts).orderBy("lang", "k").collect():
        samples[r["lang"]] = samples.get(r["lang"], b"") + normalise(r["text"])
    return {lang: b for lang, b in samples.items() if b}


class Classifier:
    def __init__(self, samples: dict[str, bytes]):
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = {}
        for lang, sample in sorted(samples.items()):
            data = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)

    @staticmethod
    def _margin(sizes: list[tuple[int, str]]) -> float:
        return (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0]) if len(sizes) > 1 else 1.0

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin. Ties go to the language that comes first by name."""
        data = normalise(text)
        if not data or not self.by:
            return UNKNOWN, 0.0, 0.0
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by.items())
        best = sizes[0][0]
        share = 1 / sum(math.exp(-(n - best) / (1 + 0.03 * best)) for n, _ in sizes)
        return sizes[0][1], share, self._margin(sizes)


def _predictor(samples: Broadcast, keep: set[str], prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(samples.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            lang, score, margin = zip(*found) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n in keep]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + new, names=[n for _, n in kept] + [prefix + n for n in ("lang_pred", "score", "margin")])

    return run


def identify(docs: DataFrame, samples: dict[str, bytes], keep: list[str], prefix: str = "") -> DataFrame:
    """keep, lang_pred, score (0 to 1), margin, accepted; from the whole text of each row.

    A prefix to the new names keeps them apart from those in keep.

    Null text and text without a letter are `und` with score 0 and rejected, and so is all
    text if nothing was learnt. A narrow margin (below MIN_MARGIN) is rejected, with its
    nearest language named. Equal texts get equal results; repeated rows stay, and an empty
    table gives no rows. Map-side only: no shuffle, one batch of rows in memory, and the
    sample, whose bound fit names, broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    rows = pick(docs, dict.fromkeys([*keep, "text"]))
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c in keep)
    out = rows.mapInArrow(_predictor(shared, set(keep), prefix), f"{kinds}`{prefix}lang_pred` string, `{prefix}score` double, `{prefix}margin` double")
    return out.withColumn(f"{prefix}accepted", (F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}margin") >= MIN_MARGIN))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    samples = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, samples, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


QUERIES = {"op9_language_id": op9_language_id}
