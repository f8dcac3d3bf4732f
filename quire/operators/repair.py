"""Repair of lost characters from the text of the pages around them.

A lost character's surroundings give up to four patterns, from the surest to the widest. All
patterns of all lost characters are rows; they are held against the pages in one join, the
characters found are counted by pattern, and the first pattern that one character answers wins.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import materialize

LOST = "�"
# Characters of context on either side, wide and narrow; the block of mathematical letters.
WIDE, NARROW, MATH_LETTERS = 24, 10, (0x1D400, 0x1D7FF)
#: Mathematical letters and digits and what they are letters of.
_PLAIN = {chr(c): p for c in range(MATH_LETTERS[0], MATH_LETTERS[1] + 1) if (p := unicodedata.normalize("NFKD", chr(c))).isalnum() and len(p) == 1}


def inline(character: Column) -> Column:
    """A mathematical letter as inline LaTeX of its plain form; others as they are."""
    plain = F.translate(character, "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.when(plain != character, F.concat(F.lit("$"), plain, F.lit("$"))).otherwise(character)


def _literal(context: Column) -> Column:
    """A pattern for a context without its white space, in which lost characters stand for any."""
    bare = F.regexp_replace(context, r"(?U)\s+", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit(r"\Q"), F.replace(F.replace(bare, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(LOST), F.lit(r"\E.\Q")), F.lit(r"\E")))


def patterns(hurt: DataFrame) -> DataFrame:
    """rid, place, key, pattern of texts (rid, pieces: the text cut at its lost characters): both sides, the side before, the side after, both sides closely."""
    rows = hurt.withColumn("place", F.explode(F.sequence(F.lit(1), F.size("pieces") - 1)))
    # no more pieces than characters of context can be part of it
    before = F.slice("pieces", F.greatest(F.lit(1), F.col("place") - WIDE), F.least(F.col("place"), F.lit(WIDE + 1)))
    after = F.slice("pieces", F.col("place") + 1, F.lit(WIDE + 1))
    rows = rows.withColumn("left", F.right(F.array_join(F.transform(before, lambda p: F.right(p, F.lit(WIDE))), LOST), F.lit(WIDE)))
    rows = rows.withColumn("right", F.left(F.array_join(F.transform(after, lambda p: F.left(p, F.lit(WIDE))), LOST), F.lit(WIDE)))
    wide, near = (_literal(F.col("left")), _literal(F.col("right"))), (_literal(F.right("left", F.lit(NARROW))), _literal(F.left("right", F.lit(NARROW))))
    sides = [(wide[0], wide[1]), (wide[0], F.lit("")), (F.lit(""), wide[1]), near]
    every = F.array(*[F.when((a != "") | (b != ""), F.concat(F.lit("(?s)"), a, F.lit("(.)"), b)) for a, b in sides])
    return rows.select("rid", "document_id", "page", "place", F.posexplode(every).alias("key", "pattern")).where("pattern is not null")


def repair_glyphs(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks (document_id, page, text, and any others) with their lost characters put right.

    pages: document_id, page, content. A chunk is compared with its page and the two beside
    it, or with all of its document's where its page is null. Only damaged chunks are joined
    with pages, and written with a number of their own, so that repeated rows stay apart; what
    stays lost is left as it is, and a null text stays null. The joins are merge joins at every
    size: files of such rows are small, the rows aren't, and are not for the driver to broadcast.
    """
    bare = pages.select("document_id", F.col("page").alias("at"), F.regexp_replace("content", r"(?U)\s+", "").alias("content"))
    damaged = F.coalesce(F.contains("text", F.lit(LOST)), F.lit(False))
    names = chunks.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    hurt = materialize(chunks.where(damaged).select(row.alias("row"), F.monotonically_increasing_id().alias("rid"), F.split("text", LOST, -1).alias("pieces")), "damaged-chunks")
    asked = patterns(hurt.select("rid", "row.document_id", "row.page", "pieces"))
    beside = asked.where("page is not null").withColumn("at", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1))).join(bare.hint("merge"), ["document_id", "at"])
    anywhere = asked.where("page is null").join(bare.hint("merge"), "document_id")
    met = beside.select("rid", "place", "key", "pattern", "content").unionByName(anywhere.select("rid", "place", "key", "pattern", "content"))
    found = met.select("rid", "place", "key", F.explode(F.array_distinct(F.regexp_extract_all("content", F.col("pattern"), F.lit(1)))).alias("c"))
    answers = found.groupBy("rid", "place", "key").agg(F.min("c").alias("c"), (F.min("c") == F.max("c")).alias("one")).where((F.col("one")) & (F.col("c") != LOST))
    first = answers.groupBy("rid", "place").agg(inline(F.min_by("c", "key")).alias("c"))
    known = first.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "c"))).alias("known"))
    whole = hurt.join(known.hint("merge"), "rid", "left")
    said = F.coalesce("known", F.create_map().cast("map<int,string>"))
    text = F.array_join(F.transform("pieces", lambda p, i: F.when(i < F.size("pieces") - 1, F.concat(p, F.coalesce(F.try_element_at(said, i + 1), F.lit(LOST)))).otherwise(p)), "")
    return chunks.where(~damaged).unionByName(whole.select(*[text.alias(n) if n == "text" else F.col(f"row.`{n}`") for n in names]))
