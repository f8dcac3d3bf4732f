"""Page layout: joining spans, choosing crops, scoring extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import FOOTNOTE_MARKS, heading_level, math_score


def join_spans(spans: DataFrame, line: list[str], at: str) -> DataFrame:
    """The text of each line from its spans (text, left, right): a space where the gap is a quarter of a letter or more and neither side has one."""
    w = W.partitionBy(*line).orderBy(at)
    s = spans.withColumn("__r", F.lag("right").over(w)).withColumn("__t", F.lag("text").over(w))
    letter = F.greatest((F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1)), F.lit(1.0))
    space = F.col("__r").isNotNull() & (F.col("left") - F.col("__r") >= letter * 0.25) & ~F.col("__t").rlike("\\s$") & ~F.col("text").rlike("^\\s")
    s = s.withColumn("__piece", F.concat(F.when(space, " ").otherwise(""), "text"))
    return s.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "__piece"))), lambda e: e["__piece"]), "").alias("text"))


def crop(figures: DataFrame, rects: DataFrame, page: str) -> DataFrame:
    """For each figure (id, x0..y1) of a page the embedded rectangle (rid, rx0..ry1) that overlaps it most, else the page's largest, else none."""
    j = figures.join(rects, page, "left")
    w = F.greatest(F.lit(0.0), F.least("x1", "rx1") - F.greatest("x0", "rx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "ry1") - F.greatest("y0", "ry0"))
    area = (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))
    return j.groupBy("id").agg(F.max_by("rid", F.struct(F.coalesce(w * h, F.lit(0.0)).alias("o"), area.alias("a"), (-F.col("rid")).alias("r"))).alias("rid"))


# Section numbers, labels of equations that stand alone, ends that call for more, mathematics inside a line, and the glyphs that should have become LaTeX there.
SECTION_NUMBER = r"^(\d+(?:\.\d+)*)\.?\s+\S"
ORPHAN_LABEL = r"^\(\s*\d+[a-z]?\s*\)$"
OPEN_TAIL = r"(?:[+\-=*/^_,]|\\\\|\\left|\\begin\{[a-z]*\}?)\s*$"
INLINE_MATH = r"\$([^$\n]{1,400})\$"
MATH_GLYPHS = "√×÷∑∏∫≤≥≠≈≡∞∂∇⊕⊗⊆⊂∈∉∪∩αβγδεζηθκλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ"


def quality(blocks: DataFrame) -> DataFrame:
    """Scores of extracted documents (document_id, at, kind, text, left) and their total (document_id null).

    Counts of blocks, of headings, of those with a section number (numbered) and of numbers
    that are below the one before (inversions), of equations, of those next to each other
    (adjacent) and of those that end in the middle (open_tails), of labels left alone
    (orphans), of places in mathematics that hold glyphs (leaks) and of these glyphs
    (leaked); and whether two left edges (in bins of 40) each have 15 % of the blocks that
    have one. Tables hold no mathematics here. Null text is empty, null left is no edge.
    """
    w = W.partitionBy("document_id").orderBy("at")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    is_equation, is_heading = F.col("kind") == "equation", F.col("kind") == "heading"
    number = F.nullif(F.regexp_extract(text, SECTION_NUMBER, 1), F.lit(""))
    section = F.when(is_heading, F.transform(F.split(number, r"\."), lambda n: n.try_cast("decimal(38,0)")))
    spans = F.when(is_equation, F.array(text)).when(F.col("kind") != "table", F.regexp_extract_all(text, F.lit(INLINE_MATH), F.lit(1))).otherwise(F.array().cast("array<string>"))
    glyphs = F.filter(F.transform(spans, lambda s: F.length(F.regexp_replace(s, f"[^{MATH_GLYPHS}]", ""))), lambda n: n > 0)
    b = blocks.select("document_id", "at", "kind", section.alias("section"), glyphs.alias("glyphs"), text.rlike(ORPHAN_LABEL).alias("orphan"), (is_equation & text.rlike(OPEN_TAIL)).alias("tail"))
    b = b.withColumn("pair", is_equation & (F.lag("kind").over(w) == "equation"))
    b = b.withColumn("inverted", F.col("section") < F.last("section", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    n = lambda p: F.sum(F.when(p, 1).otherwise(0))
    sums = b.rollup("document_id").agg(
        F.count("*").alias("blocks"), n(is_heading).alias("headings"), n(F.col("section").isNotNull()).alias("numbered"), n(F.col("inverted")).alias("inversions"), n(is_equation).alias("equations"), n(F.col("pair")).alias("adjacent"),
        n(F.col("tail")).alias("open_tails"), n(F.col("orphan")).alias("orphans"), F.sum(F.size("glyphs")).alias("leaks"), F.sum(F.aggregate("glyphs", F.lit(0), lambda a, g: a + g)).alias("leaked"),
    )
    bins = blocks.where("left is not null").groupBy("document_id", F.round(F.col("left") / 40).alias("bin")).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("document_id")))
    columns = bins.groupBy("document_id").agg((n(F.col("n") >= F.col("all") * 0.15) >= 2).alias("two_columns"))
    return sums.join(columns, "document_id", "left")


#: A page's bottom begins here, for small type or marked lines, and here for marked lines; type this small against the body's.
BAND, MARKED_BAND, SMALL = 0.85, 0.7, 0.95
#: Lines of mathematics score so much.
MATH = 0.04


def assemble_pages(lines: DataFrame, key: str) -> DataFrame:
    """key and markdown of each page from its lines.

    lines: key, x0, y0, text, size, bold, height (the page's), body (the size of body text),
    and image (a file's name, else null). Lines go from top to bottom; headings by size, runs
    of mathematics become one display block, an image stands on its own. Footnotes - marked
    lines low on the page, small type at its bottom - come last, each with a mark.
    """
    mark = F.col("text").rlike(f"^\\s*[{FOOTNOTE_MARKS}]")
    low = (F.col("y0") >= F.col("height") * BAND) & (((F.col("size") > 0) & (F.col("size") < F.col("body") * SMALL)) | mark)
    note = F.col("image").isNull() & (low | (mark & (F.col("y0") >= F.col("height") * MARKED_BAND)))
    level = heading_level(F.col("size"), F.col("body"), F.length("text"), F.col("bold"))
    is_math = math_score(F.col("text")) >= MATH
    kind = F.when(F.col("image").isNotNull(), "image").when(note, "note").when(level.isNotNull(), "heading").when(is_math, "math").otherwise("text")
    k = lines.withColumn("kind", kind).withColumn("level", level).withColumn("last", (F.col("kind") == "note").cast("int"))
    order = W.partitionBy(key).orderBy("last", "y0", "x0", "text")
    begins = (F.col("kind") != "math") | F.coalesce(F.lag("kind").over(order) != "math", F.lit(True))
    k = k.withColumn("at", F.row_number().over(order)).withColumn("run", F.sum(begins.cast("int")).over(order))
    runs = k.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts"), F.first("kind").alias("kind"), F.first("level").alias("level"), F.first("image").alias("image"))
    first = F.get("texts", F.lit(0))["text"]
    marked = F.when(first.rlike("^\\s*[*∗⋆★✱✲†‡§¶]"), first).otherwise(F.concat(F.lit("∗ "), first))
    part = (
        F.when(F.col("kind") == "math", F.concat(F.lit("\n$$\n"), F.array_join(F.transform("texts", lambda t: t["text"]), " \\\\ \n"), F.lit("\n$$\n")))
        .when(F.col("kind") == "image", F.concat(F.lit("\n!["), "image", F.lit("]("), "image", F.lit(")\n")))
        .when(F.col("kind") == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), first, F.lit("\n")))
        .when(F.col("kind") == "note", F.concat(F.lit("\n"), marked, F.lit("\n"))).otherwise(first)
    )
    pages = runs.select(key, "run", part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "part"))).alias("parts"))
    return pages.select(key, F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("markdown"))
