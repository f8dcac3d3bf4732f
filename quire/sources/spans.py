"""Pages as a PDF library dumps them: blocks of lines of spans, with places and sizes.

A file holds a page a line, as JSON (PAGE). Reading it is the same for a folder that is
whole and for one that grows: pages(spark.read, path), pages(spark.readStream, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..operators.layout import assemble_pages

SPAN = "struct<text:string, size:double, font:string, flags:int, bbox:array<double>>"
PAGE = f"document_id string, page int, width double, height double, snapshot string, blocks array<struct<type:int, image:string, bbox:array<double>, lines:array<struct<bbox:array<double>, spans:array<{SPAN}>>>>>"
# The bit of bold type among a span's flags; the size of body text where there is none.
BOLD, BODY = 16, 10.0


def pages(reader, path: str) -> DataFrame:
    """The pages (PAGE) of a folder's files, from a reader or a stream reader; lines that are no JSON have nulls."""
    return reader.schema(PAGE).option("recursiveFileLookup", "true").json(path)


def line_text(spans: Column) -> Column:
    """A line's text from its spans in order: as layout.join_spans, within a row."""

    def piece(s: Column, i: Column) -> Column:
        text, before = F.coalesce(s["text"], F.lit("")), F.get(spans, i - 1)
        left, right = s["bbox"][0], s["bbox"][2]
        letter = F.greatest((right - left) / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))
        space = (i > 0) & (left - before["bbox"][2] >= letter * 0.25) & ~F.coalesce(before["text"], F.lit("")).rlike("\\s$") & ~text.rlike("^\\s")
        return F.concat(F.when(space, " ").otherwise(""), text)

    return F.array_join(F.transform(spans, piece), "")


def page_lines(pages: DataFrame) -> DataFrame:
    """The lines of pages: document_id, page, block, line, x0, y0, text, size, bold, height, image.

    size is that of the largest span that has more than spaces, bold tells of any of them. An
    image is a line of its own, with its file's name; lines without text are none. A row's
    lines come from that row alone, so a stream of pages gives a stream of lines.
    """
    of_image = F.array(F.struct(F.col("b.bbox").alias("bbox"), F.array().cast(f"array<{SPAN}>").alias("spans")))
    blocks = pages.select("document_id", "page", "height", F.posexplode("blocks").alias("block", "b"))
    lines = blocks.select("document_id", "page", "height", "block", F.when(F.col("b.type") == 1, F.col("b.image")).alias("image"), F.posexplode(F.when(F.col("b.type") == 1, of_image).otherwise(F.col("b.lines"))).alias("line", "l"))
    seen = F.filter(F.coalesce("l.spans", F.array().cast(f"array<{SPAN}>")), lambda s: F.coalesce(F.trim(s["text"]), F.lit("")) != "")
    bold = F.exists(seen, lambda s: F.coalesce(F.contains(F.lower(s["font"]), F.lit("bold")), F.lit(False)) | (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(BOLD) > 0))
    text = let(F.coalesce("l.spans", F.array().cast(f"array<{SPAN}>")), lambda s: F.regexp_replace(line_text(s), r"^\s+|\s+$", ""))
    at = lambda i: F.coalesce(F.get("l.bbox", F.lit(i)), F.lit(0.0))
    size = F.coalesce(F.array_max(F.transform(seen, lambda s: s["size"])), F.lit(0.0))
    out = lines.select("document_id", "page", "block", "line", at(0).alias("x0"), at(1).alias("y0"), text.alias("text"), size.alias("size"), bold.alias("bold"), F.when(F.col("height") > 0, F.col("height")).otherwise(1.0).alias("height"), "image")
    return out.where("image is not null or text <> ''")


def body_sizes(pages: DataFrame) -> DataFrame:
    """document_id, body: the size, to a tenth, in which most letters of a document are set; of equals the smaller."""
    spans = F.flatten(F.transform(F.filter("blocks", lambda b: b["type"] == 0), lambda b: F.flatten(F.transform(b["lines"], lambda line: line["spans"]))))
    each = pages.select("document_id", F.explode(spans).alias("s")).where("trim(s.text) <> '' and s.size is not null")
    sizes = each.groupBy("document_id", F.round("s.size", 1).alias("size")).agg(F.sum(F.length("s.text")).alias("n"))
    return sizes.groupBy("document_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def markdown_of(pages: DataFrame) -> DataFrame:
    """document_id, markdown of documents whose pages are given: each page assembled, then its snapshot's image if it has one."""
    lines = page_lines(pages).join(body_sizes(pages), "document_id", "left").withColumn("body", F.coalesce("body", F.lit(BODY)))
    made = assemble_pages(lines.withColumn("of", F.struct("document_id", "page")), "of").select("of.document_id", "of.page", F.struct(F.lit(0).alias("n"), F.col("markdown").alias("part")).alias("p"))
    shots = pages.where("snapshot <> ''").select("document_id", "page", F.struct(F.lit(1).alias("n"), F.concat(F.lit("![Page "), F.col("page") + 1, F.lit("]("), "snapshot", F.lit(")")).alias("part")).alias("p"))
    parts = made.where("p.part <> ''").unionByName(shots).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "p"))).alias("parts"))
    return parts.select("document_id", F.array_join(F.transform("parts", lambda e: e["p"]["part"]), "\n\n").alias("markdown"))
