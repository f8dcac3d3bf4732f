"""Chunks of typed blocks and of Markdown, as plans.

Documents are cut into lines or blocks, which are rows with their place; what a row is to the
equation or heading before it comes from windows over a document; documents are independent.
Heading paths are folded once a heading, and sequence numbers are 1 to N without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tables as tb, text as x
from .windows import heading_paths

COLUMNS = ["document_id", "sequence_id", "chunk_type", "heading_path", "markdown", "plain_text", "page_start", "page_end", "token_count", "image_refs", "table_json"]
# Block types that are page furniture, and those that are notes.
FURNITURE, NOTES = ["page_number", "header", "footer"], ["page_footnote", "aside_text"]
#: Footnotes are looked for in so many blocks of a Markdown document, which has no pages.
EARLY_BLOCKS = 25
BLOCKS = (
    "array<struct<type:string,text:string,text_level:int,page_idx:int,img_path:string,img_caption:variant,chart_caption:variant,table_caption:variant,code_caption:variant,caption:variant,"
    "table_body:string,list_items:array<string>,items:array<string>,code_body:string>>"
)
# Display mathematics; how a line ends that leaves an equation open; how one begins that goes on with it; an equation's
# number on a line of its own; what makes a short line a piece of mathematics, and what makes it prose; lines that are structure.
DISPLAY = r"(?s)\$\$((?:(?!\n\s*\n).)+?)\$\$"
OPEN_TAIL = r"(?:[=+\-×·∈⊆⊇⊂⊃≤≥≠≈∝<>(\[{,]|\\[A-Za-z]+|[A-Z][A-Za-z]*\(|[A-Z][a-z]?[A-Z][A-Z0-9]*)\s*$"
CLOSE_HEAD = r"^(?:[)\]},.;]|[+\-×·∑∏∫=≤≥≠≈]|V[\s.,]|W[\s.,]|\\[A-Za-z]+|[a-zA-Z]_?\^?\{)"
LABEL = r"^\(\s*\d+[a-z]?\s*\)$"
PIECE, SHORT, PROSE = r"[=+−\-×·÷∑∏∫∞≤≥≠≈∈∉⊂⊃∅∂∇()\[\]{}^_√]|[α-ωΑ-Ω]|[A-Z][a-z]?[A-Z]|[A-Za-z]_?\d|^[A-Za-z0-9]{1,3}$", 80, r"[.?!]\s+\S"
STRUCTURE = r"^(?:!\[|\||#{1,6}\s|>|[-*] )"


def line_class(line: Column) -> Column:
    """What a line is to an equation beside it: blank, label, piece, or text."""
    s = x.strip(line)
    return (
        F.when(s == "", "blank").when(s.rlike(LABEL), "label").when(s.rlike(STRUCTURE), "text").when(s.rlike(CLOSE_HEAD), "piece")
        .when((F.length(s) > SHORT) | s.rlike(PROSE), "text").when(s.rlike(PIECE), "piece").otherwise("text")
    )


def _marked(md: Column, pattern: str) -> Column:
    """Pieces of md: those that begin with m are what the pattern's first group holds, those with t the text between."""
    return F.split(F.concat(F.lit("t"), F.regexp_replace(F.replace(md, F.lit("\u0001"), F.lit(" ")), pattern, "\u0001m$1\u0001t")), "\u0001")


def lines(documents: DataFrame) -> DataFrame:
    """document_id, at, kind, line: display mathematics and lines of the rest, in order; text beside a fence is a line of its own."""

    def cut(s: Column) -> Column:
        body = F.substring(s, F.lit(2), F.length(s))
        own = F.split(body, "\n")
        # the ends of the text between two fences are no lines of their own unless they hold something
        text = F.filter(F.transform(own, lambda v, i: F.when((x.strip(v) != "") | ((i > 0) & (i < F.size(own) - 1)), F.struct(F.lit(False).alias("display"), v.alias("line")))), lambda v: v.isNotNull())
        return F.when(s.startswith("m"), F.array(F.struct(F.lit(True).alias("display"), x.strip(body).alias("line")))).otherwise(text)

    rows = documents.select("document_id", F.posexplode(F.flatten(F.transform(_marked(F.col("markdown"), DISPLAY), cut))).alias("at", "v"))
    return rows.select("document_id", "at", F.when(F.col("v.display"), "display").otherwise(line_class(F.col("v.line"))).alias("kind"), "v.line")


def stitch(documents: DataFrame) -> DataFrame:
    """document_id, markdown, stitched: equations that extraction has cut, joined again. document_id tells documents apart.

    Every text line begins an island. In an island, the first display mathematics opens an
    equation, taking back the line before it if that one breaks off inside an expression;
    further display mathematics, pieces of mathematics and its number join it, blank lines are
    passed over, and the next text, which begins another island, closes it. Nothing but fences
    and white space is lost. Documents without display mathematics stay as they are and aren't
    shuffled; null stays null.
    """
    has = F.coalesce(F.col("markdown").rlike(DISPLAY), F.lit(False))
    doc = W.partitionBy("document_id").orderBy("at")
    island, so_far = W.partitionBy("document_id", "island"), doc.rowsBetween(W.unboundedPreceding, -1)
    rows = lines(documents.where(has)).withColumn("island", F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(doc))
    rows = rows.withColumn("opens", F.min(F.when(F.col("kind") == "display", F.col("at"))).over(island))
    inside = F.coalesce(F.col("at") >= F.col("opens"), F.lit(False))
    # the last line that stands before: an equation, or a line that isn't blank
    stands = F.when(inside, F.struct(F.lit(-1).alias("at"), F.lit("").alias("line"))).when(F.col("kind") != "blank", F.struct("at", "line"))
    rows = rows.withColumn("inside", inside).withColumn("before", F.last(stands, ignorenulls=True).over(so_far))
    back = (F.col("at") == F.col("opens")) & (F.col("before.at") >= 0) & F.col("before.line").rlike(OPEN_TAIL)
    rows = rows.withColumn("taken", F.when(back, F.col("before.at")))
    number = F.first(F.when(F.col("inside") & (F.col("kind") == "label"), F.regexp_replace(x.strip(F.col("line")), r"^[()\s]+|[()\s]+$", "")), ignorenulls=True).over(island.orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # a line is taken back only by the next opening after it
    nxt = F.first("taken", ignorenulls=True).over(doc.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("number", number).withColumn("gone", F.coalesce(nxt == F.col("at"), F.lit(False)))
    body = F.when(F.col("inside") & F.col("kind").isin("display", "piece"), F.concat_ws(" ", F.when(F.col("taken").isNotNull(), x.strip(F.col("before.line"))), F.nullif(x.strip(F.col("line")), F.lit(""))))
    joined = rows.groupBy("document_id", F.when(F.col("inside"), F.col("opens")).otherwise(F.col("at")).alias("at")).agg(
        F.max("inside").alias("inside"), F.max("gone").alias("gone"), F.max("kind").alias("kind"), F.max("line").alias("line"), F.max("number").alias("number"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", body.alias("body")))), lambda e: e["body"]), lambda e: e != ""), " ").alias("body"),
    )
    latex = x.math_glyphs(F.col("body"))
    equation = F.concat(F.lit("$$\n"), latex, F.coalesce(F.concat(F.lit(" \\quad ("), F.col("number"), F.lit(")")), F.lit("")), F.lit("\n$$"))
    # lines that follow one another are a block; an equation is one, and so is nothing
    part = F.when(F.col("inside"), F.concat(F.lit("\u0001"), equation, F.lit("\u0001"))).when(F.col("gone"), F.lit(None).cast("string")).when(F.col("kind") == "blank", F.lit("\u0001")).otherwise(F.concat(F.col("line"), F.lit("\n")))
    whole = joined.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda e: e["part"]), "").alias("all"))
    blocks = F.filter(F.transform(F.split("all", "\u0001"), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: x.strip(b) != "")
    fixed = whole.select("document_id", F.array_join(blocks, "\n\n").alias("stitched"))
    return documents.select("document_id", "markdown").where(has).join(fixed, "document_id", "left").unionByName(documents.where(~has).select("document_id", "markdown", F.col("markdown").alias("stitched")))


def inline_math(text: Column) -> Column:
    """Dollar signs for LaTeX delimiters, and LaTeX for glyphs inside mathematics only."""
    t = F.regexp_replace(text, r"(?s)\\\[\s*(.+?)\s*\\\]", "\\$\\$\n$1\n\\$\\$")
    t = F.regexp_replace(t, r"(?s)\\\(\s*(.+?)\s*\\\)", "\\$$1\\$")
    pieces = _marked(t, r"((?s:\$\$.+?\$\$)|(?<!\$)\$[^$\n]+\$(?!\$))")
    body = lambda s: F.substring(s, F.lit(2), F.length(s))
    return F.array_join(F.transform(pieces, lambda s: F.when(s.startswith("m"), x.math_glyphs(body(s))).otherwise(body(s))), "")


def _finished(rows: DataFrame) -> DataFrame:
    """COLUMNS of rows (document_id, at, part, kind, level, markdown, plain, page, refs, table) in order of at and part."""
    placed = W.partitionBy("document_id").orderBy("at", "part")
    rows = rows.withColumn("sequence_id", F.row_number().over(placed))
    rows = heading_paths(rows, "document_id", "sequence_id", "level", "plain")
    return rows.select(
        "document_id", "sequence_id", F.col("kind").alias("chunk_type"), "heading_path", "markdown", F.col("plain").alias("plain_text"), F.col("page").alias("page_start"), F.col("page").alias("page_end"),
        x.estimate_tokens(F.col("plain")).cast("int").alias("token_count"), F.filter("refs", lambda r: r != "").alias("image_refs"), F.to_json("table").alias("table_json"),
    )



def _row(kind: str, markdown: Column, plain: Column, refs: Column | None = None, table: Column | None = None, level: Column | None = None) -> Column:
    """One chunk, as an array of one."""
    return F.array(_chunk(F.lit(kind), markdown, plain, refs, table, level))


def _chunk(kind: Column, markdown: Column, plain: Column, refs: Column | None = None, table: Column | None = None, level: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        kind.alias("kind"), (F.lit(None).cast("int") if level is None else level.cast("int")).alias("level"), markdown.alias("markdown"), plain.alias("plain"),
        (none if refs is None else F.coalesce(refs, none)).alias("refs"), (F.lit(None).cast(tb.TABLE) if table is None else table).alias("table"),
    )


def chunks_of_markdown(documents: DataFrame) -> DataFrame:
    """Chunks (COLUMNS) of documents (document_id, markdown): headings, then mathematics, tables, figures, footnotes among the first blocks, and text.

    Null and empty documents have no chunks. document_id tells documents apart.
    """
    md = x.isolate_footnotes(F.col("stitched"))
    md = F.regexp_replace(md, r"(?m)^(#{1,6}\s+[^\n]*)$", "\n\n$1\n\n")
    blocks = F.filter(F.transform(F.split(md, "\n\n"), x.strip), lambda b: b != "")
    rows = stitch(documents).select("document_id", F.posexplode(blocks).alias("at", "block"))
    b = F.col("block")
    head, math, table, figure = b.rlike(r"^#{1,6}\s+.+"), b.rlike(DISPLAY), b.rlike(r"\|.*\|.*\|"), b.rlike(r"!\[.*?\]\(.*?\)")
    refs, tidy, plain = x.image_refs(b), x.normalize_markdown(b), x.plain_text(b)
    shown = x.normalize_markdown(F.array_join(F.transform(_marked(x.normalize_markdown(b), DISPLAY), lambda s: F.when(s.startswith("m"), F.concat(F.lit("$$\n"), x.math_glyphs(x.strip(F.substring(s, F.lit(2), F.length(s)))), F.lit("\n$$"))).otherwise(F.substring(s, F.lit(2), F.length(s)))), ""))
    title = x.strip(F.regexp_extract(b, r"^#{1,6}\s+(.+)", 1))
    level = F.length(F.regexp_extract(b, "^(#{1,6})", 1))
    texts = x.let(refs, lambda own: F.transform(x.paragraphs(plain), lambda p: _chunk(F.lit("text"), x.normalize_markdown(p), p, own)))
    chunk = (
        F.when(head & ~(math | table | figure), _row("heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title), title, level=level))
        .when(math, _row("math", shown, x.math_glyphs(plain), refs)).when(table, _row("table", tidy, plain, refs, tb.parse_table(b))).when(figure, _row("figure", tidy, plain, refs))
        .when((F.col("at") < EARLY_BLOCKS) & x.is_footnote(b, F.lit(1)), _row("footnote", tidy, plain, refs)).otherwise(texts)
    )
    rows = rows.select("document_id", "at", F.posexplode(chunk).alias("part", "c"))
    return _finished(rows.select("document_id", "at", "part", "c.*", F.lit(None).cast("int").alias("page")))


def flat_caption(v: Column) -> Column:
    """Text of a caption that is a string or lists of strings nested to any depth, joined by spaces; empty for null.

    v: a VARIANT. Its text form is JSON; the strings in it are its leaves.
    """
    leaves = F.regexp_extract_all(F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
    said = F.filter(F.transform(leaves, lambda s: x.strip(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0])), lambda s: s != "")
    return F.coalesce(F.array_join(said, " "), F.lit(""))


def chunks_of_blocks(documents: DataFrame) -> DataFrame:
    """Chunks (COLUMNS) of documents (document_id, blocks: the extractor's JSON array as text).

    Page furniture and empty blocks go. Null or malformed JSON has no chunks; a block of an
    unknown type is text if it has any. document_id tells documents apart.
    """
    rows = documents.select("document_id", F.posexplode(F.from_json("blocks", BLOCKS)).alias("at", "b")).select("document_id", "at", "b.*")
    c, blank = F.col, F.lit("")
    kind, text = c("type"), x.strip(F.coalesce("text", blank))
    image = F.coalesce(F.element_at(F.split("img_path", "/"), -1), blank)
    refs = F.array(image)
    joined = lambda sep, *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)
    shows = lambda caption: F.when(image != "", F.concat(F.lit("!["), caption, F.lit("]("), image, F.lit(")"))).otherwise(blank)
    equation = x.equation(text)
    numbered = lambda before, after: F.coalesce(F.concat(F.lit(before), equation["label"], F.lit(after)), blank)
    caption = F.when(kind == "chart", F.coalesce(F.nullif(flat_caption(c("chart_caption")), blank), flat_caption(c("img_caption")))).otherwise(flat_caption(c("img_caption")))
    titled, body = flat_caption(c("table_caption")), F.coalesce("table_body", blank)
    items = F.transform(F.filter(F.transform(F.coalesce("list_items", "items"), x.strip), lambda i: i != ""), lambda i: F.concat(F.lit("- "), i))
    listed = F.coalesce(F.nullif(F.array_join(items, "\n"), blank), text)
    code, named = x.strip(F.coalesce(F.nullif(c("code_body"), blank), text)), flat_caption(c("code_caption"))
    fenced = F.when(code.startswith("```"), code).otherwise(F.concat(F.lit("```\n"), code, F.lit("\n```")))
    bare = F.regexp_replace(code, r"\A```[^\n]*\n?|\n?```\s*\z", "")
    language = x.code_language(text)
    other = F.coalesce(F.nullif(text, blank), flat_caption(c("caption")))
    some = lambda said, rows: F.when(said != "", rows)
    chunk = (
        F.when(kind.isin(FURNITURE), F.lit(None))
        .when((kind == "text") & (F.coalesce("text_level", F.lit(0)) > 0), some(text, _row("heading", F.concat(F.repeat(F.lit("#"), F.least(c("text_level"), F.lit(6))), F.lit(" "), text), text, level=c("text_level"))))
        .when(kind.isin(NOTES), some(text, _row("footnote", text, text)))
        .when(kind == "equation", _row("math", F.concat(F.lit("$$\n"), equation["latex"], numbered(" \\quad (", ")"), F.lit("\n$$")), F.concat(equation["latex"], numbered(" (", ")")), refs))
        .when(kind.isin("image", "chart"), _row("figure", F.coalesce(F.nullif(joined("\n\n", shows(caption), caption), blank), F.concat(F.lit("["), kind, F.lit("]"))), caption, refs))
        .when(kind == "table", _row("table", F.coalesce(F.nullif(joined("\n\n", F.when(titled != "", F.concat(F.lit("**"), titled, F.lit("**"))).otherwise(blank), F.when(body != "", body).otherwise(shows(titled))), blank), F.lit("[table]")), x.strip(F.concat(titled, F.lit("\n"), x.plain_text(body))), refs, tb.parse_table(body)))
        .when(kind == "list", some(listed, _row("text", listed, listed)))
        .when(kind.isin("code", "algorithm"), some(code, _row("code", F.when(named != "", F.concat(F.lit("**"), named, F.lit("**\n\n"), fenced)).otherwise(fenced), F.when(named != "", F.concat(named, F.lit("\n"), bare)).otherwise(bare))))
        .when((kind == "text") & language.isNotNull(), _row("code", x.fence(text, language), text))
        .when(kind == "text", F.transform(x.paragraphs(text), lambda p: _chunk(F.lit("text"), inline_math(p), p)))
        .otherwise(some(other, _row("text", other, other)))
    )
    rows = rows.select("document_id", "at", (c("page_idx") + 1).alias("page"), F.posexplode(chunk).alias("part", "c"))
    return _finished(rows.select("document_id", "at", "part", "c.*", "page"))
