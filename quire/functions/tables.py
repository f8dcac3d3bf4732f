"""Tables in HTML and in pipes to headers and rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, pipe_table, strip

#: Columns or rows that one cell spans at most.
SPAN_LIMIT = 64
# Character references that are put back.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
TABLE = "struct<headers:array<string>,rows:array<array<string>>,num_rows:int,num_cols:int>"
_SLOT = "struct<text:string,left:int>"


def _plain(html: Column) -> Column:
    """Text of a cell: pieces between tags, each stripped, joined by a space."""
    pieces = F.filter(F.transform(F.split(html, "(?s)<[^>]*>"), strip), lambda p: p != "")
    out = F.array_join(pieces, " ")
    for reference, character in REFERENCES.items():
        out = F.replace(out, F.lit(reference), F.lit(character))
    return out


def _span(attributes: Column, name: str) -> Column:
    n = F.regexp_extract(attributes, rf"(?i)(?:^|\s){name}\s*=\s*[\"']?\s*\+?(\d+)\s*[\"'\s/]?", 1)
    return F.when(n == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(SPAN_LIMIT), F.coalesce(n.try_cast("int"), F.lit(SPAN_LIMIT)))))


def _cells(row: Column) -> Column:
    """The cells of a row's HTML: text, across, down, head."""
    pattern = r"(?is)<(t[dh])\b([^>]*)>(.*?)</t[dh]\s*>"
    kind, attributes, inner = [F.regexp_extract_all(row, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    at = lambda a, i: F.get(a, i)
    return F.transform(kind, lambda k, i: F.struct(_plain(at(inner, i)).alias("text"), _span(at(attributes, i), "colspan").alias("across"), _span(at(attributes, i), "rowspan").alias("down"), (F.lower(k) == "th").alias("head")))


def _place(row: Column, cell: Column) -> Column:
    """row (x, slots) with one more cell: at the first free column from x on, over as many as it spans; taken ones stay."""
    slots, size = row["slots"], F.size(row["slots"])
    free = F.filter(F.sequence(row["x"], F.greatest(size, row["x"])), lambda i: F.get(slots, i).isNull())
    x = F.get(free, F.lit(0))
    end = F.greatest(size, x + cell["across"])
    own = F.struct(cell["text"].alias("text"), cell["down"].alias("left"))
    filled = F.transform(F.sequence(F.lit(0), end - 1), lambda i: F.coalesce(F.get(slots, i), F.when((i >= x) & (i < x + cell["across"]), own)))
    return F.struct((x + cell["across"]).alias("x"), filled.cast(f"array<{_SLOT}>").alias("slots"))


def _add_row(grid: Column, cells: Column) -> Column:
    """grid (carried, rows) with one more row laid out: carried are the slots that cells above still fill."""
    placed = F.aggregate(cells, F.struct(F.lit(0).alias("x"), grid["carried"].alias("slots")), _place)["slots"]

    def close(slots: Column) -> Column:
        gap = F.array_position(F.transform(slots, lambda s: s.isNull()), True).cast("int")
        width = F.when(gap > 0, gap - 1).otherwise(F.size(slots))
        texts = F.transform(F.slice(slots, F.lit(1), width), lambda s: s["text"])
        carried = F.transform(slots, lambda s: F.when(s["left"] > 1, F.struct(s["text"].alias("text"), (s["left"] - 1).alias("left"))))
        return F.struct(carried.cast(f"array<{_SLOT}>").alias("carried"), F.concat(grid["rows"], F.array(F.struct(texts.alias("cells"), F.exists(cells, lambda c: c["head"]).alias("head")))).alias("rows"))

    return let(placed, close)


def html_table(x: Column) -> Column:
    """TABLE of the tables of an HTML text, null if they have no cells; spans laid out, header rows merged column by column.

    Where a cell would span a column that one above still fills, that column isn't its own in any row.
    """
    rows = F.transform(F.filter(F.split(x, r"(?i)<tr\b"), lambda r: r.rlike(r"(?i)<t[dh]\b")), _cells)
    start = F.struct(F.array().cast(f"array<{_SLOT}>").alias("carried"), F.array().cast("array<struct<cells:array<string>,head:boolean>>").alias("rows"))
    laid = F.aggregate(F.filter(rows, lambda r: F.size(r) > 0), start, _add_row)["rows"]

    def merged(rows: Column) -> Column:
        heads = F.transform(F.filter(rows, lambda r: r["head"]), lambda r: r["cells"])
        body = F.transform(F.filter(rows, lambda r: ~r["head"]), lambda r: r["cells"])
        width = F.array_max(F.transform(heads, F.size))
        column = lambda i: F.array_join(F.array_distinct(F.filter(F.transform(heads, lambda h: F.get(h, i)), lambda t: t != "")), " ")
        headers = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array().cast("array<string>"))
        columns = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.size(F.get(body, F.lit(0))))
        return F.when(F.size(rows) > 0, F.struct(headers.alias("headers"), body.alias("rows"), F.size(body).alias("num_rows"), columns.alias("num_cols")).cast(TABLE))

    return let(laid, merged)


def piped_table(x: Column) -> Column:
    """TABLE of a text in pipes, its first row the header; null for less than a header and a row."""
    cells = pipe_table(x)
    rows = F.filter(F.slice(cells, 2, 1 << 30), lambda r: F.size(r) > 0)
    head = F.get(cells, F.lit(0))
    return F.when(F.size(rows) > 0, F.struct(head.alias("headers"), rows.alias("rows"), F.size(rows).alias("num_rows"), F.size(head).alias("num_cols")).cast(TABLE))


def parse_table(x: Column) -> Column:
    """TABLE of HTML if there is any, else of pipes; null for null."""
    return F.coalesce(F.when(F.contains(F.lower(x), F.lit("<table")), html_table(x)), piped_table(x))
