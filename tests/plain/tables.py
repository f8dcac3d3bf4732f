"""HTML and pipe tables to headers and rows, plainly: what quire.functions.tables is compared with."""

from __future__ import annotations

import re
from html.parser import HTMLParser

SPAN_LIMIT = 64


class _Cells(HTMLParser):
    """Collects rows of (text, colspan, rowspan, is_header)."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int, bool]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            found = dict(attrs)

            def span(name: str) -> int:
                raw = str(found.get(name) or "1").strip()
                return min(SPAN_LIMIT, max(1, int(raw))) if re.fullmatch(r"[+-]?\d+", raw) else 1

            self.cell = [[], span("colspan"), span("rowspan"), tag == "th"]

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cell[0].append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell:
            words, across, down, head = self.cell
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join(words).strip(), across, down, head))
            self.cell = None


def _laid_out(rows: list[list[tuple[str, int, int, bool]]]) -> list[tuple[list[str], bool]]:
    """Each row's texts by column; a cell fills the columns and rows it spans."""
    grid: dict[tuple[int, int], str] = {}
    out = []
    for y, row in enumerate(rows):
        x = 0
        for text, across, down, _ in row:
            while (y, x) in grid:
                x += 1
            for dy in range(down):
                for dx in range(across):
                    grid.setdefault((y + dy, x + dx), text)
            x += across
        width = 0
        while (y, width) in grid:
            width += 1
        out.append(([grid[y, i] for i in range(width)], any(c[3] for c in row)))
    return out


def html_table(source: str) -> dict | None:
    """headers, rows, num_rows, num_cols of a table; header rows are merged column by column. None if it has neither."""
    parser = _Cells()
    parser.feed(source)
    laid = _laid_out([r for r in parser.rows if r])
    heads, rows = [r for r, head in laid if head], [r for r, head in laid if not head]
    width = max(map(len, heads), default=0)
    headers = [" ".join(dict.fromkeys(r[i] for r in heads if i < len(r) and r[i])) for i in range(width)]
    if not headers and not rows:
        return None
    return {"headers": headers, "rows": rows, "num_rows": len(rows), "num_cols": len(headers) or len(rows[0])}


def pipe_table(source: str) -> dict | None:
    """The same of a table in pipes; its first row is the header. None for less than a header and a row."""
    lines = [x.strip() for x in source.splitlines() if "|" in x]
    if source.count("|") < 3 or len(lines) < 2:
        return None
    cells = [[c for c in map(str.strip, x.split("|")) if c] for x in lines if not re.fullmatch(r"\|[\s:|-]+\|", x)]
    rows = [r for r in cells[1:] if r]
    if not rows:
        return None
    return {"headers": cells[0], "rows": rows, "num_rows": len(rows), "num_cols": len(cells[0])}


def parse_table(source: str | None) -> dict | None:
    source = (source or "").strip()
    found = html_table(source) if "<table" in source.lower() else None
    return found or pipe_table(source)
