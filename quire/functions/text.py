"""Text functions of the chunker, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What marks a footnote, and phrases that footnotes on a first page hold.
FOOTNOTE_MARKS = "*∗⋆★✱✲†‡§¶¹²³⁰⁴⁵⁶⁷⁸⁹"
FOOTNOTE_PHRASES = ["equal contribution", "listing order", "corresponding author", "work performed", "work done", "now at", "internship", "current address", "permanent address", "conference on neural information", "advances in neural information"]
# Beginnings of lines of code.
CODE_STARTS = ["def ", "class ", "import ", "return", "for \\(", "while \\(", "if \\(", "else \\{", "public ", "private ", "protected ", "func ", "function ", "var ", "const ", "let ", "#include", "package ", "println", "System\\.out", "console\\.log", "print\\(", "fn ", "impl ", "struct ", "switch \\(", "case "]
# LaTeX for mathematical glyphs.
GLYPHS = {
    "×": "\\times ", "÷": "\\div ", "·": "\\cdot ", "−": "-", "≤": "\\leq ", "≥": "\\geq ", "≠": "\\neq ", "≈": "\\approx ", "≡": "\\equiv ", "∝": "\\propto ", "∈": "\\in ", "∉": "\\notin ", "⊂": "\\subset ", "⊃": "\\supset ",
    "⊆": "\\subseteq ", "⊇": "\\supseteq ", "∅": "\\emptyset ", "∪": "\\cup ", "∩": "\\cap ", "∑": "\\sum ", "∏": "\\prod ", "∫": "\\int ", "∞": "\\infty ", "∂": "\\partial ", "∇": "\\nabla ", "ℝ": "\\mathbb{R}", "ℕ": "\\mathbb{N}",
    "ℤ": "\\mathbb{Z}", "ℚ": "\\mathbb{Q}", "ℂ": "\\mathbb{C}", "→": "\\rightarrow ", "←": "\\leftarrow ", "↔": "\\leftrightarrow ", "⇒": "\\Rightarrow ", "⇐": "\\Leftarrow ",
    "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ", "ε": "\\epsilon ", "ζ": "\\zeta ", "η": "\\eta ", "θ": "\\theta ", "ι": "\\iota ", "κ": "\\kappa ", "λ": "\\lambda ", "μ": "\\mu ", "ν": "\\nu ", "ξ": "\\xi ", "π": "\\pi ", "ρ": "\\rho ", "σ": "\\sigma ", "τ": "\\tau ", "υ": "\\upsilon ", "φ": "\\phi ", "χ": "\\chi ", "ψ": "\\psi ", "ω": "\\omega ",
    "Γ": "\\Gamma ", "Δ": "\\Delta ", "Θ": "\\Theta ", "Λ": "\\Lambda ", "Ξ": "\\Xi ", "Π": "\\Pi ", "Σ": "\\Sigma ", "Φ": "\\Phi ", "Ψ": "\\Psi ", "Ω": "\\Omega ",
}
# Characters that speak for a line of mathematics.
SCORED = "αβγδεζηθικλμνξοπρςστυφχψωΑΒΓΔΕΘΛΞΠΣΦΨΩ∑∏∫√∞≈≠≤≥≪≫⋅·∂∇·×÷±∓⊕⊗⊙∅⌊⌋⌈⌉←→↔⇒⇔∈∉⊂⊆⊃⊇∪∩∀∃ℝℕℤℚℂ²³⁴⁵⁶⁷⁸⁹⁰¹⁺⁻ⁿ₀₁₂₃₄₅₆₇₈₉₊₋"

# What plain text loses of Markdown, and summaries of theirs, in this order.
PLAIN = [(r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\(.*?\)", r"\1"), (r"(?m)^#+\s+", ""), (r"[*_]{1,3}(.+?)[*_]{1,3}", r"\1"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", r"\1"), (r"\n{2,}", "\n")]
SUMMARY = [(r"#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"\n{3,}", "\n\n")]
# Where Markdown is tidied, where texts fall into paragraphs, and paragraphs into sentences.
TIDY = [(r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"(?m)[ \t\r]+$", "")]
#: What a text must hold for a pattern to change it: one of these.
NEEDED = {
    PLAIN[0][0]: ["!["], PLAIN[1][0]: ["]("], PLAIN[2][0]: ["#"], PLAIN[3][0]: ["*", "_"], PLAIN[4][0]: ["```"], PLAIN[5][0]: ["`"], PLAIN[6][0]: ["\n\n"],
    SUMMARY[0][0]: ["#"], SUMMARY[1][0]: ["**"], SUMMARY[2][0]: ["*"], TIDY[0][0]: ["\n\n\n"], TIDY[1][0]: ["  ", "\t"],
}
BLANK_LINE, SENTENCE_END = r"\n\s*\n+", r"(?<=[.!?])\s+(?=[A-Z0-9“\"'])"
LONG_PARAGRAPH, PACKED_PARAGRAPH, SCRAP = 850, 620, 3
# A closing command that numbers an equation, and a line of code's beginnings as one pattern.
TAG = r"\\(?:tag|eqno)\s*[({]([^)}]+)[)}]\s*$"
CODE_LINE = r"(?m)^\s*(?:" + "|".join(CODE_STARTS) + r"|from \S+ import )"

# What counts as white space at the ends of a text.
_SPACE = " \t\n\x0b\f\r"


def _replaced(x: Column, rules: list[tuple[str, str]]) -> Column:
    """x after these replacements, whose groups are written \\1 as in Python; a pattern is tried where one of its NEEDED pieces is there."""
    for pattern, to in rules:
        x = _replaced_once(x, pattern, to.replace("\\1", "$1"))
    return x


def _replaced_once(x: Column, pattern: str, to: str) -> Column:
    if pattern not in NEEDED:
        return F.regexp_replace(x, pattern, to)
    held = lambda v: reduce(lambda a, b: a | b, [F.contains(v, F.lit(piece)) for piece in NEEDED[pattern]])
    return let(x, lambda v: F.when(held(v), F.regexp_replace(v, pattern, to)).otherwise(v))


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE))


def normalize_markdown(x: Column) -> Column:
    """At most one blank line, single spaces, no trailing space on lines."""
    return strip(_replaced(x, TIDY))


def plain_text(x: Column) -> Column:
    """Markdown without images, link targets, heading marks, emphasis, fenced code and back-ticks."""
    return strip(_replaced(x, PLAIN))


def words(x: Column) -> Column:
    return F.regexp_count(x, F.lit("\\S+"))


def estimate_tokens(x: Column) -> Column:
    """Thirteen tenths of the words, rounded down."""
    return F.floor(words(x) * 13 / 10).cast("long")


def paragraphs(x: Column, longest: int = LONG_PARAGRAPH, pack: int = PACKED_PARAGRAPH) -> Column:
    """Paragraphs at blank lines; long ones are cut at sentences and packed greedily. Scraps of up to 3 characters go."""
    paras = F.filter(F.transform(F.split(strip(F.replace(x, F.lit("\r\n"), F.lit("\n"))), BLANK_LINE), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(s) > pack) & (acc["open"] != "")
        joined = F.when(acc["open"] == "", s).otherwise(strip(F.concat(acc["open"], F.lit(" "), s)))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    def packed(p: Column) -> Column:
        sentences = F.split(p, SENTENCE_END)
        return F.aggregate(sentences, start, add, lambda acc: F.concat(acc["done"], F.array(strip(acc["open"]))))

    pieces = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) > longest, packed(p)).otherwise(F.array(p))))
    return F.filter(pieces, lambda p: F.length(p) > SCRAP)


def reveal_paragraphs(x: Column, longest: int = 600) -> Column:
    """Paragraphs at blank lines; a single one of more than longest characters is cut before lines that open with a capital, digit, quote or bracket."""
    s = strip(F.replace(x, F.lit("\r\n"), F.lit("\n")))
    cut = lambda pattern: F.filter(F.transform(F.split(s, pattern), strip), lambda p: p != "")
    blocks = cut("\n\\s*\n+")
    found = F.when((F.size(blocks) == 1) & (F.length(s) > longest), cut("\n(?=[A-Z0-9\"'“‘(])")).otherwise(blocks)
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(F.array(s))


def isolate_footnotes(x: Column) -> Column:
    """A blank line before lines that open with a footnote sign, in the first 3,500 characters."""
    head = F.regexp_replace(F.substring(x, 1, 3500), "\n(?=[∗⋆★✱✲†‡§¶])", "\n\n")
    return F.concat(head, F.substring(x, F.lit(3501), F.length(x)))


def _any_of(x: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(x, p))


def is_footnote(x: Column, page: Column) -> Column:
    """On the first two pages: a line that opens with a mark (a star needs a phrase too), or a short text with a phrase."""
    s = strip(x)
    first = F.substring_index(s, "\n", 1)
    phrase = _any_of(F.lower(s), FOOTNOTE_PHRASES)
    marked = first.rlike(f"^[{FOOTNOTE_MARKS}]+\\s*\\S")
    star = first.startswith("*") & ~first.startswith("**")
    return (F.coalesce(page, F.lit(1)) <= 2) & (F.length(s) > 0) & F.when(marked, F.when(star, phrase).otherwise(True)).otherwise((F.length(s) < 200) & phrase)


def math_glyphs(x: Column) -> Column:
    """LaTeX commands for mathematical glyphs; roots first, then runs of spaces become one."""
    x = F.regexp_replace(x, "√\\s*\\{([^}]+)\\}", "\\\\sqrt{$1}")
    x = F.regexp_replace(x, "√\\s*([A-Za-z][A-Za-z0-9_]*)", "\\\\sqrt{$1}")
    x = F.replace(x, F.lit("√"), F.lit("\\sqrt{}"))
    for glyph, latex in GLYPHS.items():
        x = F.replace(x, F.lit(glyph), F.lit(latex))
    return F.regexp_replace(x, " {2,}", " ")


def is_json(x: Column) -> Column:
    s = strip(x)
    braced = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    parses = F.try_parse_json(s).isNotNull()
    return (F.length(s) >= 12) & braced & (parses | ((F.regexp_count(s, F.lit('"')) >= 4) & s.contains(":")))


def is_code(x: Column) -> Column:
    """Two lines or more: two starts of code lines, or half of them indented with braces or one such start."""
    lines = F.split(x, "\n")
    full = F.filter(lines, lambda s: strip(s) != "")
    indented = F.size(F.filter(full, lambda s: s.rlike("^[ \t]") & ~F.ltrim(s).rlike("^[-*•] ")))
    starts = F.regexp_count(x, F.lit(CODE_LINE))
    braces = F.regexp_count(x, F.lit("[{};]"))
    return (F.size(lines) >= 2) & (F.size(full) > 0) & ((starts >= 2) | ((indented * 2 >= F.size(full)) & ((braces >= 2) | (starts >= 1))))


def code_language(x: Column) -> Column:
    return F.when(x.contains("```"), "code").when(is_json(x), "json").when(is_code(x), "code")


def fence(x: Column, language: Column) -> Column:
    fenced = F.concat(F.lit("```"), F.when(language == "json", "json").otherwise(""), F.lit("\n"), x, F.lit("\n```"))
    return F.when(F.ltrim(x).startswith("```"), x).otherwise(fenced)


def equation(x: Column) -> Column:
    """Struct of latex and label: fences peeled, a number after the fence or in a closing tag command taken off."""
    s = strip(x)
    fenced = s.rlike("(?s)^\\$\\$.*?\\$\\$")
    body = F.when(fenced, strip(F.regexp_extract(s, "(?s)^\\$\\$(.*?)\\$\\$", 1))).otherwise(s)
    after = F.when(fenced, strip(F.regexp_replace(s, "(?s)^\\$\\$.*?\\$\\$", ""))).otherwise("")
    label = F.coalesce(F.nullif(strip(F.regexp_extract(body, TAG, 1)), F.lit("")), F.nullif(F.replace(after, F.lit("$"), F.lit("")), F.lit("")))
    return F.struct(F.regexp_replace(F.regexp_replace(body, TAG, ""), "\\s+$", "").alias("latex"), label.alias("label"))


def equation_markdown(x: Column) -> Column:
    e = equation(x)
    return F.concat(F.lit("$$\n"), e["latex"], F.coalesce(F.concat(F.lit(" \\quad ("), e["label"], F.lit(")")), F.lit("")), F.lit("\n$$"))


def pipe_table(x: Column) -> Column:
    """Rows of cells of a table in pipes, separators and empty cells left out; null for fewer than three pipes or two lines."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s.contains("|"))
    data = F.filter(lines, lambda s: ~s.rlike("^\\|[\\s:|-]+\\|$"))
    cells = F.transform(data, lambda s: F.filter(F.transform(F.split(s, "\\|"), strip), lambda v: v != ""))
    return F.when((F.regexp_count(x, F.lit("\\|")) > 2) & (F.size(lines) >= 2), cells)


def image_refs(x: Column) -> Column:
    """File names of the images a text shows."""
    refs = F.regexp_extract_all(x, F.lit("!\\[[^\\]]*\\]\\(([^)]+)\\)"), 1)
    return F.transform(refs, lambda p: F.element_at(F.split(strip(p), "/"), -1))


def math_score(x: Column, glyphs: str = SCORED) -> Column:
    # a class of many glyphs is tried one by one: characters of ASCII are told from them before
    pattern = f"(?![\\x00-\\x7F])[{glyphs}]" if min(glyphs) > "\x7f" else f"[{glyphs}]"
    n = F.length(strip(x))
    hits = F.regexp_count(x, F.lit(pattern)) + F.regexp_count(x, F.lit("[=≈]")) * F.lit(0.3)
    return F.when(n < 3, F.lit(0.0)).otherwise(hits / n)


def heading_level(size: Column, body: Column, length: Column, bold: Column) -> Column:
    """Level of a line by its font size against the body's: 1 from 1.6 times, 2 from 1.3, 3 above 1.15; long lines must be bold."""
    ratio = size / body
    return F.when((size > body * 1.15) & ((length <= 120) | bold), F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).otherwise(3))


def section_id(path: Column, level: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(path, " ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.size(path) == 0, F.concat(F.lit("level"), level.cast("string"), F.lit("-root"))).otherwise(F.concat(F.lit("h"), level.cast("string"), F.lit("-"), F.substring(slug, 1, 60)))


def summary_plain(x: Column) -> Column:
    return strip(_replaced(x, SUMMARY))


def short_hash(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def block_type(kind: Column) -> Column:
    """A reported block type under its usual name; page furniture stays as it is."""
    names = {"figure": "image", "picture": "image", "formula": "equation", "math": "equation", "paragraph": "text", "body": "text", "plain_text": "text", "caption": "text", "title": "text", "heading": "text", "section": "text", "section_header": "text", "subtitle": "text"}
    k = F.lower(F.trim(kind))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), k), k)


def alias_level(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k == "title", 1).when(k.isin("heading", "section", "section_header", "subtitle"), 2)


def unwrap_fence(x: Column) -> Column:
    s = strip(x)
    inner = F.regexp_replace(F.regexp_replace(s, "^[^\n]*\n?", ""), "(?s)```(?!.*```).*$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def math_segments(x: Column) -> Column:
    """Text and display mathematics in turn: array of (kind, content), empty ones left out."""
    cut = F.split(F.regexp_replace(x, "(?s)\\$\\$(.+?)\\$\\$", "\u0001m$1\u0001t"), "\u0001")
    marked = F.transform(cut, lambda s, i: F.struct(F.when((i > 0) & s.startswith("m"), "math").otherwise("text").alias("kind"), strip(F.when(i > 0, F.substring(s, F.lit(2), F.length(s))).otherwise(s)).alias("content")))
    return F.filter(marked, lambda p: p["content"] != "")


def image_mime(b64: Column) -> Column:
    return F.when(b64.startswith("iVBOR"), "image/png").when(b64.startswith("/9j/"), "image/jpeg").when(b64.startswith("R0lGOD"), "image/gif").when(b64.startswith("UklGR"), "image/webp").otherwise("image/png")


def preview(x: Column, n: int, empty: str) -> Column:
    """One line of the first n characters, or a stand-in."""
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(x, "\\s+", " ")), 1, n), F.lit("")), F.lit(empty))


def open_math(x: Column) -> Column:
    """An odd number of dollar signs: mathematics that is not closed yet."""
    return F.regexp_count(x, F.lit("\\$")) % 2 == 1


def locate_quote(x: Column, quote: Column) -> Column:
    """Struct of start and end (code points, from 0, end out) of the first place of a quote in a text, white space standing for any other; null if it is not there, or blank."""
    words = F.filter(F.split(quote, "(?U)\\s+"), lambda w: w != "")
    literal = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    found = F.when(F.size(words) > 0, F.regexp_substr(x, F.concat(F.lit("(?U)"), F.array_join(literal, "\\s+"))))
    start = (F.instr(x, found) - 1).cast("int")
    return F.when(found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


#: Where stored images are served.
SERVED = "/static/images/"


def image_url(path: Column) -> Column:
    """The URL that serves a stored image."""
    return F.concat(F.lit(SERVED), path)


def stored_path(url: Column) -> Column:
    """The stored path of a served image's URL; other URLs as they are."""
    return F.when(url.startswith(SERVED), F.substring(url, F.lit(len(SERVED) + 1), F.length(url))).otherwise(url)
