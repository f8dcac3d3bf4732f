"""Text functions, routing and retrieval on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as g, text as x
from ..functions.stems import sql_stems
from ..operators import ann, fulltext, retrieval as r
from ..scratch import drop_folder, new_folder, state_of
from .registry import also, query

c = F.col
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)[ \t\r]+$', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("X1_normalize_markdown", f"SELECT doc_id, {NORMAL} AS md FROM documents")
def _(t):
    return t("documents").select("doc_id", x.normalize_markdown(c("text")).alias("md"))


PLAIN = "text"
for _p, _to in [(r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\(.*?\)", r"\1"), (r"(?m)^#+\s+", ""), (r"[*_]{1,3}(.+?)[*_]{1,3}", r"\1"), (r"(?s)```.*?```", ""), ("`([^`]+)`", r"\1"), (r"\n{2,}", "\n"), (r"^\s+|\s+$", "")]:
    PLAIN = f"regexp_replace({PLAIN}, '{_p}', '{_to}', 'g')"


@query("X2_plain_text", f"SELECT doc_id, {PLAIN} AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", x.plain_text(c("text")).alias("plain"))


@query("X3_tokens", r"SELECT doc_id, floor(len(regexp_extract_all(text, '\S+')) * 13 / 10)::BIGINT AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", x.estimate_tokens(c("text")).alias("tokens"))


# Packing is a fold over sentences: chr(1) parts the paragraphs packed so far, chr(2) the sentences.
PARAGRAPHS = rf"""WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g'), '{x.BLANK_LINE}'), lambda q : regexp_replace(q, '^\s+|\s+$', '', 'g')), lambda q : q <> '') AS a FROM documents),
p AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS p FROM a),
s AS (SELECT doc_id, i, CASE WHEN length(p) <= {x.LONG_PARAGRAPH} THEN [p] ELSE string_split(list_reduce(string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9“"''])', '\1' || chr(2) || '\2', 'g'), chr(2)),
  lambda done, s : done || CASE WHEN length(split_part(done, chr(1), -1)) + length(s) > {x.PACKED_PARAGRAPH} THEN chr(1) ELSE ' ' END || s), chr(1)) END AS q FROM p),
o AS (SELECT doc_id, i, generate_subscripts(q, 1) AS j, unnest(q) AS paragraph FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INTEGER AS position, paragraph FROM o WHERE length(paragraph) > {x.SCRAP}"""


@query("X4_paragraphs", PARAGRAPHS)
def _(t):
    return t("documents").select("doc_id", F.posexplode(x.paragraphs(c("text"))).alias("position", "paragraph"))


@query("X7_isolate_footnotes", "SELECT doc_id, regexp_replace(substring(text, 1, 3500), '\\n([∗⋆★✱✲†‡§¶])', chr(10) || chr(10) || '\\1', 'g') || substring(text, 3501) AS md FROM documents")
def _(t):
    return t("documents").select("doc_id", x.isolate_footnotes(c("text")).alias("md"))


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
PHRASE = " OR ".join(f"contains(lower(text), '{p}')" for p in x.FOOTNOTE_PHRASES)


@query(
    "X8_footnotes",
    rf"""SELECT doc_id, length(s) > 0 AND CASE WHEN regexp_matches(l, '^[{x.FOOTNOTE_MARKS}]+\s*\S') THEN phrase OR NOT (starts_with(l, '*') AND NOT starts_with(l, '**')) ELSE length(s) < 200 AND phrase END AS footnote
FROM (SELECT doc_id, {STRIPPED} AS s, split_part({STRIPPED}, chr(10), 1) AS l, ({PHRASE}) AS phrase FROM documents)""",
)
def _(t):
    return t("documents").select("doc_id", x.is_footnote(c("text"), F.lit(1)).alias("footnote"))


LATEX = r"replace(regexp_replace(regexp_replace(text, '√\s*\{([^}]+)\}', '\\sqrt{\1}', 'g'), '√\s*([A-Za-z][A-Za-z0-9_]*)', '\\sqrt{\1}', 'g'), '√', '\sqrt{}')"
for _glyph, _latex in x.GLYPHS.items():
    LATEX = f"replace({LATEX}, '{_glyph}', '{_latex}')"


@query("X10_math_glyphs", f"SELECT doc_id, regexp_replace({LATEX}, ' {{2,}}', ' ', 'g') AS latex FROM documents")
def _(t):
    return t("documents").select("doc_id", x.math_glyphs(c("text")).alias("latex"))


JSON = r"""(length(props) >= 12 AND regexp_matches(props, '(?s)^\s*(\{.*\}|\[.*\])\s*$') AND (json_valid(props) OR (len(regexp_extract_all(props, '"')) >= 4 AND contains(props, ':'))))"""


@query("X12_json", f"SELECT event_id, {JSON} AS is_json FROM events")
def _(t):
    return t("events").select("event_id", x.is_json(c("props")).alias("is_json"))


@query(
    "X13_code",
    r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents),
f AS (SELECT doc_id, text, s, list_filter(s, lambda v : regexp_replace(v, '^\s+|\s+$', '', 'g') <> '') AS f FROM l),
k AS (SELECT doc_id, len(s) AS n, len(f) AS m, len(list_filter(f, lambda v : regexp_matches(v, '^[ \t]') AND NOT regexp_matches(v, '^\s*[-*•] '))) AS i,
len(regexp_extract_all(text, '(?m)^\s*(?:def |class |import |return|for \(|while \(|if \(|else \{|public |private |protected |func |function |var |const |let |#include|package |println|System\.out|console\.log|print\(|fn |impl |struct |switch \(|case |from \S+ import )')) AS w, len(regexp_extract_all(text, '[{};]')) AS b FROM f)
SELECT doc_id, n >= 2 AND m > 0 AND (w >= 2 OR (i * 2 >= m AND (b >= 2 OR w >= 1))) AS is_code FROM k""",
)
def _(t):
    return t("documents").select("doc_id", x.is_code(c("text")).alias("is_code"))


@query("X14_fence", f"SELECT event_id, CASE WHEN starts_with(ltrim(props), '```') THEN props ELSE '```' || CASE WHEN {JSON} THEN 'json' ELSE '' END || chr(10) || props || chr(10) || '```' END AS md FROM events")
def _(t):
    return t("events").select("event_id", x.fence(c("props"), x.code_language(c("props"))).alias("md"))


@query("X15_equations", "SELECT p_partkey, '$$' || chr(10) || p_name || ' \\quad (' || p_size || ')' || chr(10) || '$$' AS md FROM part")
def _(t):
    raw = F.when(c("p_size") % 2 == 0, F.concat(F.lit("$$"), "p_name", F.lit("\\tag{"), c("p_size").cast("string"), F.lit("}$$"))).otherwise(F.concat(F.lit("$$"), "p_name", F.lit("$$ "), c("p_size").cast("string")))
    return t("part").select("p_partkey", x.equation_markdown(raw).alias("md"))


@query("X17_pipe_table", "SELECT p_partkey, [[p_name, p_brand], [p_type, p_size::VARCHAR]] AS cells FROM part")
def _(t):
    md = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n|---|---|\n| "), "p_type", F.lit(" | | "), c("p_size").cast("string"), F.lit(" |"))
    return t("part").select("p_partkey", x.pipe_table(md).alias("cells"))


@query("X18_image_refs", "SELECT p_partkey, [p_brand || '.png', 'x.jpg'] AS refs FROM part")
def _(t):
    md = F.concat(F.lit("see ![a](img/"), "p_brand", F.lit(".png) and ![](x.jpg)"))
    return t("part").select("p_partkey", x.image_refs(md).alias("refs"))


@query("X22_math_score", f"SELECT doc_id, CASE WHEN length(t) < 3 THEN 0 ELSE round((len(regexp_extract_all(t, '[{x.SCORED}]')) + 0.3 * len(regexp_extract_all(t, '[=≈]')))::DOUBLE / length(t), 9) END AS score FROM (SELECT doc_id, {STRIPPED} AS t FROM documents)")
def _(t):
    return t("documents").select("doc_id", F.round(x.math_score(c("text")), 9).alias("score"))


for _name in ("X8_footnotes", "X10_math_glyphs", "X22_math_score"):
    also(f"{_name}_whole", _name)


@query(
    "X23_two_columns",
    "SELECT l_suppkey, count(*) >= 12 AND least(count(*) FILTER (l_quantity < 23), count(*) FILTER (l_quantity >= 27)) >= greatest(4, count(*) * 0.2) AND count(*) FILTER (l_quantity < 25 AND l_partkey % 10 = 0) / count(*) < 0.25 AS two_columns FROM lineitem GROUP BY l_suppkey",
)
def _(t):
    n = lambda p: F.count(F.when(p, 1))
    q = c("l_quantity")
    two = (F.count("*") >= 12) & (F.least(n(q < 23), n(q >= 27)) >= F.greatest(F.lit(4.0), F.count("*") * F.lit(0.2))) & (n((q < 25) & (c("l_partkey") % 10 == 0)) / F.count("*") < 0.25)
    return t("lineitem").groupBy("l_suppkey").agg(two.alias("two_columns"))


@query("X25_heading_level", "SELECT p_partkey, CASE WHEN p_size > 11.5 AND p_partkey % 200 <= 120 THEN CASE WHEN p_size >= 16 THEN 1 WHEN p_size >= 13 THEN 2 ELSE 3 END END AS level FROM part")
def _(t):
    return t("part").select("p_partkey", x.heading_level(c("p_size").cast("double"), F.lit(10.0), c("p_partkey") % 200, F.lit(False)).alias("level"))


@query("X27_block_types", "SELECT event_id, CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'text' ELSE event_type END AS kind FROM events")
def _(t):
    k = F.when(c("event_type") == "view", " Figure").when(c("event_type") == "click", "TITLE").otherwise(c("event_type"))
    return t("events").select("event_id", x.block_type(k).alias("kind"))


@query("X28_section_id", "SELECT page_id, 'h2-' || substring(regexp_replace(regexp_replace(lower(url || ' ' || 'Part'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS section_id FROM pages")
def _(t):
    return t("pages").select("page_id", x.section_id(F.array(c("url"), F.lit("Part")), F.lit(2)).alias("section_id"))


@query("X29_summary_plain", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#{1,6}\s+', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", x.summary_plain(c("text")).alias("plain"))


@query("X30_short_hash", "SELECT page_id, substring(sha256(url), 1, 16) AS h FROM pages")
def _(t):
    return t("pages").select("page_id", x.short_hash(c("url")).alias("h"))


def _case(words):
    return " ".join(f"WHEN contains(q, '{w.replace(chr(39), chr(39) * 2)}') THEN '{w.replace(chr(39), chr(39) * 2)}'" for w in words)


ROUTE = f"""SELECT conv_id, turn, CASE WHEN has_chunk AND l IS NOT NULL THEN 'LOCAL' WHEN o IS NOT NULL THEN 'OVERVIEW' WHEN e IS NOT NULL THEN 'EXTERNAL' WHEN NOT has_chunk AND turn % 3 = 0 THEN 'EXTERNAL' WHEN turn % 3 <> 0 THEN 'GLOBAL' ELSE 'EXTERNAL' END AS context_type,
coalesce(CASE WHEN has_chunk THEN l END, o, e) AS matched FROM (SELECT *, CASE {_case(g.LOCAL)} END AS l, CASE {_case(g.OVERVIEW)} END AS o, CASE {_case(g.EXTERNAL)} END AS e FROM (SELECT conv_id, turn, turn % 2 = 0 AS has_chunk, lower(trim(text)) AS q FROM conversations))"""


@query("X31_route", ROUTE)
def _(t):
    d = g.route(c("text"), c("turn") % 2 == 0, c("turn") % 3 != 0)
    return t("conversations").select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.context_type", "d.matched")


@query("X32_route_reply", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'OVERVIEW' WHEN event_id % 3 = 1 THEN 'LOCAL' ELSE 'GLOBAL' END AS context_type FROM events")
def _(t):
    reply = F.when(c("event_id") % 3 == 0, 'so: {"context_type": "overview", "reason": "r"}').when(c("event_id") % 3 == 1, "local, I think").otherwise("no idea")
    return t("events").select("event_id", g.route_of_reply(reply).alias("context_type"))


def _has(words, q):
    return " OR ".join(f"contains({q}, '{w}')" for w in words)


@query("X33_intents", f"SELECT doc_id, ({_has(g.OTHER_FIELDS, 'lower(text)')}) AS other_field, ({_has(g.FIGURE_WORDS, 'lower(text)')}) AS figure, ({_has(g.IMAGE_WORDS, 'lower(text)')}) AS image, ({_has(g.TECH_WORDS, chr(39) + ' ' + chr(39) + ' || lower(text) || ' + chr(39) + ' ' + chr(39))}) AS tech FROM documents")
def _(t):
    q, low = c("q"), t("documents").select("doc_id", F.lower("text").alias("q"), F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("padded"))
    return low.select("doc_id", g.has_any(q, g.OTHER_FIELDS).alias("other_field"), g.has_any(q, g.FIGURE_WORDS).alias("figure"), g.has_any(q, g.IMAGE_WORDS).alias("image"), g.has_any(c("padded"), g.TECH_WORDS).alias("tech"))


@query("X34_rewrite_query", "SELECT p_partkey, p_name || ' (in the context of the research paper \"' || p_brand || '\", machine learning / computer science)' AS q FROM part")
def _(t):
    return t("part").select("p_partkey", g.rewrite_query(c("p_name"), F.concat("p_brand", F.lit(".pdf"))).alias("q"))


@query("X35_tool_calls", "SELECT p_partkey, [p_name] AS searches, [[p_size, p_size + 5]] AS reads FROM part")
def _(t):
    reply = F.concat(F.lit("SEARCH: outside\n<tool>\nSEARCH: "), "p_name", F.lit("\nREAD: "), c("p_size").cast("string"), F.lit("-"), (c("p_size") + 5).cast("string"), F.lit("\n</tool>"))
    return t("part").select("p_partkey", g.tool_calls(reply).alias("x")).select("p_partkey", "x.searches", "x.reads")


@query("X36_citations", "SELECT p_partkey, list_sort(list_distinct([p_size, 3])) AS n, CASE WHEN p_size = 3 THEN [3] ELSE [p_size, 3] END AS cited FROM part")
def _(t):
    a = F.concat(F.lit("as in [["), c("p_size").cast("string"), F.lit("], [3]] and [[3, "), c("p_size").cast("string"), F.lit("]]"))
    cites = g.cited(a)
    return t("part").select("p_partkey", F.array_sort(cites).alias("n"), cites.alias("cited"))




@query("X39_used_citations", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM pages")
def _(t):
    cites = F.array(F.struct(F.lit(1).alias("sequence_id"), F.lit(None).cast("string").alias("url")), F.struct(F.lit(None).cast("int").alias("sequence_id"), c("url").alias("url")))
    answer = F.when(c("page_id") % 2 == 0, F.concat(F.lit("see "), "url")).otherwise("none")
    return t("pages").select("page_id", F.size(g.used_citations(cites, answer)).alias("n"))


@query("X40_rewrite_images", "SELECT page_id, '![a](/static/' || page_id || '.png) and /static/' || page_id || '.png' AS answer FROM pages")
def _(t):
    local = F.concat(F.lit("/static/"), c("page_id").cast("string"), F.lit(".png"))
    answer = F.concat(F.lit("![a]("), "url", F.lit(") and "), "url")
    return t("pages").select("page_id", g.rewrite_images(answer, F.array(F.struct(c("url").alias("remote"), local.alias("local")))).alias("answer"))


@query("X41_image_mime", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/gif' ELSE 'image/png' END AS mime FROM pages")
def _(t):
    return t("pages").select("page_id", x.image_mime(F.when(c("page_id") % 3 == 0, "/9j/4AA").when(c("page_id") % 3 == 1, "R0lGODlh").otherwise("AAAA")).alias("mime"))


@query("X43_preview", r"SELECT doc_id, substring(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 80) AS preview, len(regexp_extract_all(text, '\$')) % 2 = 1 AS open_math FROM documents")
def _(t):
    return t("documents").select("doc_id", x.preview(c("text"), 80, "").alias("preview"), x.open_math(c("text")).alias("open_math"))


@query("X44_friendly_error", "SELECT event_id, CASE event_type WHEN 'error' THEN 'schema' WHEN 'view' THEN 'fragments' ELSE 'failed' END AS kind FROM events")
def _(t):
    m = F.when(c("event_type") == "error", "column X does not exist").when(c("event_type") == "view", "Too many things").otherwise("boom")
    return t("events").select("event_id", g.friendly_error(m).alias("kind"))


@query("X50_math_segments", "SELECT p_partkey, ['text', 'math', 'text'] AS kinds, [p_name, p_brand, 'end'] AS contents FROM part")
def _(t):
    s = x.math_segments(F.concat("p_name", F.lit(" $$ "), "p_brand", F.lit(" $$ end")))
    return t("part").select("p_partkey", F.transform(s, lambda e: e["kind"]).alias("kinds"), F.transform(s, lambda e: e["content"]).alias("contents"))


@query("X51_chat_title", r"SELECT conv_id, turn, coalesce(nullif(substring(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 48), ''), 'Untitled chat') AS title FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", x.preview(c("text"), 48, "Untitled chat").alias("title"))


# --- retrieval


@query("R2_ann_topk")
def _(t):
    """About the ten nearest by codes and exact rescoring, for every vector whose id is divisible by 50."""
    v = t("embeddings").select(c("vec_id").alias("id"), "embedding")
    return ann.search(ann.build(v), v.where("id % 50 = 0"), 10)


def _vectors(t):
    return t("embeddings").select(c("vec_id").alias("id"), "embedding", "label")


def _with_query(t, k):
    """The k nearest of vector 0: its row is joined on, one row, so nothing leaves the plan."""
    v = _vectors(t)
    q = v.where("id = 0").select(c("embedding").alias("q"))
    scored = v.crossJoin(F.broadcast(q)).withColumn("similarity", F.round(r.cosine(c("embedding"), c("q")), 6)).where("similarity is not null")
    return scored.orderBy(c("similarity").desc(), "id").limit(k).select("id", "similarity", "label")


COSINE = "SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, id LIMIT {}"


@query("R1_cosine_topk", COSINE.format(10))
def _(t):
    return _with_query(t, 10)


@query("T2_vector_limit", COSINE.format(5))
def _(t):
    return _with_query(t, 5)


@query(
    "R3_shape_vector",
    "SELECT vec_id, list_transform(list_transform(embedding[1:16], lambda v : v::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda w : w::DOUBLE * w)))), lambda v : round(v, 9)) AS short, len(embedding) + 16 AS long_size FROM embeddings",
)
def _(t):
    e = t("embeddings")
    return e.select("vec_id", F.transform(r.shape_vector(c("embedding"), 16), lambda v: F.round(v, 9)).alias("short"), F.size(r.shape_vector(c("embedding"), 80)).cast("long").alias("long_size"))


#: Paths of stored indexes by session, tables and the state of their files; an index is written once and read by stem.
_stored: dict[tuple[str, str, str], str] = {}


def text_index(t) -> str:
    """Path of the index of these documents, written at its first use in a session, and again if they have changed."""
    at = (t.spark.sparkContext.applicationId, t.sf_dir, state_of(t.spark, f"{t.sf_dir}/documents.parquet"))
    if at not in _stored:
        for old in [k for k in _stored if k[:2] == at[:2]]:
            drop_folder(t.spark, _stored.pop(old))
        path = new_folder(t.spark, "text-index")
        fulltext.write_index(t("documents").select(c("doc_id").alias("id"), "text"), path)
        _stored[at] = path
    return _stored[at]


QUESTION, NEARBY = "the er ing OR ed -queque", "hashes eds ing"
POSITIONS = f"""x AS (SELECT id, unnest(ws) AS term, unnest(range(len(ws))) AS position FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)),
words AS (SELECT DISTINCT term FROM x WHERE term NOT IN ({", ".join(f"'{w}'" for w in fulltext.STOP)})),
{sql_stems("words")},
p AS MATERIALIZED (SELECT id, stem, position, row_number() OVER (PARTITION BY id, stem ORDER BY position) AS nth FROM x JOIN stems USING (term))"""
FTS = f"""WITH {POSITIONS}
SELECT id, round(sum(CASE WHEN nth <= 256 AND stem IN ('er', 'ing', 'ed', 'quequ') THEN 1.0::DOUBLE / (nth * nth) ELSE 0 END) * 0.1 / 1.64493406685 / 4, 6) AS rank FROM p GROUP BY id
HAVING (bool_or(stem = 'er') AND bool_or(stem = 'ing')) OR (bool_or(stem = 'ed') AND NOT bool_or(stem = 'quequ'))"""
NEAR_SQL = f"""WITH {POSITIONS},
q AS (SELECT * FROM p WHERE stem IN ('hash', 'ed', 'ing')),
ok AS (SELECT id FROM q GROUP BY id HAVING count(DISTINCT stem) = 3),
d AS (SELECT a.id, abs(a.position - b.position) AS d FROM q a JOIN q b ON a.id = b.id AND a.stem < b.stem AND a.position <> b.position WHERE a.nth <= 256 AND b.nth <= 256)
SELECT id, round(1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))), 6) AS rank FROM d JOIN ok USING (id) GROUP BY id ORDER BY rank DESC, id"""


@query("R4_full_text", FTS)
def _(t):
    return fulltext.full_text(t.spark, text_index(t), QUESTION)


@query("R4_best_by_nearness", f"{NEAR_SQL} LIMIT 10")
def _(t):
    """The ten best of a query that has to match whole, from the pages that can hold them."""
    return fulltext.full_text_top(t.spark, text_index(t), NEARBY, 10)


@query("R4_best_by_count", f"SELECT * FROM ({FTS}) ORDER BY rank DESC, id LIMIT 10")
def _(t):
    return fulltext.full_text_top(t.spark, text_index(t), QUESTION, 10)


FUSE = f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS vr FROM ({COSINE.format(15)})), f AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) - 1 AS fr FROM (SELECT * FROM ({FTS}) ORDER BY rank DESC, id LIMIT 15)),
j AS (SELECT coalesce(v.id, f.id) AS id, coalesce(similarity, 0) AS similarity, vr, fr, CASE WHEN (SELECT count(*) FROM f) > 0 THEN round(coalesce(1.0::DOUBLE / (61 + vr), 0) + coalesce(1.0::DOUBLE / (61 + fr), 0), 9) END AS rrf_score FROM v FULL JOIN f ON v.id = f.id)
SELECT id, similarity, rrf_score FROM j ORDER BY rrf_score DESC, vr NULLS LAST, fr NULLS LAST LIMIT 5"""


@query("R5_hybrid", FUSE)
def _(t):
    return r.fuse(_with_query(t, 15), fulltext.full_text_top(t.spark, text_index(t), QUESTION, 15), 5)


@query("R6_figures", f"SELECT s.id, list(l_partkey ORDER BY l_partkey) AS images FROM ({COSINE.format(16)}) s JOIN lineitem ON l_orderkey = s.id GROUP BY s.id, s.similarity ORDER BY s.similarity DESC, s.id LIMIT 4")
def _(t):
    assets = t("lineitem").select(c("l_orderkey").alias("id"), c("l_partkey").alias("image"))
    chunks = t("orders").select(c("o_orderkey").alias("id"), c("o_orderkey").alias("sequence_id"))
    return r.figure_hits(_with_query(t, 16), assets, chunks, 4)


@query("R7_agent_search", f"SELECT id FROM (SELECT id FROM ({FTS}) UNION SELECT doc_id FROM documents WHERE text ILIKE '%ationre%') ORDER BY id LIMIT 8")
def _(t):
    text = fulltext.full_text(t.spark, text_index(t), QUESTION).select("id")
    return text.union(t("documents").where(c("text").ilike("%ationre%")).select(c("doc_id").alias("id"))).distinct().orderBy("id").limit(8)


@query("R8_agent_read", "SELECT doc_id, n > 40 AS truncated FROM (SELECT doc_id, count(*) OVER () AS n FROM documents WHERE doc_id BETWEEN least(90, 20) AND greatest(90, 20)) ORDER BY doc_id LIMIT 40")
def _(t):
    d = t("documents").where(c("doc_id").between(F.least(F.lit(90), F.lit(20)), F.greatest(F.lit(90), F.lit(20)))).select("doc_id")
    n = d.agg((F.count("*") > 40).alias("truncated"))
    return d.orderBy("doc_id").limit(40).crossJoin(F.broadcast(n))


@query("R9_whole_or_agent", r"SELECT source, sum(floor(len(regexp_extract_all(text, '\S+')) * 13 / 10)) <= 20000 AS whole FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg((F.sum(x.estimate_tokens(c("text"))) <= 20000).alias("whole"))


def _by_size(*shapes):
    """One of the shapes for each part, by its size."""
    out = F.when(c("p_size") % len(shapes) == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        out = out.when(c("p_size") % len(shapes) == i, shape)
    return out


@query(
    "X17_pipe_tables",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN list_transform(range(p_partkey % 5 + 2), lambda i : [p_name, i::VARCHAR]) WHEN 1 THEN [[p_brand, p_type, p_name], [p_size::VARCHAR]] END AS cells FROM part""",
)
def _(t):
    """Tables of two to six rows, with indents and cells left empty; one line; lines with too few pipes."""
    rows = F.transform(F.sequence(F.lit(0), (c("p_partkey") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("| "), "p_name", F.lit(" | "), i.cast("string"), F.lit(" |")))
    grid = F.concat(F.lit("before\n"), F.get(rows, F.lit(0)), F.lit("\n| :--- | ---: |\n"), F.array_join(F.slice(rows, F.lit(2), F.size(rows)), "\n"), F.lit("\nafter"))
    ragged = F.concat(F.lit("  | "), "p_brand", F.lit(" || "), "p_type", F.lit("| "), "p_name", F.lit("  |\n|-|-|\n\t||"), c("p_size").cast("string"), F.lit("|  "))
    md = _by_size(grid, ragged, F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |")), F.concat("p_name", F.lit(" | "), "p_brand", F.lit("\n"), "p_type", F.lit("|x")))
    return t("part").select("p_partkey", x.pipe_table(md).alias("cells"))


@query(
    "X35_tool_replies",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN list_transform(range(least(3, p_partkey % 6)), lambda i : p_name || ' ' || i) WHEN 1 THEN [p_brand] ELSE []::VARCHAR[] END AS searches,
CASE p_size % 4 WHEN 1 THEN [[p_size, p_size + 3], [9, 2]] WHEN 3 THEN [[1, 2], [3, 4], [5, 6]] ELSE []::INT[][] END AS reads FROM part""",
)
def _(t):
    """None to five searches of which three count; reads written in three ways, in a block that isn't closed; calls outside; four reads."""
    asked = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < c("p_partkey") % 6), lambda i: F.concat(F.lit("search: "), "p_name", F.lit(" "), i.cast("string"), F.lit(" "))), "\n")
    size = c("p_size").cast("string")
    reply = _by_size(
        F.concat(F.lit("<tool>\n"), asked, F.lit("\nSEARCH:\n</tool>\nSEARCH: after")),
        F.concat(F.lit("Let me see. <TOOL>\n READ: "), size, F.lit(" – "), (c("p_size") + 3).cast("string"), F.lit("\nRead: 9 to 2\nREAD: 7\nSEARCH: "), "p_brand"),
        F.concat(F.lit("SEARCH: "), "p_name", F.lit("\nREAD: 1-2")),
        F.lit("<tool>READ: 1-2\nREAD: 3-4\nREAD: 5-6\nREAD: 7-8</tool>"),
    )
    return t("part").select("p_partkey", g.tool_calls(reply).alias("x")).select("p_partkey", "x.searches", "x.reads")


@query(
    "X36_citation_shapes",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN list_transform(range(p_partkey % 4), lambda i : (p_size + i)::INT) WHEN 1 THEN CASE WHEN p_size = 5 THEN [5, 6] ELSE [5, p_size, 6] END WHEN 2 THEN [p_size, p_size + 1] ELSE []::INT[] END AS cited FROM part""",
)
def _(t):
    """One to three citations or none; several in a bracket, with repeats; brackets in brackets; what is no citation."""
    size, more = c("p_size").cast("string"), (c("p_size") + 1).cast("string")
    each = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("p_partkey") % 4), lambda i: F.concat(F.lit("so [["), (c("p_size") + i).cast("string"), F.lit("]]. "))), "")
    answer = _by_size(each, F.concat(F.lit("by [[5; "), size, F.lit("]] and [[ 6,5 ]]")), F.concat(F.lit("[["), size, F.lit("], ["), more, F.lit("]]")), F.concat(F.lit("["), size, F.lit("] [[x"), size, F.lit("]] [[]]")))
    return t("part").select("p_partkey", g.cited(answer).alias("cited"))


@query(
    "X37_research_replies",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN list_transform(range(p_partkey % 4), lambda i : p_name || i) WHEN 1 THEN [p_brand, p_type] END AS queries FROM part",
)
def _(t):
    """No to three queries; JSON over several lines amid prose; an answer that asks for nothing; JSON that is none."""
    some = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("p_partkey") % 4), lambda i: F.concat("p_name", i.cast("string")))
    reply = _by_size(
        F.concat(F.lit("NEEDS_RESEARCH"), F.to_json(F.struct(some.alias("queries")))),
        F.concat(F.lit('I must look.\nNEEDS_RESEARCH :\n{\n "why": {"a": 1},\n "queries": ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]\n}\nThanks.')),
        F.concat("p_name", F.lit(' {"queries": ["no"]}')),
        F.lit("NEEDS_RESEARCH: {queries: nothing"),
    )
    return t("part").select("p_partkey", g.needs_research(reply).alias("queries"))
