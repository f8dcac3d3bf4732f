"""Layout, chunkers, model stages and event windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing, text as x
from ..functions.tables import parse_table
from ..models import HashModel, embed
from ..operators import layout
from ..operators.chunks import EARLY_BLOCKS, chunks_of_blocks, chunks_of_markdown, flat_caption
from ..operators.store import pending
from ..scratch import new_folder
from ..streaming.jobs import embed_incrementally
from .registry import query
from .text import NORMAL, PARAGRAPHS, PHRASE, PLAIN

c = F.col


@query(
    "A14_quality",
    """WITH b AS (SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_quantity AS q, CASE l_partkey % 3 WHEN 0 THEN 'equation' WHEN 1 THEN 'heading' ELSE 'text' END AS kind FROM lineitem),
p AS (SELECT *, kind = 'equation' AND lag(kind) OVER (PARTITION BY d ORDER BY k, l_partkey, q) = 'equation' AS pair FROM b),
s AS (SELECT d AS document_id, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'equation') AS equations FROM p GROUP BY ROLLUP (d)),
n AS (SELECT d, round(q * 10 / 40) AS bin, count(*) AS n FROM b GROUP BY 1, 2), m AS (SELECT d, count(*) FILTER (n >= t * 0.15) >= 2 AS two_columns FROM (SELECT *, sum(n) OVER (PARTITION BY d) AS t FROM n) GROUP BY d)
SELECT document_id, blocks, headings, equations, two_columns FROM s LEFT JOIN m ON document_id = d""",
)
def _(t):
    kind = F.when(c("l_partkey") % 3 == 0, "equation").when(c("l_partkey") % 3 == 1, "heading").otherwise("text")
    b = t("lineitem").select(c("l_suppkey").alias("document_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("at"), kind.alias("kind"), F.lit("x").alias("text"), (c("l_quantity") * 10).alias("left"))
    return layout.quality(b).select("document_id", "blocks", "headings", "equations", "two_columns")


@query(
    "A14_quality_of_text",
    r"""WITH b AS (SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_partkey % 3 AS p, l_linenumber AS n, l_quantity::INT AS q FROM lineitem),
s AS (SELECT *, CASE WHEN p = 1 AND n <> 5 THEN [q, n] END AS sec FROM b),
m AS (SELECT *, p = 0 AND lag(p) OVER w = 0 AS pair, sec < last_value(sec IGNORE NULLS) OVER (PARTITION BY d ORDER BY k, l_partkey, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inv FROM s WINDOW w AS (PARTITION BY d ORDER BY k, l_partkey, q))
SELECT d AS document_id, count(*) AS blocks, count(*) FILTER (p = 1) AS headings, count(sec) AS numbered, count(*) FILTER (inv) AS inversions, count(*) FILTER (p = 0) AS equations, count(*) FILTER (pair) AS adjacent,
  count(*) FILTER (p = 0 AND n % 2 = 1) AS open_tails, count(*) FILTER (p = 2 AND n = 3) AS orphans, count(*) FILTER ((p = 0 AND n % 2 = 0) OR (p = 2 AND n NOT IN (3, 4))) AS leaks,
  (count(*) FILTER (p = 0 AND n % 2 = 0) + 2 * count(*) FILTER (p = 2 AND n NOT IN (3, 4)))::BIGINT AS leaked FROM m GROUP BY ROLLUP (d)""",
)
def _(t):
    """Numbered headings out of order, equations that are cut, labels alone, glyphs within mathematics and outside."""
    p, n = c("l_partkey") % 3, c("l_linenumber")
    kind = F.when(p == 0, "equation").when(p == 1, "heading").when(n == 4, "table").otherwise("text")
    heading = F.when(n == 5, "Aims").otherwise(F.concat(c("l_quantity").cast("int").cast("string"), F.lit("."), n.cast("string"), F.lit(". Aims")))
    text = F.when(p == 0, F.when(n % 2 == 1, "a = b + ").otherwise("x ≤ y")).when(p == 1, heading).when(n == 3, " ( 12b ) ").otherwise("so 3×3, $a × b ∂$ and $c$ σ")
    b = t("lineitem").select(c("l_suppkey").alias("document_id"), F.struct(c("l_orderkey") * 10 + n, "l_partkey", "l_quantity").alias("at"), kind.alias("kind"), text.alias("text"), F.lit(None).cast("double").alias("left"))
    return layout.quality(b).drop("two_columns")


@query("X24_join_spans", "SELECT conv_id, string_agg(role || CASE WHEN turn < m AND turn % 2 = 0 THEN ' ' ELSE '' END, '' ORDER BY turn) AS text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def _(t):
    v = t("conversations").select("conv_id", "turn", c("role").alias("text"), (c("turn") * 100 + F.when(c("turn") % 2 == 1, 10).otherwise(0)).cast("double").alias("left"))
    v = v.withColumn("right", F.when(c("turn") % 2 == 1, c("turn") * 100 + 100).otherwise(c("turn") * 100 + F.length("text")).cast("double"))
    return layout.join_spans(v, ["conv_id"], "turn")


@query("X45_crop", "SELECT n_nationkey AS id, (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY greatest(0, least(100, round(s_acctbal / 10) + 100) - greatest(0, round(s_acctbal / 10))) DESC, s_suppkey LIMIT 1) AS rid FROM nation")
def _(t):
    f = t("nation").select(c("n_nationkey").alias("id"), c("n_nationkey").alias("page"), *[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 100.0), ("y1", 1.0))])
    r = t("supplier").select(c("s_nationkey").alias("page"), c("s_suppkey").alias("rid"), F.round(c("s_acctbal") / 10).alias("rx0"), F.lit(0.0).alias("ry0"), F.lit(1.0).alias("ry1")).withColumn("rx1", c("rx0") + 100)
    return layout.crop(f, r, "page")


@query("X42_model_kinds", "SELECT p_partkey, ends_with(lower(p_name), 'cloud') OR p_size = 0 AS cloud, contains(lower(p_name), 'embed') AS embedding, regexp_matches(split_part(p_name, '/', -1), '^o[0-9]') AS reasoning FROM part")
def _(t):
    n = c("p_name")
    return t("part").select("p_partkey", routing.is_cloud_model(n, c("p_size") == 0).alias("cloud"), routing.is_embedding_model(n).alias("embedding"), routing.is_reasoning_model(n).alias("reasoning"))


@query("X19_flat_captions", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 2 THEN 'Say \"' || p_brand || '\"' ELSE '' END AS caption FROM part")
def _(t):
    """Captions as an extractor writes them: a string, lists in lists, quotes inside, nothing."""
    nested = F.concat(F.lit('["'), "p_name", F.lit('", [["'), "p_brand", F.lit('"], [], [[" '), "p_type", F.lit(' "]]]]'))
    said = F.when(c("p_size") % 4 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(c("p_size") % 4 == 1, nested).when(c("p_size") % 4 == 2, F.concat(F.lit('["Say", "\\"'), "p_brand", F.lit('\\""]'))).otherwise("null")
    return t("part").select("p_partkey", flat_caption(F.parse_json(said)).alias("caption"))


@query("X47_stored_path", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR || '.png' ELSE url END AS path FROM pages")
def _(t):
    served = F.when(c("page_id") % 2 == 0, x.image_url(F.concat(c("page_id").cast("string"), F.lit(".png")))).otherwise(c("url"))
    return t("pages").select("page_id", x.stored_path(served).alias("path"))


def _markdown(t, text):
    return t("documents").select(c("doc_id").cast("string").alias("document_id"), F.concat(F.lit("# "), "source", F.lit("\n\n"), F.replace(text, F.lit("\n"), F.lit("\n\n"))).alias("markdown"))


# The rules of text.py over blocks instead of texts; packing long paragraphs is that of PARAGRAPHS.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PACKED = PARAGRAPHS[PARAGRAPHS.index("p AS (") : PARAGRAPHS.index("o AS (")]
_PLAINLY, _TIDILY = (lambda v: PLAIN.replace("(text,", f"({v},", 1)), (lambda v: NORMAL.replace("(text,", f"({v},", 1))
_NOTE = rf"""length(b) > 0 AND CASE WHEN regexp_matches(split_part(b, chr(10), 1), '^[{x.FOOTNOTE_MARKS}]+\s*\S') THEN phrase OR NOT (starts_with(b, '*') AND NOT starts_with(b, '**')) ELSE length(b) < 200 AND phrase END"""


def _long_paragraphs(key: str, text: str, source: str) -> str:
    """Common table expressions from source to o (key, i, j, paragraph): the paragraphs of text."""
    first = PARAGRAPHS[PARAGRAPHS.index("a AS (") : PARAGRAPHS.index("p AS (")].replace("SELECT doc_id,", f"SELECT {key} AS doc_id,").replace("replace(text,", f"replace({text},").replace("FROM documents", f"FROM {source}")
    return first + _PACKED + "o AS (SELECT doc_id, i, generate_subscripts(q, 1) AS j, unnest(q) AS paragraph FROM s)"


MARKDOWN_CHUNKS = rf"""WITH m AS (SELECT doc_id::VARCHAR AS document_id, '# ' || source || chr(10) || chr(10) || replace(replace(text, '$', 'USD'), chr(10), chr(10) || chr(10)) AS md FROM documents),
n AS (SELECT document_id, regexp_replace(regexp_replace(substring(md, 1, 3500), '\n([∗⋆★✱✲†‡§¶])', chr(10) || chr(10) || '\1', 'g') || substring(md, 3501), '(?m)^(#{{1,6}}\s+[^\n]*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS md FROM m),
l AS (SELECT document_id, list_filter(list_transform(string_split(md, chr(10) || chr(10)), lambda v : {_STRIP.format("v")}), lambda v : v <> '') AS l FROM n),
b AS (SELECT document_id, generate_subscripts(l, 1) AS at_, unnest(l) AS b FROM l),
f AS (SELECT *, {PHRASE.replace("lower(text)", "lower(b)")} AS phrase FROM b),
k AS MATERIALIZED (SELECT *, document_id || ' ' || at_ AS block, {_PLAINLY("b")} AS plain, {_TIDILY("b")} AS tidy, list_transform(regexp_extract_all(b, '!\[[^\]]*\]\(([^)]+)\)', 1), lambda v : split_part(trim(v), '/', -1)) AS refs,
  CASE WHEN regexp_matches(b, '\|.*\|.*\|') THEN 'table' WHEN regexp_matches(b, '!\[.*?\]\(.*?\)') THEN 'figure' WHEN regexp_matches(b, '^#{{1,6}}\s+.+') THEN 'heading' WHEN at_ <= {EARLY_BLOCKS} AND {_NOTE} THEN 'footnote' ELSE 'text' END AS kind FROM f),
w AS (SELECT * FROM k WHERE kind = 'text'), {_long_paragraphs("block", "plain", "w")},
c AS (SELECT document_id, at_, 0 AS i, 0 AS j, kind, CASE kind WHEN 'heading' THEN b ELSE tidy END AS markdown, CASE kind WHEN 'heading' THEN {_STRIP.format("regexp_replace(b, '^#+', '')")} ELSE plain END AS plain_text, CASE kind WHEN 'heading' THEN []::VARCHAR[] ELSE refs END AS refs FROM k WHERE kind <> 'text'
  UNION ALL SELECT document_id, at_, i, j, kind, {_TIDILY("paragraph")}, paragraph, refs FROM k JOIN o ON o.doc_id = block WHERE length(paragraph) > {x.SCRAP})
SELECT document_id, (row_number() OVER d)::INTEGER AS sequence_id, kind AS chunk_type, list_filter([last_value(CASE WHEN kind = 'heading' THEN plain_text END IGNORE NULLS) OVER d], lambda v : v IS NOT NULL) AS heading_path, markdown, plain_text,
  NULL::INTEGER AS page_start, NULL::INTEGER AS page_end, floor(len(regexp_extract_all(plain_text, '\S+')) * 13 / 10)::INTEGER AS token_count, list_filter(refs, lambda v : v <> '') AS image_refs
FROM c WINDOW d AS (PARTITION BY document_id ORDER BY at_, i, j ROWS UNBOUNDED PRECEDING)"""


@query("X6_markdown_chunks", MARKDOWN_CHUNKS)
def _(t):
    """Every document as Markdown under a heading, without dollar signs."""
    return chunks_of_markdown(_markdown(t, F.replace("text", F.lit("$"), F.lit("USD")))).drop("table_json")


@query("X6_markdown_mathematics")
def _(t):
    """The same with them: what stands between pairs of dollar signs is mathematics."""
    return chunks_of_markdown(_markdown(t, c("text"))).drop("table_json")


BLOCK_CHUNKS = rf"""WITH b AS (SELECT conv_id::VARCHAR AS document_id, turn, conv_id || ' ' || turn AS block, {_STRIP.format("coalesce(text, '')")} AS b FROM conversations),
w AS (SELECT * FROM b WHERE turn <> 0), {_long_paragraphs("block", "b", "w")},
c AS (SELECT document_id, turn, 0 AS i, 0 AS j, 'heading' AS kind, '# ' || b AS markdown, b AS plain_text FROM b WHERE turn = 0 AND b <> ''
  UNION ALL SELECT document_id, turn, i, j, 'text', paragraph, paragraph FROM b JOIN o ON o.doc_id = block WHERE length(paragraph) > {x.SCRAP})
SELECT document_id, (row_number() OVER d)::INTEGER AS sequence_id, kind AS chunk_type, list_filter([last_value(CASE WHEN kind = 'heading' THEN plain_text END IGNORE NULLS) OVER d], lambda v : v IS NOT NULL) AS heading_path, markdown, plain_text,
  (turn + 1)::INTEGER AS page_start, (turn + 1)::INTEGER AS page_end, floor(len(regexp_extract_all(plain_text, '\S+')) * 13 / 10)::INTEGER AS token_count, []::VARCHAR[] AS image_refs
FROM c WINDOW d AS (PARTITION BY document_id ORDER BY turn, i, j ROWS UNBOUNDED PRECEDING)"""


@query("X5_block_chunks", BLOCK_CHUNKS)
def _(t):
    """Every conversation as typed blocks, its first turn a heading."""
    block = F.struct(F.lit("text").alias("type"), "text", F.when(c("turn") == 0, 1).alias("text_level"), c("turn").cast("int").alias("page_idx"))
    d = t("conversations").groupBy(c("conv_id").cast("string").alias("document_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda e: e["b"])).alias("blocks"))
    return chunks_of_blocks(d).drop("table_json")


GRIDS = r"""SELECT p_partkey, t.headers, t.rows AS cells, t.num_cols FROM (SELECT p_partkey, CASE p_size % 4
  WHEN 0 THEN {'headers': [p_brand, p_brand || ' ' || p_type], 'rows': [[p_name, p_size::VARCHAR]], 'num_cols': 2}
  WHEN 1 THEN {'headers': ['Model & ' || p_brand, 'Cost'], 'rows': [[p_name, p_size::VARCHAR], [p_name, p_type], ['x', 'x']], 'num_cols': 2}
  WHEN 2 THEN {'headers': [p_name, p_brand, 'n'], 'rows': [[p_type, p_size::VARCHAR]], 'num_cols': 3}
  END AS t FROM part)"""


@query("X16_html_tables", GRIDS)
def _(t):
    n, td = c("p_size").cast("string"), lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))
    html = (
        F.when(c("p_size") % 4 == 0, F.concat(F.lit("<table><tr><th colspan='2'>"), "p_brand", F.lit("</th></tr><tr><th></th><th>"), "p_type", F.lit("</th></tr><tr>"), td("p_name"), td(n), F.lit("</tr></table>")))
        .when(c("p_size") % 4 == 1, F.concat(F.lit("<TABLE>\n<tr><th>Model &amp; <b>"), "p_brand", F.lit("</b></th><th>Cost</th></tr>\n<tr><td rowspan=\"2\">"), "p_name", F.lit("</td>"), td(n), F.lit("</tr><tr>"), td("p_type"), F.lit("</tr><tr><td colspan=2>x</td></tr></TABLE>")))
        .when(c("p_size") % 4 == 2, F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | n |\n|---|---|---|\n| "), "p_type", F.lit(" | | "), n, F.lit(" |")))
        .otherwise(F.lit("<p>no table</p>"))
    )
    # a table of few bytes is few partitions, however many rows it has
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part = part.repartition(max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism), "p_partkey")
    return part.select("p_partkey", parse_table(html).alias("t")).select("p_partkey", "t.headers", c("t.rows").alias("cells"), "t.num_cols")



@query(
    "R11_embed_pending",
    """WITH h AS (SELECT doc_id AS id, sha256(CASE WHEN coalesce(text, '') = '' THEN '[text]' ELSE substring(text, 1, 3000) END) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
v AS (SELECT id, list_transform(range(8), lambda i : ('0x' || substring(h, 1 + 2 * i, 2))::INT / 255::DOUBLE) AS v FROM h)
SELECT id, list_transform(v, lambda x : round(x / sqrt(list_sum(list_transform(v, lambda y : y * y))), 9)) AS embedding FROM v""",
)
def _(t):
    chunks = t("documents").select(c("doc_id").alias("id"), F.lit("text").alias("chunk_type"), c("text").alias("plain_text"))
    done = embed(pending(chunks, t("labels").select(c("doc_id").alias("id")), ["id"]), HashModel(), 8)
    return done.select("id", F.transform("embedding", lambda v: F.round(v, 9)).alias("embedding"))


@query(
    "Z1_incremental_embed",
    """WITH h AS (SELECT doc_id AS id, sha256(CASE WHEN coalesce(text, '') = '' THEN '[text]' ELSE substring(text, 1, 3000) END) AS h FROM documents),
v AS (SELECT id, list_transform(range(8), lambda i : ('0x' || substring(h, 1 + 2 * i, 2))::INT / 255::DOUBLE) AS v FROM h)
SELECT id, list_transform(v, lambda x : round(x / sqrt(list_sum(list_transform(v, lambda y : y * y))), 9)) AS embedding FROM v""",
)
def _(t):
    """The documents as a stream, embedded by a query that is started again after it has ended: nothing is done twice. A pattern names the table, be it a file or a folder."""
    d, folder = t("documents"), new_folder(t.spark, "embedded")
    for _ in range(2):
        chunks = t.spark.readStream.schema(d.schema).parquet(f"{t.sf_dir}/documents.parquet*").select(c("doc_id").alias("id"), F.lit("text").alias("chunk_type"), c("text").alias("plain_text"))
        embed_incrementally(chunks, f"{folder}/rows", f"{folder}/checkpoint", lambda rows: embed(rows, HashModel(), 8)).awaitTermination()
    done = t.spark.read.parquet(f"{folder}/rows")
    return done.select("id", F.transform("embedding", lambda v: F.round(v, 9)).alias("embedding"))


@query("R13_stale_embeddings", "SELECT vec_id FROM embeddings WHERE label <> 3 OR len(embedding) <> 64")
def _(t):
    return t("embeddings").where((c("label") != 3) | (F.size("embedding") != 64)).select("vec_id")


@query("Z_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    e = t("events").groupBy(F.window(c("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(c("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "Z_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(t):
    e = t("events").groupBy("user_id", F.session_window(c("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", c("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("Z7_compaction_due", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 3 AND count(*) >= 6")
def _(t):
    n = t("conversations").groupBy("conv_id").agg(F.count(F.when(c("role") == "user", 1)).alias("u"), F.count("*").alias("n"))
    return n.where("u >= 3 and n >= 6").select("conv_id")
