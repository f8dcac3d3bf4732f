"""Contexts, prompt blocks, research rounds, repairs and ingestion steps on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing, text as x
from ..operators import chunks, contexts as k, layout, repair, research, retrieval
from ..sources import ingest
from .registry import query
from .text import COSINE, _with_query

c = F.col


@query(
    "R15_quote_location",
    r"""WITH q AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w : w <> '')[2:4] AS w FROM documents),
m AS (SELECT doc_id, text, CASE WHEN len(w) > 0 THEN regexp_extract(text, array_to_string(list_transform(w, lambda v : '\Q' || v || '\E'), '\s+')) END AS m FROM q)
SELECT doc_id, (instr(text, m) - 1)::INT AS start, (instr(text, m) - 1 + length(m))::INT AS "end" FROM m""",
)
def _(t):
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    d = t("documents").select("doc_id", x.locate_quote(c("text"), F.array_join(F.slice(words, 2, 3), " \n ")).alias("at"))
    return d.select("doc_id", "at.start", "at.end")


@query("X21_glyph_repair", "SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page, 'In c' || conv_id || 't' || turn || ' we have $n$ tokens, $k$' AS text FROM conversations")
def _(t):
    v = t("conversations").select(c("conv_id").cast("string").alias("document_id"), (c("turn") + 1).alias("page"), F.concat(F.lit("In c"), c("conv_id").cast("string"), F.lit("t"), c("turn").cast("string"), F.lit(" we have 𝑛 tokens, 𝑘")).alias("content"))
    hurt = v.select("document_id", "page", F.regexp_replace("content", "[𝑛𝑘]", repair.LOST).alias("text"))
    return repair.repair_glyphs(hurt, v)


@query(
    "X26_page_assembly",
    r"""WITH l AS (SELECT conv_id, turn, role = 'assistant' AS m, CASE WHEN role = 'assistant' THEN 'x = α + ' || turn ELSE 'plain line ' || turn END AS s FROM conversations),
b AS (SELECT *, CASE WHEN m AND coalesce(lag(m) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 0 ELSE 1 END AS b FROM l),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM b),
p AS (SELECT conv_id, r, CASE WHEN any_value(m) THEN chr(10) || '$$' || chr(10) || string_agg(s, ' \\ ' || chr(10) ORDER BY turn) || chr(10) || '$$' || chr(10) ELSE any_value(s) END AS p FROM r GROUP BY conv_id, r)
SELECT conv_id, string_agg(p, chr(10) ORDER BY r) AS markdown FROM p GROUP BY conv_id""",
)
def _(t):
    body = F.when(c("role") == "assistant", F.concat(F.lit("x = α + "), c("turn").cast("string"))).otherwise(F.concat(F.lit("plain line "), c("turn").cast("string")))
    one = {"x0": 0.0, "size": 10.0, "body": 10.0, "bold": False, "height": 100000.0}
    lines = t("conversations").select("conv_id", (c("turn") * 10).cast("double").alias("y0"), body.alias("text"), *[F.lit(v).alias(n) for n, v in one.items()], F.lit(None).cast("string").alias("image"))
    return layout.assemble_pages(lines, "conv_id")


@query("X46_research")
def _(t):
    """Research of the nations' names among pages, which a stand-in for the web finds by a hash of the query."""
    pages = t("pages").select("url", "page_id", F.concat(F.lit("Page "), c("page_id").cast("string")).alias("title"), c("html").alias("snippet"), (c("page_id") % 5).cast("double").alias("score"))

    def search(asked):
        keyed = asked.withColumn("h", F.pmod(F.xxhash64("query"), F.lit(50)))
        return keyed.join(pages.withColumn("h", c("page_id") % 50), "h").select("question", "query", c("page_id").alias("position"), "url", "title", "snippet", "score")

    asked = t("nation").select(c("n_nationkey").alias("question"), F.concat(F.lit("how does it work in "), "n_name").alias("text"), F.lit("paper.pdf").alias("title"))
    return research.research(asked, search)


@query("X48_embedding_response", "SELECT label, list(round(embedding[1]::DOUBLE, 6) ORDER BY vec_id DESC) AS firsts FROM embeddings GROUP BY label")
def _(t):
    sent = t("embeddings").groupBy("label").agg(F.collect_list(F.struct((-c("vec_id")).alias("index"), "embedding")).alias("items"), F.count("*").cast("int").alias("n"))
    return sent.select("label", F.transform(retrieval.response_vectors(c("items"), c("n"), 64), lambda v: F.round(v[0], 6)).alias("firsts"))


@query(
    "R14_global_context",
    f"""WITH h AS ({COSINE.format(5)}), b AS (SELECT string_agg('[Chunk seq=' || id || ', similarity=' || printf('%.3f', similarity) || ']' || chr(10) || source, chr(10) || chr(10) ORDER BY similarity DESC, id) AS a FROM h JOIN documents ON doc_id = id),
f AS (SELECT string_agg('- ![paper figure](/static/images/' || s_name || ')', chr(10) ORDER BY similarity DESC, id) AS f FROM h JOIN supplier ON s_suppkey = id)
SELECT 1 AS question, a || coalesce(chr(10) || chr(10) || '{k.FIGURES}' || chr(10) || f, '') AS context FROM b, f""",
)
def _(t):
    hits = _with_query(t, 5).join(t("documents").select(c("doc_id").alias("id"), c("source").alias("body")), "id").select(F.lit(1).alias("question"), "id", c("id").alias("sequence_id"), "similarity", "body")
    return k.global_context(hits, t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("path"), F.lit(None).cast("string").alias("caption")))


@query(
    "R14_overview_context",
    rf"""WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS level, l_partkey AS seq, l_linenumber::DOUBLE * 1000 + l_quantity AS made, l_returnflag AS head, l_shipdate::DATE::VARCHAR AS body FROM lineitem),
p AS (SELECT l_orderkey, '{k.PAPER_OVERVIEW.strip()}' || chr(10) || chr(10) || body AS p FROM s WHERE level = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY seq, made) = 1),
d AS (SELECT l_orderkey, string_agg(chr(10) || '#### ' || head || chr(10) || chr(10) || body, chr(10) ORDER BY level, seq, made, chr(10) || '#### ' || head || chr(10) || chr(10) || body) AS d FROM s WHERE level > 0 GROUP BY 1)
SELECT o_orderkey AS document_id, CASE WHEN p IS NULL AND d IS NULL THEN '{k.NO_SUMMARIES}' ELSE concat_ws(chr(10), p, chr(10) || chr(10) || '{k.SECTION_SUMMARIES.strip()}' || chr(10) || chr(10) || d) END AS context
FROM orders LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN d ON d.l_orderkey = o_orderkey""",
)
def _(t):
    s = t("lineitem").select(
        c("l_orderkey").alias("document_id"), (c("l_linenumber") % 3).alias("level"), c("l_partkey").alias("sequence_start"), (c("l_linenumber") * 1000 + c("l_quantity")).cast("double").alias("created_at"),
        F.array("l_returnflag").alias("heading_path"), c("l_shipdate").cast("date").cast("string").alias("summary"),
    )
    return k.overview_context(t("orders").select(c("o_orderkey").alias("document_id")), s)


@query(
    "R14_external_context",
    f"""WITH r AS (SELECT page_id % 25 AS q, '[Page ' || page_id || '](' || url || ')' || chr(10) || CASE WHEN length(html) > 500 THEN substring(html, 1, 500) || '...' ELSE html END AS line, row_number() OVER (PARTITION BY page_id % 25 ORDER BY page_id % 3 DESC, page_id) AS k FROM pages),
i AS (SELECT p_partkey % 25 AS q, '- ![' || p_name || '](' || p_brand || ')  · source: ' || p_type AS line, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS k FROM part),
a AS (SELECT q, string_agg(line, chr(10) || chr(10) ORDER BY k) AS a FROM r WHERE k <= 5 GROUP BY q), b AS (SELECT q, string_agg(line, chr(10) ORDER BY k) AS b FROM i WHERE k <= CASE WHEN q % 2 = 0 THEN 4 ELSE 2 END GROUP BY q)
SELECT n_nationkey AS question, concat_ws(chr(10) || chr(10), a, '{k.IMAGES}' || chr(10) || b) AS context FROM nation LEFT JOIN a ON a.q = n_nationkey LEFT JOIN b ON b.q = n_nationkey""",
)
def _(t):
    text = F.when(c("n_nationkey") % 2 == 0, F.concat(F.lit("a picture of "), "n_name")).otherwise(c("n_name"))
    questions = t("nation").select(c("n_nationkey").alias("question"), text.alias("text"), F.lit("").alias("title"))
    results = t("pages").select((c("page_id") % 25).cast("int").alias("question"), "url", F.concat(F.lit("Page "), c("page_id").cast("string")).alias("title"), c("html").alias("snippet"), (c("page_id") % 3).cast("double").alias("score"), c("page_id").alias("position"))
    images = t("part").select((c("p_partkey") % 25).cast("int").alias("question"), c("p_partkey").alias("position"), c("p_name").alias("title"), F.lit("far").alias("img_url"), c("p_brand").alias("thumbnail"), c("p_type").alias("source_url"))
    return k.external_context(questions, results, images).select("question", "context")


@query("X38_blocks", "SELECT conv_id, string_agg('[[' || turn || ']]' || CASE WHEN role <> 'user' THEN ' (' || role || ')' ELSE '' END || ' (p' || turn // 2 || ')' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS blocks FROM conversations GROUP BY conv_id")
def _(t):
    one = k.block(c("turn"), F.when(c("role") == "user", "text").otherwise(c("role")), c("text"), F.floor(c("turn") / 2))
    return k.lines_of(t("conversations"), ["conv_id"], ["turn"], one, "\n\n", "blocks")


@query("X38_outline", "SELECT conv_id, string_agg(repeat('  ', turn % 3) || '[[' || turn || ']] ' || role, chr(10) ORDER BY turn) AS outline FROM conversations GROUP BY conv_id")
def _(t):
    return k.lines_of(t("conversations"), ["conv_id"], ["turn"], k.outline_line(c("turn"), (c("turn") % 3 + 1).cast("int"), c("role")), "\n", "outline")


@query("X38_anchor", f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{k.HIGHLIGHTED.strip()}' || chr(10) || '“' || p_name || '”' ELSE '{k.READING}' END || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '{k.SURROUNDING.strip()}' || chr(10) || p_type ELSE '' END AS anchor FROM part")
def _(t):
    return t("part").select("p_partkey", k.anchor(F.when(c("p_size") % 2 == 0, c("p_name")), F.when(c("p_size") % 3 == 0, c("p_type"))).alias("anchor"))


@query("X38_thread", f"SELECT o_custkey, '{k.EARLIER}' || chr(10) || string_agg('Reader asked: ' || o_orderpriority || CASE WHEN o_orderstatus <> 'P' THEN chr(10) || 'You answered: ' || o_orderstatus ELSE '' END, chr(10) ORDER BY o_orderkey) AS thread FROM orders GROUP BY o_custkey")
def _(t):
    line = k.thread_line(c("o_orderpriority"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")))
    notes = k.lines_of(t("orders"), ["o_custkey"], ["o_orderkey"], line, "\n", "lines")
    return notes.select("o_custkey", F.concat(F.lit(k.EARLIER + "\n"), "lines").alias("thread"))


@query("T6_citations", "SELECT p_partkey, CASE WHEN p_size = 16 THEN [16, 42] WHEN p_size = 42 THEN [16, 42] ELSE [16, 42, p_size] END AS cited FROM part")
def _(t):
    answer = F.concat(F.lit("See [[16], [42]] and [["), c("p_size").cast("string"), F.lit(", 16]], not [7]."))
    return t("part").select("p_partkey", routing.cited(answer).alias("cited"))


_FENCED = r"""chr(10) || chr(10) || '$$' || chr(10) || {} || chr(10) || '$$' || chr(10) || chr(10)"""
STITCHED = rf"""SELECT p_partkey, CASE p_size % 4
  WHEN 0 THEN '$$' || chr(10) || p_name || ' = ' || p_brand || ' \quad (' || p_size || ')' || chr(10) || '$$' || chr(10) || chr(10) || 'Prose follows here. It ends.'
  WHEN 1 THEN 'An intro is here. Yes.' || {_FENCED.format("p_brand || ' x = ' || p_size || ' y'")} || 'Prose of ' || p_name || ' here. It ends.' || chr(10) || 'And a line more. It ends.'
  WHEN 2 THEN p_name || ' =' || chr(10) || chr(10) || '(' || p_size || ')' || chr(10) || chr(10) || chr(10) || 'end'
  ELSE 'lead ' || {_FENCED.format("p_brand")} || ' tail of ' || p_name || '. It ends.' END AS md FROM part"""


@query("X9_stitch", STITCHED)
def _(t):
    n = c("p_size").cast("string")
    md = (
        F.when(c("p_size") % 4 == 0, F.concat("p_name", F.lit(" =\n\n$$"), "p_brand", F.lit("$$\n\n("), n, F.lit(")\n\nProse follows here. It ends.")))
        .when(c("p_size") % 4 == 1, F.concat(F.lit("An intro is here. Yes.\n$$"), "p_brand", F.lit("$$\n\n$$ x = "), n, F.lit(" $$\n\n\ny\nProse of "), "p_name", F.lit(" here. It ends.\nAnd a line more. It ends.")))
        .when(c("p_size") % 4 == 2, F.concat("p_name", F.lit(" =\n\n("), n, F.lit(")\n\n\nend")))
        .otherwise(F.concat(F.lit("lead $$"), "p_brand", F.lit("$$ tail of "), "p_name", F.lit(". It ends.")))
    )
    return chunks.stitch(t("part").select(c("p_partkey").alias("document_id"), md.alias("markdown"))).select(c("document_id").alias("p_partkey"), c("stitched").alias("md"))


@query("X11_inline_math", r"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ' $a \times b$ and × ' || p_brand WHEN 1 THEN 'So $$' || chr(10) || p_brand || ' \leq ' || p_size || chr(10) || '$$ and $\alpha _1$, ≤' ELSE p_name || ' costs 5 × ' || p_size END AS md FROM part")
def _(t):
    n = c("p_size").cast("string")
    md = (
        F.when(c("p_size") % 3 == 0, F.concat("p_name", F.lit(r" \( a ×b \) and × "), "p_brand"))
        .when(c("p_size") % 3 == 1, F.concat(F.lit("So \\["), "p_brand", F.lit(" ≤"), n, F.lit("\\] and $α_1$, ≤"))).otherwise(F.concat("p_name", F.lit(" costs 5 × "), n))
    )
    return t("part").select("p_partkey", chunks.inline_math(md).alias("md"))


@query("S9_extractor", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'vlm' WHEN p_size % 2 = 0 THEN 'mineru' ELSE 'pymupdf' END AS extractor FROM part")
def _(t):
    provider = F.when(c("p_size") % 3 == 0, " VLM").when(c("p_size") % 3 == 1, "mineru")
    return t("part").select("p_partkey", ingest.extractor(provider, F.when(c("p_size") % 2 == 0, "mineru").otherwise("pymupdf")).alias("extractor"))


@query("S13_stored_assets", "SELECT 'd' || p_size AS document_id, 'img' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '' END AS original_name, 'd' || p_size || '/' || substring(sha256('d' || p_size || chr(10) || '/out/img' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '' END), 1, 32) || CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '.png' END AS file_path, CASE WHEN p_partkey % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime_type FROM part")
def _(t):
    path = F.concat(F.lit("/out/img"), c("p_partkey").cast("string"), F.when(c("p_partkey") % 2 == 0, ".JPG").otherwise(""))
    return ingest.stored_assets(t("part").select(F.concat(F.lit("d"), c("p_size").cast("string")).alias("document_id"), path.alias("path")))


_SHAPES = ["10.0.0.{}", "me@192.168.1.{}", "8.8.8.{}", "example.org", "{}", "0x7f0000{}", "[::ffff:127.0.0.{}]", "localhost.", "100.64.0.{}", "[2606:4700::{}]", "[fd00::{}]", "0177.{}", "1347440{}", "LOCALHOST:80", "[64:ff9b::8.8.8.{}]", "redis{}"]
_INTERNAL = [0, 1, 4, 5, 6, 7, 8, 10, 11, 13, 15]


@query("S15_url_refusal", f"SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN 'not a web address' WHEN p_partkey % {len(_SHAPES)} IN ({', '.join(map(str, _INTERNAL))}) THEN 'internal host' END AS refusal FROM part")
def _(t):
    """Hosts as names, and as addresses in every way of writing them; n is 10 to 59."""
    n = (c("p_size") % 50 + 10).cast("string")
    host = F.element_at(F.array(*[F.concat(F.lit(s.split("{}")[0]), n, F.lit(s.split("{}")[1])) if "{}" in s else F.lit(s) for s in _SHAPES]), (c("p_partkey") % len(_SHAPES) + 1).cast("int"))
    scheme = F.when(c("p_partkey") % 19 == 0, "ftp://").when(c("p_partkey") % 2 == 0, "HTTP://").otherwise("https://")
    return t("part").select("p_partkey", ingest.url_refusal(F.concat(scheme, host, F.lit("/a.png"))).alias("refusal"))


@query("S15_fetched_image", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'type' END AS refusal, CASE WHEN page_id % 3 <> 0 THEN substring(sha256(html), 1, 16) || CASE WHEN page_id % 3 = 1 THEN '.png' ELSE '.jpg' END END AS name FROM pages")
def _(t):
    kind = F.when(c("page_id") % 3 == 0, "text/html").when(c("page_id") % 3 == 1, "Image/PNG; q=1").otherwise("image/jpeg")
    return t("pages").select("page_id", ingest.fetched_image(kind, c("html").cast("binary")).alias("f")).select("page_id", "f.refusal", "f.name")


@query("M11_mode_once", "SELECT user_id AS document_id, event_type AS mode, event_id::VARCHAR AS reason FROM events WHERE event_type IN ('view', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id::VARCHAR) = 1")
def _(t):
    kept = F.when(c("event_type").isin("view", "error"), c("event_type"))
    return ingest.mode_once(t("events").select(c("user_id").alias("document_id"), c("ts").alias("at"), kept.alias("mode"), c("event_id").cast("string").alias("reason")))


@query(
    "Z2_task_chain",
    """WITH d AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, 'process' AS step, 1 AS attempt, k % 5 <> 0 AS ok FROM d),
b AS (SELECT k, 'embed' AS step, n AS attempt, k % 4 < n AND k % 4 <> 3 AS ok FROM d, range(1, 4) AS r(n) WHERE k % 5 <> 0 AND n <= CASE WHEN k % 4 = 3 THEN 3 ELSE k % 4 + 1 END),
e AS (SELECT k, 'complete' AS step, 1 AS attempt, true AS ok FROM d WHERE k % 5 <> 0 AND k % 4 <> 3)
SELECT k AS document_id, step, attempt::INT AS attempt, ok FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e)""",
)
def _(t):
    tries = {"n": 0}

    def embed(left):
        tries["n"] += 1
        return left.withColumn("ok", (c("document_id") % 4 < tries["n"]) & (c("document_id") % 4 != 3))

    steps = [("process", lambda left: left.withColumn("ok", c("document_id") % 5 != 0), 0), ("embed", embed, 2), ("complete", lambda left: left.withColumn("ok", F.lit(True)), 0)]
    return ingest.run_chain(t("orders").select(c("o_orderkey").alias("document_id")), steps)


@query("Z3_latest_state", "SELECT user_id AS key, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS status, max(ts) AS at FROM events GROUP BY user_id")
def _(t):
    e = t("events").select(c("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), c("event_type").alias("status"))
    from ..streaming.jobs import latest_states

    return latest_states(e).select("key", "status", c("at.ts").alias("at"))
