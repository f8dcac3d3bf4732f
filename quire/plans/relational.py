"""Projections, joins, aggregates, sorts and windows on the driver's tables.

Orders and their lines stand for collections and members, conversations for documents and
chunks (or for threads), events for job logs and bookmarks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import asof, relational as r, threads, windows as w
from .registry import also, query

c = F.col

#: Lines with a place in their order that no two share.
LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos FROM lineitem)"


def lines(t):
    return w.renumber(t("lineitem"), "l_orderkey", c("l_linenumber"), c("l_partkey"), c("l_suppkey"), c("l_extendedprice"), name="pos")


@query("P1_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def _(t):
    return t("orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query("P2_composite_lookup", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def _(t):
    return t("conversations").where((c("conv_id") == 3) & (c("turn") == 1))


@query("P3_window_read", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 98 AND 102")
def _(t):
    return t("lineitem").where(c("l_orderkey").between(98, 102)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("P4_capped_range", "SELECT doc_id, source FROM documents WHERE doc_id BETWEEN 10 AND 90 ORDER BY doc_id LIMIT 40")
def _(t):
    return r.page(t("documents").where(c("doc_id").between(10, 90)).select("doc_id", "source"), [c("doc_id")], 40)


@query("P5_substring", "SELECT doc_id FROM documents WHERE text ILIKE '%ation%' OR source ILIKE '%ation%'")
def _(t):
    return t("documents").where(c("text").ilike("%ation%") | c("source").ilike("%ation%")).select("doc_id")


@query("P6_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return r.page(t("orders").select("o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey")], 25, 50)


@query("P7_keyset_neighbours", "SELECT conv_id, turn, lag(turn) OVER k AS prev_at, lead(turn) OVER k AS next_at FROM conversations WINDOW k AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    return r.neighbours(t("conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("P8_main_thread", "SELECT conv_id, turn FROM conversations WHERE CASE WHEN turn > 0 THEN turn - 1 END IS NULL")
def _(t):
    return t("conversations").withColumn("parent", F.when(c("turn") > 0, c("turn") - 1)).where("parent is null").select("conv_id", "turn")


@query("P9_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def _(t):
    keys = t("orders").where(c("o_orderpriority").startswith("1")).select(c("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(keys, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(
    "P10_neighbourhood_text",
    """SELECT a.conv_id, a.turn, substring(string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn), 1, 4000) AS context
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 AND b.role = 'user' GROUP BY a.conv_id, a.turn""",
)
def _(t):
    v = t("conversations")
    near = r.band_join(v, v.where("role = 'user'"), "conv_id", "turn", 2)
    texts = near.groupBy("conv_id", c("anchor_turn").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return texts.select("conv_id", "turn", F.substring(F.array_join(F.transform("x", lambda e: e["text"]), "\n\n"), 1, 4000).alias("context"))


@query("P11_heading_filter", "SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n_headings FROM pages WHERE len(regexp_extract_all(html, '<h[1-6][^>]*>')) >= 1")
def _(t):
    n = F.regexp_count("html", F.lit("<h[1-6][^>]*>")).cast("long")
    return t("pages").select("page_id", n.alias("n_headings")).where("n_headings >= 1")


@query(
    "P12_first_asset_url",
    f"SELECT o_orderkey, (SELECT '/static/images/' || arg_min(l_partkey, pos)::VARCHAR FROM {LINES} WHERE l_orderkey = o_orderkey) AS image_url FROM orders",
)
def _(t):
    first = lines(t).groupBy("l_orderkey").agg(F.min_by("l_partkey", "pos").alias("p"))
    return t("orders").join(first, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", F.concat(F.lit("/static/images/"), c("p").cast("string")).alias("image_url"))


@query("P13_defaults", "SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(n_chars, 0)::BIGINT AS n_chars, coalesce(source, '') AS source FROM documents")
def _(t):
    return t("documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("source", F.lit("")).alias("source"))


@query("P14_library", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY lower(p_name), p_partkey")
def _library(t):
    return t("part").where(F.lower("p_name").contains("a")).orderBy(F.lower("p_name"), "p_partkey").select("p_partkey", "p_name")


@query("P15_any_field", "SELECT c_custkey FROM customer WHERE contains(lower(coalesce(c_name, '')), '1') OR contains(lower(coalesce(c_mktsegment, '')), 'auto')")
def _(t):
    has = lambda f, x: F.lower(F.coalesce(f, F.lit(""))).contains(x)
    return t("customer").where(has("c_name", "1") | has("c_mktsegment", "auto")).select("c_custkey")


@query("P16_filename_filter", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'page=')")
def _(t):
    return t("pages").where(F.lower("url").contains("page=")).select("page_id", "url")


@query("P17_ownership", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 7)")
def _(t):
    own = t("customer").where("c_nationkey = 7").select(c("c_custkey").alias("o_custkey"))
    return t("orders").join(own, "o_custkey", "left_semi").select("o_orderkey")


# --- joins


@query("J1_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("J2_unembedded", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) ORDER BY doc_id LIMIT 200")
def _(t):
    return t("documents").join(t("embeddings"), c("doc_id") == c("vec_id"), "left_anti").select("doc_id").orderBy("doc_id").limit(200)


LATEST = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query("J3_latest_job", f"SELECT c_custkey, l.event_type AS status, l.event_id FROM customer LEFT JOIN ({LATEST}) l ON user_id = c_custkey")
def _(t):
    last = r.latest_per(t("events"), "user_id", c("ts").desc(), c("event_id").desc())
    return t("customer").join(last, c("c_custkey") == c("user_id"), "left").select("c_custkey", c("event_type").alias("status"), "event_id")


@query("J4_band", "SELECT a.conv_id, a.turn AS anchor_turn, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 3 WHERE a.role = 'assistant'")
def _(t):
    v = t("conversations")
    return r.band_join(v.where("role = 'assistant'"), v.select("conv_id", "turn"), "conv_id", "turn", 3).select("conv_id", "anchor_turn", "turn")


@query("J5_first_image", f"SELECT o_orderkey, (SELECT arg_min(l_suppkey, pos) FROM {LINES} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS first_supp FROM orders")
def _(t):
    first = lines(t).where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min_by("l_suppkey", "pos").alias("first_supp"))
    return t("orders").join(first, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "first_supp")


@query("J6_descriptions", "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY d.doc_id")
def _(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "source", "quality").orderBy("doc_id")


@query("J7_with_image", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t("documents").join(t("labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("J8_distinct_on", "SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) = 1")
def _(t):
    first = r.latest_per(t("lineitem"), "l_orderkey", c("l_partkey"), c("l_linenumber"))
    return first.join(t("orders"), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey")


@query(
    "J9_asset_links",
    """WITH k AS (SELECT p_partkey, unnest([p_brand || '.png', 'img' || p_size || '.jpg']) AS ref, unnest([0, 1]) AS place FROM part),
a AS (SELECT 'img' || (s_suppkey % 40 + 1) || '.jpg' AS original_name, min(s_suppkey) AS asset_id FROM supplier GROUP BY 1)
SELECT p_partkey, place, ref, asset_id FROM k JOIN a ON ref = original_name""",
)
def _(t):
    md = F.concat(F.lit("see ![a](out/images/"), "p_brand", F.lit(".png) and ![](img"), c("p_size").cast("string"), F.lit(".jpg)"))
    assets = t("supplier").select(c("s_suppkey").alias("asset_id"), F.concat(F.lit("img"), (c("s_suppkey") % 40 + 1).cast("string"), F.lit(".jpg")).alias("original_name"))
    return r.link_assets(t("part").select("p_partkey", x.image_refs(md).alias("image_refs")), assets, "p_partkey")


@query("J10_nested_members", f"SELECT o_orderkey, coalesce(list(l_partkey ORDER BY pos) FILTER (l_orderkey IS NOT NULL), []) AS members FROM orders LEFT JOIN {LINES} ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    of = lines(t).withColumnRenamed("l_orderkey", "o_orderkey")
    nested = r.nest(t("orders").select("o_orderkey"), of, "o_orderkey", "pos", ["l_partkey"], "m")
    return nested.select("o_orderkey", F.transform("m", lambda e: e["l_partkey"]).alias("members"))


TURNS = "(SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations)"


def turns(t):
    """Conversations as a tree in which each turn replies to the one before."""
    at = c("conv_id") * 1000 + c("turn")
    return t("conversations").select(at.alias("id"), "conv_id", "turn", "role", "text", F.when(c("turn") > 0, at - 1).alias("parent_id"))


@query("J11_first_reply", f"SELECT a.id, min(b.id) AS reply_id FROM {TURNS} a LEFT JOIN {TURNS} b ON a.conv_id = b.conv_id AND b.turn >= a.turn AND b.role = 'assistant' WHERE a.role = 'user' GROUP BY a.id")
def _(t):
    return threads.first_reply(turns(t), "conv_id", "turn")


@query("J12_to_reembed", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), c("c_custkey") == c("o_custkey")).select("c_custkey").distinct()


@query("J13_block_assets", "SELECT s_suppkey, min(l_orderkey) AS first_order FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def _(t):
    first = t("lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_order"))
    return t("supplier").join(first, c("l_suppkey") == c("s_suppkey"), "left").select("s_suppkey", "first_order")


@query("J14_rows_kept", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t):
    return t("documents").join(t("labels").where("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("J15_ticks", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1) AS tick FROM conversations")
def _(t):
    from pyspark.sql import Window as W

    of = W.partitionBy("conv_id")
    tick = (F.row_number().over(of.orderBy("turn")) - 1).cast("double") / F.greatest(F.count("*").over(of) - 1, F.lit(1))
    return t("conversations").select("conv_id", "turn", tick.alias("tick"))


@query("J16_deck_labels", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, 'Deck ' || s_nationkey::VARCHAR) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    own = F.when(c("n_regionkey") < 3, c("n_name"))
    return t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.coalesce(own, F.concat(F.lit("Deck "), c("s_nationkey").cast("string"))).alias("label"))


@query("J17_nearest", "SELECT conv_id, arg_min(turn, abs(turn * 100 - 250) * 1000 + turn) AS nearest FROM conversations GROUP BY conv_id")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.min_by("turn", F.struct(F.abs(c("turn") * 100 - 250), c("turn"))).alias("nearest"))


PURCHASES = "FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS b, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM events)"


def _purchases(t):
    e = t("events").select("user_id", "event_id", "event_type")
    return e.drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "event_id", "event_type")


@query("J17_at_or_before", f"SELECT user_id, event_id, coalesce(b, a) AS purchase {PURCHASES}")
def _(t):
    """For every event the user's last purchase up to it, or the first."""
    return asof.at_or_before(*_purchases(t), "user_id", "event_id", "event_type").select("user_id", "event_id", c("found.at").alias("purchase"))


@query("J17_nearest_of_two", f"SELECT user_id, event_id, CASE WHEN b IS NULL OR a - event_id < event_id - b THEN a ELSE b END AS purchase {PURCHASES}")
def _(t):
    return asof.nearest(*_purchases(t), "user_id", "event_id", "event_type").select("user_id", "event_id", c("found.at").alias("purchase"))


@query(
    "J17_orders_around_lines",
    """WITH r AS (SELECT o_custkey % 3 AS k, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'), l AS (SELECT l_suppkey % 3 AS k, l_orderkey * 8 + l_linenumber AS line FROM lineitem),
u AS (SELECT k, o_orderkey * 8 AS p, 0 AS side, o_orderkey AS o FROM r UNION ALL SELECT k, line, 1, NULL FROM l)
SELECT k, p AS line, last AS before, first AS after FROM (SELECT *, max(o) OVER (PARTITION BY k ORDER BY p, side ROWS UNBOUNDED PRECEDING) AS last, min(o) OVER (PARTITION BY k ORDER BY p DESC, side ROWS UNBOUNDED PRECEDING) AS first FROM u) WHERE side = 1""",
)
def _(t):
    """The orders before and after every line, under three keys of a third of the rows each."""
    right = t("orders").where("o_orderstatus <> 'O'").select((c("o_custkey") % 3).alias("k"), (c("o_orderkey") * 8).alias("line"), c("o_orderkey").alias("order"))
    left = t("lineitem").select((c("l_suppkey") % 3).alias("k"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("line"))
    return asof.around(left, right, "k", "line", "order").select("k", "line", c("before.value").alias("before"), c("after.value").alias("after"))


# --- aggregates


@query("A1_counts", "SELECT conv_id, count(*) AS n, (SELECT count(*) FROM conversations) AS total FROM conversations GROUP BY conv_id")
def _(t):
    v = t("conversations")
    return v.groupBy("conv_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(v.agg(F.count("*").alias("total"))))


@query("A2_bounds", "SELECT source, coalesce(min(doc_id), 0) AS lo, coalesce(max(doc_id), 0) AS hi FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("hi"))


GATE = """WITH d AS (SELECT p_partkey AS document_id, CASE WHEN p_size % 5 = 0 THEN 'book' ELSE 'paper' END AS doc_kind FROM part),
s AS (SELECT l_partkey AS document_id, sum(l_quantity)::BIGINT AS total FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT document_id, CASE WHEN doc_kind = 'book' THEN 'doc_kind=book' WHEN coalesce(total, 0) = 0 THEN 'no_token_count' WHEN total > 700 THEN 'too_large(' || total || '>700)' ELSE 'fits(' || total || '<=700)' END AS reason,
NOT (doc_kind = 'book' OR coalesce(total, 0) = 0 OR total > 700) AS skip FROM d LEFT JOIN s USING (document_id)"""


@query("A3_embedding_gate", GATE)
def _(t):
    d = t("part").select(c("p_partkey").alias("document_id"), F.when(c("p_size") % 5 == 0, "book").otherwise("paper").alias("doc_kind"))
    k = t("lineitem").where("l_quantity > 20").select(c("l_partkey").alias("document_id"), c("l_quantity").cast("long").alias("token_count"))
    return r.embedding_gate(k, d, 700)


@query(
    "A4_conversation_summary",
    "SELECT conv_id, count(*) AS n, min(turn) AS first_at, max(turn) AS last_at, arg_min(text, turn) FILTER (role = 'user') AS opening FROM conversations GROUP BY conv_id ORDER BY last_at DESC, conv_id",
)
def _(t):
    v = t("conversations")
    opening = F.min_by("text", F.when(c("role") == "user", c("turn")))
    return v.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first_at"), F.max("turn").alias("last_at"), opening.alias("opening")).orderBy(c("last_at").desc(), "conv_id")


@query("A5_since_compaction", "SELECT conv_id, count(*) FILTER (role = 'user' AND turn > coalesce(m, -1)) AS n FROM (SELECT *, max(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def _(t):
    v = t("conversations")
    last = v.where("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("m"))
    return v.join(last, "conv_id", "left").groupBy("conv_id").agg(F.count(F.when((c("role") == "user") & (c("turn") > F.coalesce("m", F.lit(-1))), 1)).alias("n"))


@query("A6_ordered_nest", f"SELECT l_orderkey, list(l_partkey ORDER BY pos) AS parts FROM {LINES} GROUP BY l_orderkey")
def _(t):
    x = F.array_sort(F.collect_list(F.struct("pos", "l_partkey")))
    return lines(t).groupBy("l_orderkey").agg(F.transform(x, lambda e: e["l_partkey"]).alias("parts"))


@query("A7_type_counts", "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")
def _(t):
    by = t("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return by.select("conv_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in ("user", "assistant")])


@query(
    "A8_chapter_level",
    "WITH k AS (SELECT l_orderkey, l_suppkey % 3 + 1 AS level, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, coalesce(min(level) FILTER (n >= 2), min(level)) AS chapter_level FROM k GROUP BY 1",
)
def _(t):
    return r.chapter_level(t("lineitem").select("l_orderkey", (c("l_suppkey") % 3 + 1).alias("level")), "l_orderkey", "level")


@query("A9_thin_groups", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) < 2")
def _(t):
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t("orders").join(n, c("o_orderkey") == c("l_orderkey"), "left").where(F.coalesce("n", F.lit(0)) < 2).select("o_orderkey")


SIDES = "(SELECT l_suppkey AS doc, (l_orderkey % 200)::BIGINT AS place, CASE WHEN l_linenumber % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM lineitem)"


def _notes(t):
    return t("lineitem").select(c("l_suppkey").alias("doc"), (c("l_orderkey") % 200).alias("place"), F.when(c("l_linenumber") % 3 == 0, "left").otherwise("right").alias("side"))


MARGIN = f"""SELECT a.doc, a.place, CASE WHEN count(*) FILTER (b.side = 'right') > count(*) FILTER (b.side = 'left') THEN 'left' ELSE 'right' END AS chosen
FROM (SELECT DISTINCT doc, place FROM {SIDES}) a JOIN {SIDES} b ON a.doc = b.doc AND abs(a.place - b.place) <= 6 GROUP BY a.doc, a.place"""


@query("A10_margin_side", MARGIN)
def _(t):
    return r.margin_side(_notes(t), "doc", "place", "side")


@query("A11_weighted_mode", "SELECT conv_id, arg_max(size, n * 100000 - size) AS body_size FROM (SELECT conv_id, length(role) AS size, sum(length(text)) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(t):
    by = t("conversations").groupBy("conv_id", F.length("role").cast("long").alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return by.groupBy("conv_id").agg(F.max_by("size", F.struct("n", -c("size"))).alias("body_size"))


@query("A12_stale_models", "SELECT DISTINCT lang FROM documents WHERE lang <> 'en'")
def _(t):
    return t("documents").select("lang").distinct().where("lang <> 'en'")


@query("A13_has_children", f"SELECT id, EXISTS (SELECT 1 FROM {TURNS} k WHERE k.parent_id = p.id) AS has_children FROM {TURNS} p")
def _(t):
    kids = turns(t).where("parent_id is not null").groupBy(c("parent_id").alias("id")).agg(F.lit(True).alias("k"))
    return turns(t).join(kids, "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("has_children"))


@query("A15_newest", "SELECT user_id, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS newest FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("A16_deck_anchor", "SELECT o_orderkey, coalesce(min(l_partkey), 0) AS anchor FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY o_orderkey")
def _(t):
    m = t("lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("m"))
    return t("orders").join(m, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", F.coalesce("m", F.lit(0)).alias("anchor"))


@query("A17_margin_side_roots", MARGIN.replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber < 3)"))
def _(t):
    n = t("lineitem").where("l_linenumber < 3")
    return r.margin_side(_notes(lambda _: n), "doc", "place", "side")


# --- windows

BLOCKS = f"(SELECT l_orderkey AS doc, pos, CASE WHEN l_suppkey % 4 > 0 THEN (l_suppkey % 4)::INT END AS level, 'h' || l_partkey::VARCHAR AS text FROM {LINES})"


def _blocks(t):
    level = F.when(c("l_suppkey") % 4 > 0, (c("l_suppkey") % 4).cast("int"))
    return lines(t).select(c("l_orderkey").alias("doc"), "pos", level.alias("level"), F.concat(F.lit("h"), c("l_partkey").cast("string")).alias("text"))


@query("W1_renumber", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)::INT AS sequence_id FROM lineitem")
def _(t):
    return w.renumber(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", c("l_partkey"), c("l_linenumber")).drop("l_partkey")


@query(
    "W2_heading_path",
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM {BLOCKS}),
f AS (SELECT doc, pos, n, CASE WHEN level IS NULL THEN []::VARCHAR[] ELSE [text] END AS heading_path FROM b WHERE n = 1
UNION ALL SELECT b.doc, b.pos, b.n, CASE WHEN b.level IS NULL THEN f.heading_path ELSE list_concat(f.heading_path[1:b.level - 1], [b.text]) END FROM f JOIN b ON b.doc = f.doc AND b.n = f.n + 1)
SELECT doc, pos, heading_path FROM f""",
)
def _(t):
    return w.heading_paths(_blocks(t), "doc", "pos", "level", "text", 3).select("doc", "pos", "heading_path")


@query(
    "W3_chapter_ranges",
    f"""WITH b AS {BLOCKS}, x AS (SELECT doc, min(pos) AS lo, max(pos) AS hi FROM b GROUP BY doc),
s AS (SELECT doc, text AS title, pos AS start, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM b WHERE level = 1),
r AS (SELECT doc, title, start, coalesce(nxt - 1, hi) AS "end" FROM s JOIN x USING (doc) UNION ALL SELECT doc, 'Front matter', lo, m - 1 FROM (SELECT doc, min(start) AS m FROM s GROUP BY doc) JOIN x USING (doc) WHERE m > lo)
SELECT doc, title, start, "end", (row_number() OVER (PARTITION BY doc ORDER BY start) - 1)::INT AS index, "end" - start + 1 AS chunk_count FROM r""",
)
def _(t):
    b = _blocks(t)
    starts = b.where("level = 1").select("doc", c("text").alias("title"), c("pos").alias("start"))
    return w.chapter_ranges(starts, b.groupBy("doc").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")), "doc")


@query(
    "W4_section_islands",
    f"""SELECT doc, pos, CASE WHEN n > 0 THEN n END AS section FROM (SELECT doc, pos, sum(s) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS n FROM (SELECT *,
CASE WHEN level = 1 OR (level = 2 AND NOT coalesce(bool_or(level = 1) OVER (PARTITION BY doc ORDER BY pos), false)) THEN 1 ELSE 0 END AS s FROM {BLOCKS}))""",
)
def _(t):
    return w.section_islands(_blocks(t), "doc", "pos", "level").select("doc", "pos", "section")


PAIRS = "SELECT conv_id, turn, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn) AS question_at FROM conversations a WHERE role = 'assistant'"


@query("W5_pairs", f"SELECT * FROM ({PAIRS}) WHERE question_at IS NOT NULL")
def _(t):
    return w.pair_with_question(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "question_at")


@query(
    "W6_history",
    """WITH m AS (SELECT *, max(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS comp FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM m WHERE comp IS NULL OR turn >= comp)
SELECT conv_id, turn, role, substring(text, 1, 600) AS text FROM k WHERE b <= 4 OR turn = comp""",
)
def _(t):
    return w.history_window(t("conversations"), "conv_id", "turn", 4, c("role") == "system", 600)


@query("W7_recent", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _(t):
    return w.recent(t("conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query(
    "W8_card_stack",
    f"""WITH RECURSIVE k AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS n, pos, (l_suppkey % 300)::BIGINT AS want, (l_partkey % 90 + 10)::BIGINT AS h FROM {LINES}),
f AS (SELECT doc, n, pos, want AS top, want + h + 8 AS cur FROM k WHERE n = 1 UNION ALL SELECT k.doc, k.n, k.pos, greatest(k.want, f.cur), greatest(k.want, f.cur) + k.h + 8 FROM f JOIN k ON k.doc = f.doc AND k.n = f.n + 1)
SELECT doc, pos, top FROM f""",
)
def _(t):
    k = lines(t).select(c("l_orderkey").alias("doc"), "pos", (c("l_suppkey") % 300).alias("want"), (c("l_partkey") % 90 + 10).alias("h"))
    return w.stack_cards(k, ["doc"], "pos", "want", "h", 8).select("doc", "pos", "top")


@query(
    "W9_inversions",
    f"SELECT doc, pos FROM (SELECT l_orderkey AS doc, pos, [l_suppkey % 5, l_partkey % 7] AS s, lag([l_suppkey % 5, l_partkey % 7]) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b FROM {LINES}) WHERE s < b",
)
def _(t):
    s = lines(t).select(c("l_orderkey").alias("doc"), "pos", F.array(c("l_suppkey") % 5, c("l_partkey") % 7).alias("s"))
    return w.section_inversions(s, "doc", "pos", "s").select("doc", "pos")


@query(
    "W10_claims",
    f"""WITH m AS (SELECT l_orderkey AS deck, pos, l_partkey AS member FROM {LINES}),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY member ORDER BY deck, pos) = 1),
s AS (SELECT *, count(*) OVER (PARTITION BY deck) AS n FROM k)
SELECT deck, member, (row_number() OVER (PARTITION BY deck ORDER BY pos) - 1)::INT AS ordinal FROM s WHERE n >= 2""",
)
def _(t):
    m = lines(t).select(c("l_orderkey").alias("deck"), "pos", c("l_partkey").alias("member"))
    return r.claim_first(m, "deck", "deck", "pos", "member").select("deck", "member", "ordinal")


@query("W12_page_batches", "SELECT l_orderkey, l_linenumber, ((dense_rank() OVER (PARTITION BY l_orderkey ORDER BY coalesce(nullif(l_linenumber, 2), 1)) - 1) // 2)::INT AS batch FROM lineitem")
def _(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber", F.nullif(c("l_linenumber"), F.lit(2)).alias("page"))
    return w.page_batches(b, "l_orderkey", "page", 2).select("l_orderkey", "l_linenumber", "batch")


# --- sorts, top-k, set operations


@query("T1_nulls_last", "SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer ORDER BY n NULLS LAST, c_custkey")
def _nulls_last(t):
    return t("customer").select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("n")).orderBy(c("n").asc_nulls_last(), "c_custkey")


@query("T3_note_order", "SELECT event_id, user_id FROM events ORDER BY user_id, ts, event_id")
def _note_order(t):
    return t("events").orderBy("user_id", "ts", "event_id").select("event_id", "user_id")


@query(
    "T4_rank_results",
    """SELECT url, CASE WHEN length(snippet) > 500 THEN substring(snippet, 1, 500) || '...' ELSE snippet END AS snippet, score FROM
(SELECT * FROM (SELECT url, html AS snippet, page_id AS position, (page_id % 17)::DOUBLE AS score FROM pages) WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) = 1) ORDER BY score DESC, position LIMIT 10""",
)
def _(t):
    p = t("pages").select("url", c("html").alias("snippet"), c("page_id").alias("position"), (c("page_id") % 17).cast("double").alias("score"))
    return r.keep_first_by_url(p, 10).select("url", "snippet", "score")


@query("T5_two_legs", "SELECT doc_id, min(leg) AS leg FROM (SELECT doc_id, 0 AS leg FROM documents WHERE text LIKE '%tion%' UNION ALL SELECT doc_id, 1 FROM documents WHERE text LIKE '%ing%') GROUP BY doc_id ORDER BY doc_id LIMIT 50")
def _(t):
    d = t("documents")
    legs = d.where(c("text").contains("tion")).select("doc_id", F.lit(0).alias("leg")).union(d.where(c("text").contains("ing")).select("doc_id", F.lit(1).alias("leg")))
    return legs.groupBy("doc_id").agg(F.min("leg").alias("leg")).orderBy("doc_id").limit(50)


@query("T7_union_count", "SELECT count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    x = t("labels")
    return x.where("quality = 1").select("doc_id").union(x.where("toxic = 1").select("doc_id")).distinct().agg(F.count("*").alias("n"))


@query(
    "T8_merge_order",
    f"""WITH a AS (SELECT l_orderkey, list(l_partkey % 7 ORDER BY pos) FILTER (pos % 2 = 0) AS p, list(l_partkey % 7 ORDER BY pos) AS k FROM {LINES} GROUP BY 1),
u AS (SELECT l_orderkey, coalesce(p, []) AS p, list_sort(list_distinct(list_filter(k, lambda x : NOT list_contains(coalesce(p, []), x)))) AS rest FROM a)
SELECT l_orderkey, list_concat(list_filter(p, lambda x, i : list_position(p, x) = i), rest) AS merged FROM u""",
)
def _(t):
    x = F.array_sort(F.collect_list(F.struct("pos", (c("l_partkey") % 7).alias("v"))))
    k = lines(t).groupBy("l_orderkey").agg(x.alias("x"))
    proposed = F.transform(F.filter("x", lambda e: e["pos"] % 2 == 0), lambda e: e["v"])
    return k.select("l_orderkey", r.merge_order(proposed, F.transform("x", lambda e: e["v"])).alias("merged"))


@query(
    "T9_model_catalog",
    "SELECT p_name AS name, cloud FROM (SELECT p_name, p_partkey, (p_name ILIKE '%a' OR p_size = 1) AS cloud FROM part WHERE NOT contains(lower(p_name), 'e')) ORDER BY cloud, lower(p_name), p_partkey",
)
def _model_catalog(t):
    m = t("part").where(~F.lower("p_name").contains("e")).withColumn("cloud", F.lower("p_name").endswith("a") | (c("p_size") == 1))
    return m.orderBy("cloud", F.lower("p_name"), "p_partkey").select(c("p_name").alias("name"), "cloud")


@query("T10_turn_order", "SELECT conv_id, max(turn) AS last_at FROM conversations GROUP BY conv_id ORDER BY last_at DESC, conv_id LIMIT 20")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.max("turn").alias("last_at")).orderBy(c("last_at").desc(), "conv_id").limit(20)


@query("T11_image_dedup", "SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(p_brand, 'Brand#11'), p_type) ORDER BY p_partkey) = 1 ORDER BY p_partkey LIMIT 6")
def _(t):
    k = t("part").withColumn("k", F.coalesce(F.nullif(c("p_brand"), F.lit("Brand#11")), c("p_type")))
    return r.latest_per(k, "k", c("p_partkey")).orderBy("p_partkey").limit(6).select("p_partkey")


@query("T12_marginalia", "SELECT 'ai' AS tone, doc_id AS seq FROM labels WHERE quality = 1 UNION ALL SELECT 'own', doc_id FROM labels WHERE toxic = 1 ORDER BY seq, tone")
def _(t):
    x = t("labels")
    ai = x.where("quality = 1").select(F.lit("ai").alias("tone"), c("doc_id").alias("seq"))
    return ai.unionByName(x.where("toxic = 1").select(F.lit("own").alias("tone"), c("doc_id").alias("seq"))).orderBy("seq", "tone")


# --- trees


@query("G1_depth", f"SELECT id, turn AS depth FROM {TURNS}")
def _(t):
    return threads.ancestor_depth(turns(t)).select("id", c("depth").cast("long").alias("depth"))


SUBTREE = f"""WITH RECURSIVE t AS {TURNS}, s AS (SELECT id AS root, id FROM t WHERE turn IN (0, 2) UNION SELECT t.id, (SELECT min(b.id) FROM t b WHERE b.conv_id = t.conv_id AND b.turn >= t.turn AND b.role = 'assistant') FROM t WHERE turn = 0 AND role = 'user'),
w AS (SELECT root, id FROM s WHERE id IS NOT NULL UNION SELECT w.root, t.id FROM w JOIN t ON t.parent_id = w.id)"""


@query("G2_subtree", SUBTREE + " SELECT root, id FROM w")
def _(t):
    k = turns(t)
    return threads.thread_subtree(k, "conv_id", "turn", k.where("turn in (0, 2)"))


@query("G3_subtree_count", SUBTREE + " SELECT root, count(*) AS n FROM w GROUP BY root")
def _(t):
    k = turns(t)
    return threads.thread_subtree(k, "conv_id", "turn", k.where("turn in (0, 2)")).groupBy("root").agg(F.count("*").alias("n"))


@query("G4_note_thread", f"SELECT r.id AS root, d.id, (d.turn - r.turn)::BIGINT AS depth FROM {TURNS} r JOIN {TURNS} d ON r.conv_id = d.conv_id AND d.turn >= r.turn WHERE r.turn = 1")
def _(t):
    k = turns(t)
    return threads.descendants(k, k.where("turn = 1"))


@query("G5_root_of_each", f"SELECT id, conv_id * 1000 AS root FROM {TURNS}")
def _(t):
    return threads.root_of_each(turns(t))


@query("G6_depth_cap", f"SELECT id, turn + 1 <= 3 AS allowed FROM {TURNS}")
def _(t):
    return threads.may_reply(turns(t))


for _name in ("P14_library", "T1_nulls_last", "T3_note_order", "T9_model_catalog"):
    also(f"{_name}_whole", _name)
