"""Stages of ingestion and answering: chunk rows, prompt blocks, contexts, notes and rewrites of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing, text as x
from ..operators import relational as r, store
from .registry import also, query

c = F.col


@query("X20_chunk_defaults", r"SELECT conv_id, turn + 1 AS sequence_id, coalesce(role, 'text') AS chunk_type, floor(len(regexp_extract_all(coalesce(text, ''), '\S+')) * 13 / 10)::BIGINT AS token_count, NULL::INT AS page_start FROM conversations")
def _(t):
    body = F.coalesce("text", F.lit(""))
    return t("conversations").select("conv_id", (c("turn") + 1).alias("sequence_id"), F.coalesce("role", F.lit("text")).alias("chunk_type"), x.estimate_tokens(body).alias("token_count"), F.lit(None).cast("int").alias("page_start"))


@query("X37_needs_research", "SELECT p_partkey, [p_name, p_brand] AS queries FROM part")
def _(t):
    reply = F.concat(F.lit("NEEDS_RESEARCH: "), F.to_json(F.struct(F.array("p_name", "p_brand").alias("queries"))))
    return t("part").select("p_partkey", routing.needs_research(reply).alias("queries"))


@query(
    "X38_prompt_blocks",
    r"""SELECT conv_id, string_agg('  [[' || turn || ']] ' || substring(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 280), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id""",
)
def _(t):
    line = F.concat(F.lit("  [["), c("turn").cast("string"), F.lit("]] "), x.preview(c("text"), 280, ""))
    lines = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("block"))


@query(
    "X49_reveal_paragraphs",
    r"""WITH s AS (SELECT doc_id, text, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS s FROM documents),
b AS (SELECT *, list_filter(list_transform(string_split_regex(s, '\n\s*\n+'), lambda p : regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p : p <> '') AS blocks,
list_filter(list_transform(string_split(regexp_replace(s, '\n([A-Z0-9"''“‘(])', chr(1) || '\1', 'g'), chr(1)), lambda p : regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p : p <> '') AS again FROM s),
f AS (SELECT doc_id, text, s, CASE WHEN len(blocks) = 1 AND length(s) > 600 THEN again ELSE blocks END AS found FROM b)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] WHEN len(found) > 0 THEN found ELSE [s] END AS paragraphs FROM f""",
)
def _(t):
    return t("documents").select("doc_id", x.reveal_paragraphs(c("text")).alias("paragraphs"))


also("X49_reveal_paragraphs_whole", "X49_reveal_paragraphs")


@query("M5_finalise_note", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS content, CASE WHEN o_orderstatus IN ('left', 'right') THEN o_orderstatus ELSE 'right' END AS margin_side FROM orders")
def _(t):
    o = t("orders").select(c("o_orderkey").alias("id"), F.lit(1).alias("v"), F.lit("U").alias("op"), F.lit("").alias("content"), F.when(c("o_orderstatus").isin("left", "right"), c("o_orderstatus")).otherwise("right").alias("margin_side"))
    done = t("orders").where("o_orderstatus = 'O'").select(c("o_orderkey").alias("id"), F.lit(2).alias("v"), F.lit("U").alias("op"), c("o_orderpriority").alias("content"), F.lit(None).cast("string").alias("margin_side"))
    out = store.latest_with_kept(o.unionByName(done), ["id"], [c("v")], ["margin_side"])
    return out.select(c("id").alias("o_orderkey"), "content", "margin_side")


@query("M7_clean_slate", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM lineitem")
def _(t):
    k = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1).alias("version"))
    return store.replace_collection(k, k.where("l_orderkey % 3 = 0").withColumn("version", F.lit(2)), "l_orderkey")


@query("M12_append", "SELECT event_id, user_id FROM events UNION ALL SELECT event_id + 1000000, user_id FROM events WHERE event_type = 'signup'")
def _(t):
    e = t("events").select("event_id", "user_id")
    return e.union(t("events").where("event_type = 'signup'").select(c("event_id") + 1000000, "user_id"))


@query("M14_failed_rollback", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(t):
    failed = t("orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey"))
    known = t("orders").select(c("o_orderkey").alias("l_orderkey"))
    return store.cascade(t("lineitem").join(known, "l_orderkey", "left_semi"), failed, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("R14_local_context", "SELECT a.conv_id, a.turn, string_agg(b.text, chr(10) ORDER BY b.turn) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 WHERE a.role = 'user' GROUP BY a.conv_id, a.turn")
def _(t):
    v = t("conversations")
    near = r.band_join(v.where("role = 'user'"), v.select("conv_id", "turn", "text"), "conv_id", "turn", 2)
    lines = near.groupBy("conv_id", c("anchor_turn").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return lines.select("conv_id", "turn", F.array_join(F.transform("l", lambda e: e["text"]), "\n").alias("context"))


@query("S12_persisted_fields", "SELECT doc_id, source, n_chars FROM documents")
def _(t):
    return t("documents").select("doc_id", "source", "n_chars")
