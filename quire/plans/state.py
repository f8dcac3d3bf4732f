"""Sources, changes and job states on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as s
from ..scratch import new_folder
from ..sources import readers, spans
from ..sources.versions import VersionedTable, embeddings_of
from .registry import query

c = F.col


def _log(t):
    """Events as changes of a user's bookmark: errors delete, the rest set a value."""
    e = t("events")
    return e.select("event_id", "user_id", "ts", F.when(c("event_type") == "error", "D").otherwise("U").alias("op"), F.when(c("event_type") == "click", c("event_type")).alias("label"), "value")


LOG = "(SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CASE WHEN event_type = 'click' THEN event_type END AS label, value FROM events)"


@query("S7_page_batches", "SELECT p_partkey AS document_id, b AS first, least(b + 9, p_size - 1)::INT AS last FROM part, LATERAL (SELECT unnest(range(0, p_size, 10))::INT AS b) WHERE p_size > 10 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size <= 10")
def _(t):
    return readers.page_batches(t("part").select(c("p_partkey").alias("document_id"), c("p_size").alias("pages")), 10)


@query("S8_merge_batches", "SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 10 + l_linenumber * 10)::BIGINT AS page_idx FROM lineitem")
def _(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_linenumber") * 10).alias("start"), c("l_partkey").alias("block"), (c("l_partkey") % 10).alias("page_idx"))
    return readers.merge_batches(b).select("l_orderkey", "l_linenumber", "l_partkey", "page_idx")


@query("M1_upsert", f"SELECT user_id, event_id, value FROM {LOG} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op <> 'D'")
def _(t):
    return s.latest(_log(t), ["user_id"], c("ts"), c("event_id")).select("user_id", "event_id", "value")


@query(
    "M2_upsert_keeping",
    f"""WITH l AS (SELECT *, sum(CASE WHEN op = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM {LOG}),
k AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS kept FROM l)
SELECT user_id, kept AS label, value FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op <> 'D'""",
)
def _(t):
    return s.latest_with_kept(_log(t), ["user_id"], [c("ts"), c("event_id")], ["label"]).select("user_id", "label", "value")


@query("M3_upsert_by_keys", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    log = t("events").withColumn("op", F.lit("U"))
    return s.latest(log, ["user_id", "event_type"], c("ts"), c("event_id")).select("user_id", "event_type", "event_id")


@query("M4_partial_update", "SELECT c_custkey, coalesce(nullif(n_name, 'FRANCE'), c_mktsegment) AS v FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    patch = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", c("n_name").alias("v"))
    return s.partial_update(t("customer").select("c_custkey", c("c_mktsegment").alias("v")), patch, "c_custkey", {"v": c("v") != "FRANCE"})


@query("M6_replace_collection", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderpriority LIKE '1%'")
def _(t):
    o = t("orders")
    new = o.where(c("o_orderpriority").startswith("1")).select("o_custkey", "o_orderkey", F.lit("N").alias("o_orderstatus"))
    return s.replace_collection(o.select("o_custkey", "o_orderkey", "o_orderstatus"), new, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("M8_cascade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    gone = t("orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return s.cascade(t("lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("M8_set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")
def _(t):
    gone = t("customer").where("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return s.set_null(t("orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'chunking' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"


def _jobs(t):
    return t("events").select(c("user_id").alias("job"), "event_id", F.expr(STATUS).alias("status"))


@query("M9_job_states", f"SELECT job, arg_max(status, event_id) AS status, min(event_id) FILTER (status IN ('extracting', 'chunking', 'embedding')) AS started_at, max(event_id) FILTER (status IN ('complete', 'failed')) AS completed_at FROM (SELECT user_id AS job, event_id, {STATUS} AS status FROM events) GROUP BY job")
def _(t):
    return s.job_states(_jobs(t), "job", "event_id", "status")


@query("M9_transitions", f"WITH j AS (SELECT user_id AS job, event_id, {STATUS} AS status, lag({STATUS}) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT event_id, coalesce(CASE was WHEN 'queued' THEN status IN ('extracting', 'failed') WHEN 'extracting' THEN status IN ('chunking', 'failed') WHEN 'chunking' THEN status IN ('embedding', 'complete', 'failed') WHEN 'complete' THEN false WHEN 'failed' THEN status = 'queued' END, false) AS allowed FROM j")
def _(t):
    from pyspark.sql import Window as W

    j = _jobs(t).withColumn("was", F.lag("status").over(W.partitionBy("job").orderBy("event_id")))
    return j.select("event_id", s.can_transition(c("was"), c("status")).alias("allowed"))


@query("M10_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return s.pending(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("M13_tombstones", f"SELECT user_id, count(*) AS n FROM {LOG} WHERE op <> 'D' GROUP BY user_id")
def _(t):
    return _log(t).where("op <> 'D'").groupBy("user_id").agg(F.count("*").alias("n"))


@query("M13_deleted_keys", f"SELECT user_id, event_id FROM {LOG} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op = 'D'")
def _(t):
    return s.tombstones(_log(t), ["user_id"], c("ts"), c("event_id")).select("user_id", "event_id")


@query("M12_append_new", "WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) SELECT k, v FROM o UNION ALL SELECT l_orderkey, min(l_linenumber)::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM o) GROUP BY l_orderkey")
def _(t):
    known = t("orders").where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("v"))
    lines = t("lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").cast("string").alias("v"), "l_linenumber")
    return s.append_new(known.withColumn("l_linenumber", F.lit(None).cast(lines.schema["l_linenumber"].dataType)), lines, ["k"], c("l_linenumber")).select("k", "v")


def _versions(t, label: str, owner: str) -> VersionedTable:
    return VersionedTable(t.spark, new_folder(t.spark, label), owner)


@query(
    "M7_versioned_replace",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM lineitem WHERE l_orderkey % 7 <> 0 AND (l_orderkey % 3 <> 0 OR l_linenumber <= 2)",
)
def _(t):
    """A third of the orders get other lines, a seventh of them then go, and the log is compacted."""
    lines, table = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), _versions(t, "versions", "l_orderkey")
    table.replace_all(lines.withColumn("version", F.lit(1)))
    again = lines.where("l_orderkey % 3 = 0")
    table.change(again.where("l_linenumber <= 2").withColumn("version", F.lit(2)), again)
    gone = lines.where("l_orderkey % 7 = 0").withColumn("version", F.lit(3))
    table.change(gone.where("false"), gone)
    table.compact()
    return table.read()


@query("M14_restored_version", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    """A step deletes what failed; the next one goes wrong and the version before it is put back."""
    orders, table = t("orders").select("o_orderkey", "o_orderstatus"), _versions(t, "versions", "o_orderkey")
    table.replace_all(orders)
    failed = orders.where("o_orderstatus = 'P'")
    good = table.change(failed.where("false"), failed)
    table.change(orders.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("?")))
    table.restore(good)
    return table.read()


@query("R13_switched_model", "SELECT vec_id FROM embeddings WHERE NOT coalesce(label % 2 = 1, false)")
def _(t):
    """What waits for a model's vectors after a switch: vectors of another model and dimension stay and don't count."""
    path, v = new_folder(t.spark, "embeddings"), t("embeddings").select("vec_id", "label", "embedding")
    mine, other = embeddings_of(t.spark, path, "new/large", 64, "vec_id"), embeddings_of(t.spark, path, "old", 32, "vec_id")
    other.change(v.select("vec_id", F.slice("embedding", 1, 32).alias("embedding")))
    mine.change(v.where("label % 2 = 1").select("vec_id", "embedding"))
    return s.pending(v.select("vec_id"), mine.read(), ["vec_id"])


@query(
    "S5_page_lines",
    """SELECT conv_id::VARCHAR AS document_id, 0 AS page, turn::INT AS block, 0 AS line, role || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END || turn AS text, CASE WHEN role = 'user' THEN 12.0 ELSE 10.0 END::DOUBLE AS size, role = 'user' AS bold
FROM conversations""",
)
def _(t):
    """Conversations as pages that a PDF library dumped, written as JSON and read again: a block a turn, of two spans."""

    def span(text, left, right):
        user = c("role") == "user"
        return F.struct(text.alias("text"), F.when(user, 12.0).otherwise(10.0).alias("size"), F.lit("Serif").alias("font"), F.when(user, 16).otherwise(0).alias("flags"), F.array(left, F.lit(0.0), right, F.lit(9.0)).alias("bbox"))

    begin = F.when(c("turn") % 2 == 0, 105.0).otherwise(100.0)
    line = F.struct(F.array(F.lit(0.0), c("turn") * 10.0, F.lit(110.0), c("turn") * 10.0 + 9).alias("bbox"), F.array(span(c("role"), F.lit(0.0), F.lit(100.0)), span(c("turn").cast("string"), begin, begin + 5)).alias("spans"))
    block = F.struct(F.lit(0).alias("type"), F.array(line).alias("lines"))
    made = t("conversations").groupBy(c("conv_id").cast("string").alias("document_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda e: e["b"]).alias("blocks"))
    path = new_folder(t.spark, "pages")
    made.select("document_id", F.lit(0).alias("page"), F.lit(800.0).alias("height"), "blocks").write.json(path)
    return spans.page_lines(spans.pages(t.spark.read, path)).select("document_id", "page", "block", "line", "text", "size", "bold")
