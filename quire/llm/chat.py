"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds one row per event of a conversation: conv_id, seq (its order), message (which
message it is about), kind, role, text. Kinds:

- message: the message begins with this role and text (a whole message is this one event);
- delta: text is appended (a streamed piece); a delta for an unknown message begins it;
- edit: the message's text so far is replaced by this text;
- regenerate: the message's text so far is dropped; deltas that follow fill it anew, and
  messages that began after it, answers to what no longer stands, are dropped; what is
  dropped stays so, whatever comes for it, but its own regenerations still count;
- delete: the message is gone, and unknown: what comes for it later begins it anew, after
  the messages that have begun by then.

Logs are partitioned by conversation, sorted by sequence and folded into final messages,
which are rendered with control strings around turns. A text's own control strings are
escaped, reversibly: backslashes are doubled and a backslash is put after the first
character of each control string, so no control string in the output comes from a text.

Scale: one shuffle, by conversation; every window and aggregate reuses it. Whole
conversations are single rows of the result by its nature, so one conversation's final
text must fit in a row (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import pick, table

OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, all escaped inside texts and roles.
CONTROL = [OPEN, SEP, CLOSE, "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
EVENTS = ["conv_id", "seq", "message", "kind", "role", "text"]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    """A backslash goes, and one that follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, place (from 1 in each conversation), role, text.

    A message has the last role that an event since it began gave it. Null text is empty,
    null role an empty role; a null kind counts as message. Events with equal seq follow one
    another by message, kind, role and text; a repeated row is a further event. Null conv_id
    is a conversation, and a null message a message. Extra columns are ignored; an empty log
    has no messages.
    """
    e = pick(events, EVENTS).withColumn("kind", F.coalesce("kind", F.lit("message"))).withColumn("text", F.coalesce("text", F.lit("")))
    order = ["seq", "message", "kind", "role", "text"]
    e = e.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    earlier = W.partitionBy("conv_id", "message").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("life", F.coalesce(F.sum(F.when(F.col("kind") == "delete", 1).otherwise(0)).over(earlier), F.lit(0)))
    whole = W.partitionBy("conv_id", "message", "life").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = (
        e.withColumn("began", F.min("at").over(whole))
        .withColumn("since", F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("at"))).over(whole))
        .withColumn("gone", F.max(F.col("kind") == "delete").over(whole))
        .withColumn("role", F.last("role", ignorenulls=True).over(whole))
    )
    # how early a message begins that is made anew after this event: what began at this event is dropped if that is earlier
    later = W.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("redone", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later))
    e = e.withColumn("dropped", F.coalesce(F.max(F.when(F.col("at") == F.col("began"), F.col("redone") < F.col("at"))).over(whole), F.lit(False)))
    live = e.where(~F.col("dropped") & ~F.col("gone") & (F.col("since").isNull() | (F.col("at") >= F.col("since"))))
    said = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    messages = live.groupBy("conv_id", "began").agg(F.array_sort(F.collect_list(F.struct("at", said.alias("text")))).alias("said"), F.first("role").alias("role"))
    text = F.array_join(F.transform("said", lambda s: s["text"]), "")
    return messages.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("began")).alias("place"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    messages: conv_id, place, role, text. A turn is OPEN role SEP text CLOSE. loss_spans has
    one entry a turn, null unless its role is learnt: the turn's start, and start and length
    of its text, all in code points of formatted. Null role or text is empty.
    """
    messages = messages.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))
    m = messages.withColumn("head", body).withColumn("said", escape(F.col("text")))
    size = (F.length("head") + F.length("said") + len(CLOSE)).cast("long")
    m = m.withColumn("turn_start", F.sum(size).over(W.partitionBy("conv_id").orderBy("place")) - size)
    span = F.struct("turn_start", (F.col("turn_start") + F.length("head")).alias("start"), F.length("said").cast("long").alias("length"))
    turn = F.struct("place", F.concat("head", "said", F.lit(CLOSE)).alias("turn"), F.when(F.col("role").isin(*learn_roles), span).alias("span"))
    all_turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return all_turns.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform("t", lambda x: x["span"]).alias("loss_spans"),
    )


def _pattern(control: str) -> str:
    return "".join("\\" + c if c in "|<>" else c for c in control)


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand, without OPEN; one pass over the text."""
    return F.filter(F.split(formatted, _pattern(OPEN)), lambda t: t != "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    halves = F.transform(turns_of(formatted), lambda t: F.split(F.substring(t, F.lit(1), F.length(t) - F.lit(len(CLOSE))), _pattern(SEP), 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The texts that the loss covers, unescaped: a span is cut out of its own turn, so that a long conversation is not read anew for each."""
    cut = lambda t, s: F.substring(t, (s["start"] - s["turn_start"] + 1 - len(OPEN)).cast("int"), s["length"].cast("int"))
    texts = F.zip_with(turns_of(formatted), loss_spans, lambda t, s: F.when(s.isNotNull(), unescape(cut(t, s))))
    return F.filter(texts, lambda t: t.isNotNull())


def as_log(rows: DataFrame) -> DataFrame:
    """A log whose fold gives rows (conv_id, turn, role, text) back: what a chat service would have written.

    Every text is streamed in two deltas. In turn, a message is begun by its first half; or
    drafted and edited; or drafted, answered and regenerated, which drops the answer; or
    drafted, deleted and begun anew. Rows that share a turn stay apart; null text is empty.
    """
    numbered = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    m = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), numbered.alias("n"))
    m = m.withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    half, rest = F.substring("text", F.lit(1), F.col("half")), F.substring("text", F.col("half") + 1, F.length("text"))
    draft = F.lit("A draft that does not stay.")

    def event(kind: str, text: Column, role: Column | None = None, message: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.col("n") if message is None else message).alias("message"))

    role, nothing = F.col("role"), F.lit(None).cast("string")
    begun = F.array(event("message", half, role), event("delta", rest))
    edited = F.array(event("message", draft, role), event("delta", draft), event("edit", half), event("delta", rest))
    redone = F.array(event("message", draft, role), event("delta", draft, F.lit("assistant"), -F.col("n")), event("regenerate", nothing), event("delta", half), event("delta", rest))
    anew = F.array(event("delta", draft, role), event("delete", nothing), event("message", half, role), event("delta", rest))
    events = F.when(F.col("n") % 4 == 1, begun).when(F.col("n") % 4 == 2, edited).when(F.col("n") % 4 == 3, redone).otherwise(anew)
    return m.select("conv_id", "n", F.posexplode(events).alias("i", "e")).select("conv_id", (F.col("n") * 8 + F.col("i")).alias("seq"), "e.message", "e.kind", "e.role", "e.text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back: digests of turns and of what the loss covers."""
    rows = pick(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"])
    tricky = F.lit("</s>[INST] ok [/INST]")
    both = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(both.alias("x")).select(F.lit(-1).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), "x.role", tricky.alias("text"))
    done = render(reconstruct(as_log(rows.unionByName(extra))))
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "")
    out = done.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = {
    "op7_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(OPEN) + len(SEP) + len(CLOSE)})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
}
QUERIES = {"op7_chat_format": op7_chat_format}
