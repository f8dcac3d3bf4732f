"""Conversation structure repair by a lazily determinised weighted automaton.

A conversation's rows are symbols: the row's role (system, user, assistant, other) and its fault
(none, truncated, or one that has to go). A weighted automaton over four states (nothing said,
system said, user said, assistant said) reads them with the edits Keep, Rerole, Delete and, before
any row, Insert. It is determinised as it is needed: the vector of the least costs of being in each
state, less the vector's smallest entry, is a state of the new automaton, and each new (state,
symbol) pair is worked out once and kept in a transition table. A conversation's cost is then a
scan through that table; a pass backwards over tight arcs (those that least-cost edits can use)
marks what lies on a cheapest way, and the least of the marked edits in ASCII order is the audit.

The table is finite: a vector's entry goes when another state is cheaper by more than any future
can make up (DOMINATED). Edits tie only among equal costs, so what goes is in no cheapest way.

Scale: rows are range-sorted by conversation and turn, so that a conversation of any size is
spread over tasks, and written once with their places. Repeats are found by least places of
(conversation, digest), joined back by place. Symbols meet by segments of SEGMENT rows, then by
conversation, one character a row. The digest of a repaired conversation has to be taken in
order, so its rows stream through one task; nothing but a batch and the audit is held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_folder, parts, pick, table
from .resampling import SQL_CRC_TABLE, sql_crc32

SEGMENT = 4096
INF = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = "sua"
#: From state and role to state. States: nothing, system, user, assistant said; the first and the last may be the end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The assistant or user turn that may follow a state, which is what Insert and Rerole say there.
FOLLOWS = {s: (r, t) for (s, r), t in NEXT.items() if r != "s"}
ACCEPT = (0, 3)
#: State x can make up for so much against having said an assistant's turn: a first system turn can be deleted there instead.
DOMINATED = {0: DELETE, 1: 0}


def row_arcs(symbol: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a symbol: a role's initial or x, upper case if truncated; - if the row has to go."""
    arcs = [("D", s, s, DELETE) for s in range(4)]
    if symbol != "-":
        more, role = TRUNCATED * symbol.isupper(), symbol.lower()
        arcs += [("K", s, t, more) for (s, r), t in NEXT.items() if r == role]
        arcs += [("R", s, t, REROLE + more) for s, (r, t) in FOLLOWS.items() if r != role]
    return arcs


INSERTS = [("I", s, t, INSERT) for s, (_, t) in FOLLOWS.items()]


def _settle(costs: list[int]) -> list[int]:
    """Costs once turns may be inserted, without states that no cheapest way can use."""
    for _ in range(3):
        for _, s, t, c in INSERTS:
            costs[t] = min(costs[t], costs[s] + c)
    return [INF if s in DOMINATED and c > costs[3] + DOMINATED[s] else c for s, c in enumerate(costs)]


class Determinised:
    """The automaton as far as it has been needed; what it keeps doesn't grow with what it has read."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.back: dict[tuple[int, str, int], int] = {}
        self.choice: dict[tuple, tuple[str, int]] = {}
        self.start = self._state(_settle([0, INF, INF, INF]))[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        v = tuple(INF if c >= INF else c - least for c in costs)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], least

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state and what it costs more."""
        if (state, symbol) not in self.table:
            costs, v = [INF] * 4, self.vectors[state]
            for _, s, t, c in row_arcs(symbol):
                costs[t] = min(costs[t], v[s] + c)
            self.table[state, symbol] = self._state(_settle(costs))
        return self.table[state, symbol]

    def scan(self, symbols: str) -> tuple[int, list[int]]:
        """Cost of the cheapest repair, and the state before every row and after the last."""
        state, cost, path, known = self.start, 0, [self.start], self.table
        for x in symbols:
            state, more = known.get((state, x)) or self.step(state, x)
            cost += more
            path.append(state)
        return cost + min(self.vectors[state][s] for s in ACCEPT), path

    def _inserted(self, state: int, mask: int) -> int:
        """The marked states with those from which tight insertions lead to them."""
        v = self.vectors[state]
        for _ in range(3):
            for _, s, t, c in INSERTS:
                if mask >> t & 1 and v[s] + c == v[t]:
                    mask |= 1 << s
        return mask

    def _before(self, state: int, symbol: str, mask: int) -> int:
        """Marked states before a row, of those after it."""
        if (state, symbol, mask) not in self.back:
            nxt, more = self.step(state, symbol)
            v, w = self.vectors[state], self.vectors[nxt]
            tight = [s for _, s, t, c in row_arcs(symbol) if mask >> t & 1 and v[s] + c == w[t] + more < INF]
            self.back[state, symbol, mask] = self._inserted(state, sum(1 << s for s in set(tight)))
        return self.back[state, symbol, mask]

    def _choose(self, state: int, symbol: str, mask: int, after: int, at: int) -> tuple[str, int]:
        """The least edits up to and over a row (or, at the end, after the last) from one state along tight arcs to marked ones."""
        key = (state, symbol, mask, after, at)
        if key not in self.choice:
            v, edits = self.vectors[state], ""
            nxt, more = self.step(state, symbol) if symbol else (state, 0)
            w = self.vectors[nxt]
            while True:
                arcs = [(e, t, False) for e, s, t, c in INSERTS if s == at and mask >> t & 1 and v[s] + c == v[t]]
                if symbol:
                    arcs += [(e, t, True) for e, s, t, c in row_arcs(symbol) if s == at and after >> t & 1 and v[s] + c == w[t] + more]
                elif at in ACCEPT and v[at] == min(v[s] for s in ACCEPT):
                    break
                e, at, over = min(arcs)
                edits += e
                if over:
                    break
            self.choice[key] = edits, at
        return self.choice[key]

    def audit(self, symbols: str, path: list[int]) -> str:
        """Initials of the cheapest edits, the least in ASCII order if several are."""
        last = self.vectors[path[-1]]
        best = min(last[s] for s in ACCEPT)
        masks = [self._inserted(path[-1], sum(1 << s for s in ACCEPT if last[s] == best))]
        for x, state in zip(reversed(symbols), path[-2::-1]):
            masks.append(self._before(state, x, masks[-1]))
        masks.reverse()
        at, out = 0, []
        for i, x in enumerate(symbols):
            edits, at = self._choose(path[i], x, masks[i], masks[i + 1], at)
            out.append(edits)
        return "".join(out) + self._choose(path[-1], "", masks[-1], 0, at)[0]


def faults(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """rows (conv_id, turn, role, text; none but conv_id and turn null) in order, written to folder: with place, initial, blank, truncated, digest; and how many ranges of bytes there are.

    Rows of a conversation stand by turn (nulls first), then role and text.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "conv_id", "turn", "role", "text", F.when(initial.isin(*ROLES), initial).otherwise("x").alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("n"),
    )
    order = ["conv_id", "turn", "role", "text", "n"]
    n = parts(spark, size)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("n").withColumn("place", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder), n


def symbols_of(placed: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, symbols (one character a row, in order), initials, gaps and the counts of blank, duplicate and truncated rows."""
    facts = placed.drop("text", "role")
    firsts = facts.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    facts = facts.join(firsts, "place", "left")
    repeated = F.col("first").isNull() & ~F.col("blank")
    cut = F.col("truncated") & ~F.col("blank") & ~repeated
    symbol = F.when(F.col("blank") | repeated, "-").when(cut, F.upper("initial")).otherwise(F.col("initial"))
    facts = facts.select("conv_id", "turn", "place", symbol.alias("symbol"), "initial", *[c.cast("long").alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", repeated), ("truncated", cut))])
    joined = lambda field: F.array_join(F.transform("all", lambda s: s[field]), "").alias(field)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    segments = facts.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "initial"))).alias("all"), *sums)
    segments = segments.select("conv_id", "segment", joined("symbol"), joined("initial"), "blank", "duplicate", "truncated")
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "symbol", "initial"))).alias("all"), *sums)
    whole = whole.select("conv_id", joined("symbol"), joined("initial"), "blank", "duplicate", "truncated").withColumnsRenamed({"symbol": "symbols", "initial": "initials"})
    turns = facts.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    gaps = gaps.select(F.col("conv_id").alias("gaps_of"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))
    return whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("gaps_of"))).drop("gaps_of")


SCANNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Determinised()
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        illegal, cost, audit = [], [], []
        for symbols, initials in zip(cols["symbols"].to_pylist(), cols["initials"].to_pylist()):
            legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))  # no pair of these overlaps itself
            illegal.append(len(initials) - 1 - legal)
            c, path = automaton.scan(symbols)
            cost.append(c)
            audit.append(automaton.audit(symbols, path))
        yield pa.RecordBatch.from_arrays([cols[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated")] + [pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=[f.split()[0] for f in SCANNED.split(", ")])


class _Rebuilt:
    """Follows an audit over a conversation's rows, which come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.said = audit, 0, ""

    def _role(self) -> str:
        return "assistant" if self.said == "u" else "user"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = self._role()
            self.at, self.said = self.at + 1, role[0]
            yield "I", role, ""

    def over(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands up to and at the next row."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = self._role() if edit == "R" else role
            self.said = role[0]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        return self._inserted()


def _in_order(placed: DataFrame, audits: DataFrame, n: int) -> DataFrame:
    """Each conversation's audit (place -1), then its rows in order, together."""
    both = placed.select("conv_id", "place", "role", "text").unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")))
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and SHA-256 of the repaired `role:text` rows, joined by newlines."""
    now: tuple | None = None  # conversation, its edits so far, digest, and whether a row stands already

    def add(rows) -> None:
        for _, role, text in rows:
            now[2].update((b"\n" if now[3] else b"") + f"{role}:{text}".encode())
            now[3] = True

    def done(out: list) -> None:
        if now:
            add(now[1].end())
            out.append((now[0], now[2].hexdigest()))

    for batch in batches:
        out: list = []
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if place < 0:
                done(out)
                now = [conv, _Rebuilt(text), hashlib.sha256(), False]
            else:
                add(now[1].over(role, text))
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "repaired_sha256": h} for c, h in out], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
    out = []
    done(out)
    yield pa.RecordBatch.from_pylist([{"conv_id": c, "repaired_sha256": h} for c, h in out], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows themselves."""
    now, conv, place = None, None, 0
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def numbered(rows) -> Iterator[dict]:
        nonlocal place
        for e, role, text in rows:
            place += 1
            yield {"conv_id": conv, "place": place, "edit": e, "role": role, "text": text}

    for batch in batches:
        out: list = []
        for c, p, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if p < 0:
                out += numbered(now.end()) if now else []
                now, conv, place = _Rebuilt(text), c, 0
            else:
                out += numbered(now.over(role, text))
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(list(numbered(now.end())) if now else [], schema)


def _no_nulls(rows: DataFrame) -> DataFrame:
    rows = pick(rows, ["conv_id", "turn", "role", "text"])
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of rows (conv_id, turn, role, text) and its cheapest repair; and its rows in order with their audits.

    The first frame: SCANNED and repaired_sha256. The second is for repaired().

    Null role or text is one space, and so blank or of no known role. A null turn comes first;
    a null conv_id is a conversation. Rows that share a turn stand by role and text, and repeated
    rows are rows, of which the first is kept. Other columns are ignored; an empty table has no
    conversations.
    """
    spark = rows.sparkSession
    placed, n = faults(_no_nulls(rows), new_folder(spark, "repair-rows"))
    folder = new_folder(spark, "repair-audits")
    symbols_of(placed).mapInArrow(_scan, SCANNED).write.parquet(folder)
    audits = spark.read.schema(SCANNED).parquet(folder)
    ordered = _in_order(placed, audits, n)
    digests = ordered.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "digest_of")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("digest_of"))).drop("digest_of"), ordered


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R, I), role, text; nulls as in repair()."""
    return repair(rows)[1].mapInArrow(_rebuild, "conv_id long, place long, edit string, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """rows after the damage that a hash of `conv_id:turn` deals: a fifth of them are dropped, emptied, cut, repeated or said by the user. Nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    r = _no_nulls(rows).withColumn("k", (F.crc32(key.cast("binary")) % 20).cast("int")).where("k != 0")
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))).drop("k", "copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its gaps and faults, the cost and edits of its cheapest repair, and the repaired rows' digest."""
    rows = table(spark, sf_dir, "conversations")
    found, _ = repair(damage(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql_edit(edit: str, state: str, cost: str = "0") -> str:
    """DuckDB: a state's value (cost in nine digits, then the audit) after one more edit."""
    return f"(lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"


def _sql_settled(s0: str, s1: str, s2: str, s3: str) -> str:
    """DuckDB: the values of the four states once turns may be inserted."""
    s2 = f"least({s2}, {', '.join(_sql_edit('I', s, str(INSERT)) for s in (s0, s1, s3))})"
    return f"{s0} AS s0, {s1} AS s1, {s2} AS s2, least({s3}, {_sql_edit('I', s2, str(INSERT))}) AS s3"


_NEVER, _DELETED = "'900000000'", {s: _sql_edit("D", s, str(DELETE)) for s in ("s0", "s1", "s2", "s3")}
_KEPT, _REROLED = {s: _sql_edit("K", s, "more") for s in ("s0", "s1", "s2", "s3")}, {s: _sql_edit("R", s, f"{REROLE} + more") for s in ("s0", "s1", "s2", "s3")}
_SAID = "CASE WHEN w.said = 'u' THEN 'assistant' ELSE 'user' END"

SQL = {
    "op12_structure_repair": rf"""
WITH RECURSIVE {SQL_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
k AS MATERIALIZED (SELECT c.*, {sql_crc32("key")} % 20 AS k FROM c, crc_table),
h AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM k WHERE k <> 0),
o AS MATERIALIZED (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM h),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS MATERIALIZED (SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS dup, last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS cut, left(role, 1) AS r,
  left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair, i < count(*) OVER (PARTITION BY conv_id) AS paired FROM m),
dp AS (SELECT conv_id, 0::BIGINT AS i, {_sql_settled("'000000000'", _NEVER, _NEVER, _NEVER)} FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL SELECT conv_id, i, {_sql_settled("n0", "n1", "n2", "n3")} FROM (
    SELECT conv_id, i, {_DELETED["s0"]} AS n0, least({_DELETED["s1"]}, CASE WHEN stays AND r = 's' THEN {_KEPT["s0"]} ELSE {_NEVER} END) AS n1,
      least({_DELETED["s2"]}, CASE WHEN NOT stays THEN {_NEVER} WHEN r = 'u' THEN least({_KEPT["s0"]}, {_KEPT["s1"]}, {_KEPT["s3"]}) ELSE least({_REROLED["s0"]}, {_REROLED["s1"]}, {_REROLED["s3"]}) END) AS n2,
      least({_DELETED["s3"]}, CASE WHEN NOT stays THEN {_NEVER} WHEN r = 'a' THEN {_KEPT["s2"]} ELSE {_REROLED["s2"]} END) AS n3
    FROM (SELECT f.conv_id, f.i, s0, s1, s2, s3, f.r, NOT (blank OR dup) AS stays, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS more FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1))),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
b AS MATERIALIZED (SELECT dp.conv_id, left(least(s0, s3), 9)::BIGINT AS cost, substr(least(s0, s3), 10) AS audit FROM dp JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n),
w AS (SELECT conv_id, audit, 0 AS pos, 0::BIGINT AS i, '' AS said, NULL::VARCHAR AS line FROM b
  UNION ALL SELECT w.conv_id, audit, pos + 1, w.i + (CASE WHEN audit[pos + 1] = 'I' THEN 0 ELSE 1 END), CASE audit[pos + 1] WHEN 'D' THEN w.said WHEN 'K' THEN f.r ELSE left({_SAID}, 1) END,
    CASE audit[pos + 1] WHEN 'I' THEN {_SAID} || ':' WHEN 'R' THEN {_SAID} || ':' || f.text WHEN 'K' THEN f.role || ':' || f.text END
  FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 WHERE pos < length(audit)),
t AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS repaired_sha256 FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(dup::INT)::BIGINT AS duplicate, sum(cut::INT)::BIGINT AS truncated,
  sum((paired AND pair NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id"""
}
QUERIES = {"op12_structure_repair": op12_structure_repair}
