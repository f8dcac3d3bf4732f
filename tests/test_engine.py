"""The engine's own operators: chunkers, state, streams, and the queries against their SQL."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import shutil

import pytest

SMALL = "/root/testdata/sf0.001"


def test_entry_imports_and_queries_have_sql():
    import __spark_entry__ as e

    assert len(e.queries()) > 120 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(
    "raw,inner,label",
    [("$$a^2 + b^2 = c^2$$", "a^2 + b^2 = c^2", None), ("$$E=mc^2$$ (35)", "E=mc^2", "35"), ("$$x = y\\tag{1}$$", "x = y", "1"), ("E = mc^2 \\eqno(1)", "E = mc^2", "1"), ("$$\\begin{aligned}x\\end{aligned}$$ (37)", "\\begin{aligned}x\\end{aligned}", "37"), ("\\text{eqno} = 5", "\\text{eqno} = 5", None)],
)
def test_equations(spark, raw, inner, label):
    from pyspark.sql import functions as F
    from plain.chunker import chunk_blocks, equation
    from quire.functions.text import equation_markdown

    latex, number = equation(raw)
    assert latex == inner and (number or "").strip("() ") == (label or "")
    row = chunk_blocks("d", [{"type": "equation", "text": raw, "page_idx": 0}])[0]
    assert row[4].count("$$") == 2 and row[6] == 1
    assert spark.range(1).select(equation_markdown(F.lit(raw))).first()[0].count("$$") == 2


def test_tables_with_spans():
    from plain.tables import parse_table

    got = parse_table("<table><tr><th rowspan='2'>Model</th><th colspan='2'>BLEU</th><th colspan=2>Cost</th></tr><tr><th>EN-DE</th><th>EN-FR</th><th>EN-DE</th><th>EN-FR</th></tr><tr><td>A</td><td colspan='2'>1</td><td>2</td><td>3</td></tr></table>")
    assert got["headers"] == ["Model", "BLEU EN-DE", "BLEU EN-FR", "Cost EN-DE", "Cost EN-FR"] and got["num_cols"] == 5
    assert got["rows"] == [["A", "1", "1", "2", "3"]]
    assert parse_table("| a | b |\n|---|---|\n| 1 | 2 |")["rows"] == [["1", "2"]] and parse_table("no table") is None


def test_markdown_chunks(spark):
    from quire.operators.chunks import chunks_of_markdown

    md = "# Introduction\n\nSome text here.\n\n## Method\n\n$$a = √{b} × c$$\n\n![fig](images/f.png)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n† now at a lab"
    rows = chunks_of_markdown(spark.createDataFrame([("d", md), ("e", None)], "document_id string, markdown string")).collect()
    assert [r.chunk_type for r in rows] == ["heading", "text", "heading", "math", "figure", "table", "footnote"]
    assert [r.sequence_id for r in rows] == list(range(1, 8)) and rows[0].heading_path == ["Introduction"] and rows[3].heading_path == ["Introduction", "Method"]
    assert "\\sqrt{b}" in rows[3].markdown and rows[4].image_refs == ["f.png"] and json.loads(rows[5].table_json)["rows"] == [["1", "2"]]


def test_block_chunks(spark):
    from quire.operators.chunks import chunks_of_blocks

    blocks = [
        {"type": "header", "text": "x"}, {"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "A paragraph with \\(x × y\\) in it.", "page_idx": 0}, {"type": "list", "list_items": ["a", " ", "b"]},
        {"type": "code", "code_body": "def f():\n  pass"}, {"type": "image", "img_path": "a/b.png", "img_caption": [["One"], "two"]}, {"type": "text", "text": '{"key": [1, 2, 3]}'}, {"type": "page_footnote", "text": "note"},
    ]
    rows = chunks_of_blocks(spark.createDataFrame([("d", json.dumps(blocks))], "document_id string, blocks string")).collect()
    assert [r.chunk_type for r in rows] == ["heading", "text", "text", "code", "figure", "code", "footnote"]
    assert rows[1].markdown == "A paragraph with $x \\times y$ in it." and rows[2].plain_text == "- a\n- b" and rows[4].markdown == "![One two](b.png)\n\nOne two" and rows[5].markdown.startswith("```json")


def test_stitched_equations():
    from plain.chunker import stitch

    got = stitch("Text before\nsoftmax(QKT =\n\n$$a$$\n\n) V\n(1)\nAnd prose goes on. It does.")
    assert got == "Text before\n\n$$\nsoftmax(QKT = a ) V \\quad (1)\n$$\n\nAnd prose goes on. It does."


def test_paragraphs_agree(spark):
    from plain.chunker import paragraphs
    from quire.functions.text import paragraphs as column
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", column(F.col("text")).alias("p")).collect()
    assert all(" ".join(" ".join(r.p).split()) == " ".join(" ".join(paragraphs(r.text)).split()) for r in docs)


def test_heading_paths_equal_the_fold(spark):
    from quire.operators.windows import heading_paths, section_islands

    r = random.Random(4)
    rows = [(d, i, r.choice([None, None, 1, 2, 3, 4]), f"h{d}.{i}") for d in range(40) for i in range(r.randint(1, 25))]
    want, path = {}, []
    for d, i, level, text in rows:
        path = path if i else []
        path = [*path[: level - 1], text] if level else path
        want[d, i] = path
    df = spark.createDataFrame(rows, "doc int, at int, level int, text string")
    assert {(x.doc, x.at): x.heading_path for x in heading_paths(df, "doc", "at", "level", "text").collect()} == want
    tops, n, prev = False, 0, None
    island = {}
    for d, i, level, _ in rows:
        if d != prev:
            tops, n, prev = False, 0, d
        n += level == 1 or (level == 2 and not tops)
        tops = tops or level == 1
        island[d, i] = n or None
    assert {(x.doc, x.at): x.section for x in section_islands(df, "doc", "at", "level").collect()} == island


def test_vectors(spark):
    from pyspark.sql import functions as F
    from quire.operators.fulltext import parse_query
    from quire.operators.retrieval import cosine, cosine_top_k, shape_vector

    df = spark.createDataFrame([(1, [0.1] * 8), (2, [0.0] * 8), (3, [-0.1] * 8)], "id int, embedding array<double>")
    got = cosine_top_k(df, F.array(*[F.lit(0.1)] * 8), 5).collect()
    assert [(r.id, r.similarity) for r in got] == [(1, 1.0), (3, -1.0)]
    assert df.select(cosine(F.col("embedding"), F.col("embedding"))).collect()[1][0] is None
    assert shape_vector(F.col("embedding"), 3) is not None and parse_query('"deep of net" OR cat -dog') == [(["deep", "net"], [], [[("deep", 0), ("net", 2)]]), (["cat"], ["dog"], [])]


def test_changes(spark):
    from pyspark.sql import functions as F
    from quire.operators.store import can_transition, latest_with_kept

    log = spark.createDataFrame([("a", 1, "U", "x", 1), ("a", 2, "U", None, 2), ("b", 1, "U", "y", 1), ("b", 2, "D", None, None), ("b", 3, "U", None, 3), ("c", 1, "U", "z", 1), ("c", 2, "D", None, None)], "k string, v int, op string, label string, value int")
    got = {r.k: (r.label, r.value) for r in latest_with_kept(log, ["k"], [F.col("v")], ["label"]).collect()}
    assert got == {"a": ("x", 2), "b": (None, 3)}
    assert spark.range(1).select(can_transition(F.lit("queued"), F.lit("extracting")), can_transition(F.lit("complete"), F.lit("queued"))).first() == (True, False)


def test_incremental_embedding_resumes(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.streaming.jobs import embed_incrementally

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(0.1)))
    for n, (lo, hi) in enumerate([(0, 20), (10, 25)]):
        spark.range(lo, hi).write.mode("append").parquet(source)
        q = embed_incrementally(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "ck"), embed)
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(25))
    for folder in (tmp_path / "out").iterdir():  # what was written isn't read: with it gone, its keys aren't embedded again
        shutil.rmtree(folder)
    spark.range(0, 30).write.mode("append").parquet(source)
    embed_incrementally(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "ck"), embed).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(25, 30))
    with pytest.raises(ValueError, match="another checkpoint"):
        embed_incrementally(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "other"), embed)


def test_incremental_embedding_repeats_a_failed_batch(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.streaming.jobs import embed_incrementally

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 20).union(spark.range(0, 5)).write.parquet(source)
    lost = lambda df: df.withColumn("embedding", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.array(F.lit(0.1))))
    q = embed_incrementally(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "ck"), lost)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(120)
    embed_incrementally(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "ck"), lambda df: df.withColumn("embedding", F.array(F.lit(0.1)))).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_windows_of_streams(spark, tmp_path):
    """Hourly counts and sessions of a stream against the same over the whole table; what comes too late isn't counted."""
    from pyspark.sql import functions as F
    from quire.streaming.jobs import sessions, windowed_counts

    at, schema = dt.datetime(2024, 1, 1), "at timestamp, key string"
    rows = [(at + dt.timedelta(minutes=m), k) for m, k in ((0, "a"), (5, "a"), (59, "b"), (61, "a"), (200, "a"), (201, "a"))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, of, end):
        folder = str(tmp_path / name)
        for late in (False, True):
            if late:
                spark.createDataFrame([(at, "a"), (at + dt.timedelta(days=end), "z")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            of(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", folder + "-ck").trigger(availableNow=True).start(folder).awaitTermination(120)
        return sorted(((r.start - at).seconds // 60, r.key, r.n) for r in spark.read.parquet(folder).where("key <> 'z'").collect())

    assert run("hours", lambda e: windowed_counts(e, "at", "key"), 1) == [(0, "a", 2), (0, "b", 1), (60, "a", 1), (180, "a", 2)]
    (tmp_path / "in").rename(tmp_path / "before")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run("sessions", lambda e: sessions(e, "at", "key"), 1) == [(0, "a", 2), (59, "b", 1), (61, "a", 1), (200, "a", 2)]


def test_rate_limit(spark, tmp_path):
    """Three runs of one query: windows go on over a restart, and what is kept of a key goes a window after it was last seen."""
    import time

    from quire.streaming.jobs import rate_limited

    at = dt.datetime(2024, 1, 1)
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    asked = []

    def run(rows, left):
        schema = "key string, at timestamp, at_ string"
        spark.createDataFrame([(k, None if s is None else at + dt.timedelta(seconds=s), "x") for k, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        q = rate_limited(spark.readStream.schema(schema).parquet(folder), 2, 20).writeStream.format("parquet").option("checkpointLocation", ck).outputMode("append").trigger(processingTime="200 milliseconds").start(out)
        asked.extend(rows)
        try:
            return until(lambda: spark.read.schema("key string, at timestamp, allowed boolean").parquet(out).count() == len(asked)) and (left is None or until(lambda: kept() == left))
        finally:
            q.stop()

    def kept():
        state = spark.read.format("statestore").option("stateVarName", "window").load(ck)
        return {r.key.key for r in state.select("key").collect()}

    def until(holds):
        end = time.time() + 60
        while time.time() < end:
            try:
                if holds():
                    return True
            except Exception:  # noqa: BLE001 - files of a batch that is being written
                pass
            time.sleep(0.3)
        return False

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        assert run([("a", 0), ("a", 1), ("b", 0), (None, 3), ("c", None)], None) and "a" in kept()
        assert run([("a", 2), ("a", 20), ("a", 25), ("a", 30)], set())  # a later process, from the checkpoint alone; then all timers fire
        assert run([("a", 3), ("d", 0), ("d", 0), ("d", 0)], None)  # late, its window gone: one of its own
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.parquet(out).orderBy("at", "allowed").collect():
        got.setdefault(r.key, []).append(r.allowed)
    assert got == {"a": [True, True, False, True, True, True, False], "b": [True], "c": [None], "d": [False, True, True], None: [True]}


def test_sources(spark, tmp_path):
    from quire.sources.readers import largest_by_folder, read_blocks, uploads

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x_content_list.json").write_text(json.dumps([{"type": "text", "text": "a", "page_idx": 0}, {"type": "table", "table_caption": ["t"]}]))
    (tmp_path / "d" / "a.md").write_text("short")
    (tmp_path / "d" / "b.md").write_text("longer text")
    (tmp_path / "d" / "p.pdf").write_bytes(b"%PDF-1.4 x")
    blocks = read_blocks(spark, str(tmp_path / "d" / "x_content_list.json")).orderBy("block").collect()
    assert [(b.document_id, b.type) for b in blocks] == [("x_content_list.json", "text"), ("x_content_list.json", "table")]
    assert largest_by_folder(spark, str(tmp_path), "*.md").first().path.endswith("b.md")
    assert uploads(spark, str(tmp_path / "d" / "p.pdf"), 100).first().accepted and not uploads(spark, str(tmp_path / "d" / "a.md"), 100).first().accepted


def whole(name, spark, rows, at, table="documents", schema="doc_id long, text string"):
    """Rows of a query over a table of these rows only."""
    import __spark_entry__ as e

    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{table}.parquet")
    return [tuple(r) for r in e.queries()[name](spark, str(at)).collect()]


ODD_TEXTS = ["√{a+b} × √x2 − √", "∑ α ≤ β  Ω ℝ→", "* Equal contribution of all", "* a star only", "** bold", "† now in a lab", "at the workshop, work done there", "work done " * 30, "x", " = ", "", " \n ", "¹note", None]


def test_footnotes_of_every_text(spark, tmp_path):
    from quire.functions.text import FOOTNOTE_MARKS, FOOTNOTE_PHRASES

    def brute(text):
        s = (text or "").strip()
        phrase = any(p in s.lower() for p in FOOTNOTE_PHRASES)
        first = s.split("\n")[0]
        if re.match(rf"[{FOOTNOTE_MARKS}]+\s*\S", first):
            return phrase if re.match(r"\*(?!\*)", first) else True
        return len(s) < 200 and phrase

    got = dict(whole("X8_footnotes_whole", spark, list(enumerate(ODD_TEXTS)), tmp_path))
    assert {i: bool(v) for i, v in got.items()} == {i: brute(v) for i, v in enumerate(ODD_TEXTS)}


def test_glyphs_of_every_text(spark, tmp_path):
    from quire.functions.text import GLYPHS

    def brute(text):
        s = re.sub(r"√\s*([A-Za-z][A-Za-z0-9_]*)", r"\\sqrt{\1}", re.sub(r"√\s*\{([^}]+)\}", r"\\sqrt{\1}", text)).replace("√", "\\sqrt{}")
        return re.sub(" {2,}", " ", "".join(GLYPHS.get(ch, ch) for ch in s))

    texts = [*ODD_TEXTS, *[f"a {g} b" for g in GLYPHS]]
    got = dict(whole("X10_math_glyphs_whole", spark, list(enumerate(texts)), tmp_path))
    assert got == {i: None if v is None else brute(v) for i, v in enumerate(texts)}
    assert got[0] == "\\sqrt{a+b} \\times \\sqrt{x2} - \\sqrt{}"


def test_math_scores_of_every_text(spark, tmp_path):
    from quire.functions.text import GLYPHS, SCORED

    def brute(text):
        s = text.strip()
        return 0.0 if len(s) < 3 else round((sum(ch in SCORED for ch in s) + 0.3 * (s.count("=") + s.count("≈"))) / len(s), 9)

    texts = [*ODD_TEXTS, *[f"a {g} b = c" for g in [*GLYPHS, *SCORED]]]
    got = dict(whole("X22_math_score_whole", spark, list(enumerate(texts)), tmp_path))
    assert got == {i: None if v is None else brute(v) for i, v in enumerate(texts)}


def test_revealed_paragraphs_of_every_text(spark, tmp_path):
    def brute(text):
        s = (text or "").replace("\r\n", "\n").strip()
        found = [p.strip() for p in re.split(r"\n\s*\n+", s) if p.strip()]
        if len(found) == 1 and len(s) > 600:
            found = [p.strip() for p in re.split("\n(?=[A-Z0-9\"'“‘(])", s) if p.strip()]
        return found or ([s] if text else [])

    long = "word " * 130
    texts = ["one\n\ntwo\n \t\n\n three ", "one\r\n\r\ntwo", f" {long}\nNext\nlower\n9 lives\n“Quote”\n(b)\n'c' ", f"{long}\n\nSecond\nThird", "short\nNext", "", " \n ", None]
    got = dict(whole("X49_reveal_paragraphs_whole", spark, list(enumerate(texts)), tmp_path))
    assert got == {i: brute(v) for i, v in enumerate(texts)} and len(got[2]) == 6


def test_orders_are_whole(spark, tmp_path):
    n = 1100
    events = [(n - i, i % 7, i % 13) for i in range(n)]
    want = [(e, u) for e, u, _ in sorted(events, key=lambda x: (x[1], x[2], x[0]))]
    assert whole("T3_note_order_whole", spark, events, tmp_path, "events", "event_id long, user_id long, ts long") == want
    customers = [(n - i, i % 5) for i in range(n)]
    want = sorted(((k, None if v == 3 else v) for k, v in customers), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    assert whole("T1_nulls_last_whole", spark, customers, tmp_path, "customer", "c_custkey long, c_nationkey long") == want
    parts = [(i, f"{'aBcX'[i % 4]}{i % 90}{'aot'[i % 3]}", i % 2) for i in range(n)]
    want = [(i, name) for i, name, _ in sorted(parts, key=lambda x: (x[1].lower(), x[0])) if "a" in name.lower()]
    assert whole("P14_library_whole", spark, parts, tmp_path, "part", "p_partkey long, p_name string, p_size int") == want
    import __spark_entry__ as e

    cloud = lambda x: x[1].lower().endswith("a") or x[2] == 1
    want = [(x[1], cloud(x)) for x in sorted(parts, key=lambda x: (cloud(x), x[1].lower(), x[0])) if "e" not in x[1].lower()]
    assert [tuple(r) for r in e.queries()["T9_model_catalog_whole"](spark, str(tmp_path)).collect()] == want


# --- trees


def tree(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long")


def test_trees_of_any_shape(spark):
    from quire.operators.threads import ancestor_depth, climb, descendants, may_reply, root_of_each

    rows = [(i, i - 1 if i else None) for i in range(1000)]  # a chain
    rows += [(2000, 2001), (2001, 2000), (2002, 2001), (3000, 9999), (3001, 3000), (4000, 4000), (5000, None), (5001, 5000), (5002, 5000)]  # circles, orphans, a fork
    t = tree(spark, rows)
    depth = {r.id: r.depth for r in ancestor_depth(t).collect()}
    assert all(depth[i] == i for i in range(1000)) and [depth[i] for i in (2000, 2001, 2002, 4000)] == [None] * 4
    assert depth[3000] == 1 and depth[3001] == 2 and depth[5002] == 1
    assert {r.id for r in climb(t).where("circle").collect()} == {2000, 2001, 2002, 4000}
    roots = {r.id: r.root for r in root_of_each(t).collect()}
    assert roots == {**{i: 0 for i in range(1000)}, 5000: 5000, 5001: 5000, 5002: 5000}
    below = {(r.root, r.id): r.depth for r in descendants(t, tree(spark, [(998, None), (2000, None), (5000, None), (0, None)])).collect()}
    assert below == {**{(0, i): i for i in range(1000)}, (998, 998): 0, (998, 999): 1, (5000, 5000): 0, (5000, 5001): 1, (5000, 5002): 1}
    allowed = {r.id: r.allowed for r in may_reply(t).collect()}
    assert allowed[2] and not allowed[3] and not allowed[2000]
    assert ancestor_depth(t.limit(0)).count() == 0 and descendants(t, t.limit(0)).count() == 0


def test_trees_of_millions(spark):
    from pyspark.sql import functions as F
    from quire.operators.threads import climb

    n = 1_200_000
    t = spark.range(n).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 8)).alias("parent_id"))
    r = climb(t.withColumn("parent_id", F.when(F.col("id") > 0, F.col("parent_id")))).agg(F.count("*"), F.max("depth"), F.countDistinct("top")).first()
    assert tuple(r) == (n, 7, 1)


def test_threads_of_conversations(spark):
    """u1, a1; u2 under u1, a2 under u2, u3 under u2: the main chat is two turns, u1's thread all five."""
    from quire.operators.threads import thread_subtree

    rows = [("u1", None, "user", 1), ("a1", None, "assistant", 2), ("u2", "u1", "user", 3), ("a2", "u2", "assistant", 4), ("u3", "u2", "user", 5)]
    ids = {n: i for i, (n, *_) in enumerate(rows)}
    t = spark.createDataFrame([(ids[n], ids.get(p), r, at, 1) for n, p, r, at in rows], "id long, parent_id long, role string, at long, conv long")
    got = {(r.root, r.id) for r in thread_subtree(t, "conv", "at", t.where("id in (0, 2)")).collect()}
    assert got == {(0, i) for i in range(5)} | {(2, 2), (2, 3), (2, 4)}


# --- windows, links, retrieval


def test_margin_sides_against_brute_force(spark):
    from quire.operators.relational import margin_side

    r = random.Random(3)
    rows = [(r.randint(0, 3), r.randint(0, 60), r.choice(["left", "right"])) for _ in range(300)]
    got = {(x.d, x.at): x.chosen for x in margin_side(spark.createDataFrame(rows, "d long, at long, side string"), "d", "at", "side").collect()}
    for d, at, _ in rows:
        near = [s for e, b, s in rows if e == d and abs(b - at) <= 6]
        assert got[d, at] == ("left" if near.count("right") > near.count("left") else "right")


def test_asset_links(spark):
    from quire.operators.relational import link_assets

    chunks = spark.createDataFrame([(1, ["a.png", "b.png", "a.png"]), (2, []), (3, None)], "id long, image_refs array<string>")
    assets = spark.createDataFrame([(7, "a.png"), (5, "a.png"), (9, "c.png")], "asset_id long, original_name string")
    assert sorted(tuple(r) for r in link_assets(chunks, assets, "id").collect()) == [(1, 0, "a.png", 5), (1, 2, "a.png", 5)]


# Words and their stems as the algorithm's authors publish them.
STEMS = {
    "connections": "connect", "connected": "connect", "connecting": "connect", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "bled": "bled",
    "sing": "sing", "hopping": "hop", "hoping": "hope", "cry": "cri", "by": "by", "say": "say", "relational": "relat", "conditional": "condit", "rational": "ration", "operator": "oper", "hopefulness": "hope",
    "callousness": "callous", "sensibiliti": "sensibl", "electrical": "electr", "goodness": "good", "allowance": "allow", "replacement": "replac", "adjustment": "adjust", "adoption": "adopt", "communism": "communism",
    "activate": "activ", "bowdlerize": "bowdler", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generously": "generous", "generate": "generat", "skies": "sky", "dying": "die", "news": "news",
    "proceeding": "proceed", "happiness": "happi", "knightly": "knight", "consistency": "consist", "kneeling": "kneel", "youth": "youth", "saying": "say", "analogies": "analog", "2017s": "2017s", "running": "run",
}


def test_scores_of_glyphs_and_ends(spark, tmp_path):
    """White space at a text's ends is that of SQL, also before a line separator; glyphs of and beyond ASCII count."""
    import duckdb
    from pyspark.sql import functions as F
    from quire.functions import text as x

    from __spark_entry__ import oracle_sql, queries

    texts = ["×× \u2028", " \t\f\r\nα = b \n", "a≈b", "äß", "", None, "\u00a0×\u00a0"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["X22_math_score"](spark, str(tmp_path)).collect()
    want = duckdb.sql(oracle_sql()["X22_math_score"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted((r.doc_id, r.score) for r in got) == sorted(want)
    assert spark.range(1).select(x.math_score(F.lit("ab+×"), "+×")).first()[0] == 0.5


def test_patterns_are_tried_where_they_can_match(spark):
    """Every replacement of the chunker's against Python's, over random marks, and what a text needs for it."""
    import random

    from pyspark.sql import functions as F
    from quire.functions import text as x

    r = random.Random(9)
    texts = ["".join(r.choices(["![", "](", "]", ")", "#", "# ", "*", "**", "_", "`", "```", "\n", "\n\n\n", " ", "  ", "\t", "ab", "é"], k=r.randint(0, 25))) for _ in range(2000)]
    assert {p for p, _ in [*x.PLAIN, *x.SUMMARY, *x.TIDY[:2]]} == set(x.NEEDED)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for rules, column in ((x.PLAIN, x.plain_text), (x.SUMMARY, x.summary_plain), (x.TIDY, x.normalize_markdown)):
        got = dict(rows.select("i", column(F.col("t"))).collect())
        for i, t in enumerate(texts):
            for pattern, to in rules:
                t = re.sub(pattern, to, t)
            assert got[i] == t.strip(" \t\n\x0b\f\r"), texts[i]


def test_phrases_are_compiled(spark, tmp_path):
    """Every phrase is one compiled condition over text that was made lower-case once."""
    from quire.plans import QUERIES

    spark.createDataFrame([(1, "A MODEL of law"), (2, "nothing"), (3, None), (4, "Show Me ml")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["X33_intents"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(1, True, False, False, True), (2, False, False, False, False), (3, False, False, False, False), (4, False, True, True, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("lower(text") <= 2


def test_stems(spark):
    import duckdb
    from quire.functions.stems import sql_stems, with_stem

    words = spark.createDataFrame([(w,) for w in STEMS] + [(None,)], "term string")
    assert {r.term: r.stem for r in with_stem(words).collect()} == STEMS | {None: None}
    assert with_stem(words).where("stem = 'connect'").count() == 3
    con = duckdb.connect()
    con.execute("CREATE TABLE words (term VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [(w,) for w in STEMS])
    assert dict(con.execute(f"WITH {sql_stems('words')} SELECT term, stem FROM stems").fetchall()) == STEMS


def brute_ranks(docs, stems, ways):
    """docs: id to list of stem or None by position. ways: (must, never, phrases with distances)."""
    import math

    near, out = len(ways) == 1 and len(stems) > 1, {}
    for i, ws in docs.items():
        at = {s: [p for p, w in enumerate(ws) if w == s] for s in stems}
        if not any(all(at[s] for s in must) and not any(at[s] for s in never) and all(any(all(p + d in at[s] for s, d in ph) for p in at[ph[0][0]]) for ph in phrases) for must, never, phrases in ways):
            continue
        first = {s: at[s][:256] for s in stems}
        if near:
            rest = 1.0
            for a in range(len(stems)):
                for b in range(a):
                    for p in first[stems[a]]:
                        for q in first[stems[b]]:
                            if p != q:
                                d = abs(p - q)
                                rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
            out[i] = 1 - rest
        else:
            out[i] = sum(sum(1 / (j + 1) ** 2 for j in range(len(first[s]))) for s in stems) * 0.1 / 1.64493406685 / len(stems)
    return out


def test_ranked_text(spark, tmp_path):
    """Matches and ranks against brute force; the best from few pages are those of the whole list; stems, phrases, exclusions, nulls, repeats."""
    import random

    from quire.operators import fulltext as ft

    r = random.Random(7)
    words = {"connections": "connect", "connected": "connect", "fox": "fox", "foxes": "fox", "jumped": "jump", "the": None, "lazy": "lazi", "dogs": "dog", "zebra": "zebra", "tree": "tree"}
    odds = [1, 3, 8, 2, 4, 30, 9, 9, 0.05, 30]
    docs = {i: r.choices(list(words), odds, k=r.choice([3, 10, 40, 40, 90, 400])) for i in range(3000)}
    rows = [(i, " ".join(ws)) for i, ws in docs.items()] + [(9000, None), (9001, ""), (9002, "the"), (7, "zebra zebra")]
    by = {i: [words[w] for w in ws] for i, ws in docs.items() if i != 7}
    path = str(tmp_path / "index")
    ft.write_index(spark.createDataFrame(rows, "id long, text string").repartition(5), path)
    asked = {
        "connected": (["connect"], [(["connect"], [], [])]),
        "the connection fox": (["connect", "fox"], [(["connect", "fox"], [], [])]),
        "fox dogs lazy": (["dog", "fox", "lazi"], [(["dog", "fox", "lazi"], [], [])]),
        '"fox jumped"': (["fox", "jump"], [(["fox", "jump"], [], [[("fox", 0), ("jump", 1)]])]),
        '"fox the dogs" -zebra': (["dog", "fox", "zebra"], [(["fox", "dog"], ["zebra"], [[("fox", 0), ("dog", 2)]])]),
        "zebra OR connecting jumping": (["connect", "jump", "zebra"], [(["zebra"], [], []), (["connect", "jump"], [], [])]),
    }
    for q, (stems, ways) in asked.items():
        got = {x.id: x.rank for x in ft.full_text(spark, path, q).collect()}
        want = brute_ranks(by, stems, ways)
        assert {k for k in got if k != 7} == set(want) and all(abs(got[i] - v) < 2e-6 for i, v in want.items()), q
        best = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [tuple(x) for x in ft.full_text_top(spark, path, q, 10).collect()] == best, q
    assert ft.full_text(spark, path, "the").count() == 0 == ft.full_text_top(spark, path, "-fox", 5).count() == ft.full_text(spark, path, "absent").count()
    query = ft.stemmed(spark, "connections")
    every, opened = ft.read_index(spark, path, query).count(), sum(p.count() for p in ft.top_pages(spark, path, query, 10))
    assert every >= 40 and opened * 5 < every, (opened, every)
    plan = ft.read_index(spark, path, query)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("`", "") or "PartitionFilters: [bucket" in plan
    bounds = ft.page_bounds(ft.read_index(spark, path, query), query)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in bounds  # entries aren't read


def test_index_is_made_once(spark, tmp_path):
    """Texts are read once to be counted and once to be indexed, a word at a time nowhere; words' stems in tasks are those of the expressions."""
    import random

    from quire.functions.stems import STEP2, STEP3, STEP4, stem, with_stem
    from quire.operators import fulltext as ft

    r = random.Random(5)
    ends = ["", "y", "ed", "ing", "ies", "sses", "s", "e", "ll", *STEP2, *STEP3, *STEP4]
    made = {"".join(r.choices("aeiouybstlrngc", k=r.randint(1, 6))) + r.choice(ends) + r.choice(ends) for _ in range(3000)}
    assert {x.term: x.stem for x in with_stem(spark.createDataFrame([(w,) for w in made], "term string")).collect()} == {w: stem(w) for w in made}

    spark.createDataFrame([(i, "red foxes run " * 50) for i in range(500)], "id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.sparkContext.setJobGroup("index", "index")
    ft.write_index(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index")
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup("index") for i in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    done = [s for s in (store.lastStageAttempt(i) for i in stages) if s.status().toString() == "COMPLETE"]
    assert sum(s.inputRecords() for s in done) == 1000 and max(s.shuffleWriteRecords() for s in done) <= 500


def test_index_follows_its_documents(spark, tmp_path):
    """A document that is added to the same path is found."""
    from quire.plans.registry import Tables
    from quire.plans.text import text_index

    docs = spark.createDataFrame([(1, "a red fox"), (2, "a dog")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from quire.operators.fulltext import full_text

    found = lambda: sorted(r.id for r in full_text(spark, text_index(Tables(spark, str(tmp_path))), "foxes").collect())
    first = text_index(Tables(spark, str(tmp_path)))
    assert found() == [1] and text_index(Tables(spark, str(tmp_path))) == first
    spark.createDataFrame([(3, "foxes")], docs.schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert found() == [1, 3]


def test_recall_of_approximate_search(spark, monkeypatch):
    """Recall against all vectors with at most 15 % of them read exactly; long lists and many queries in cells; vectors without direction; nothing."""
    import numpy as np
    from pyspark.sql import functions as F
    from quire.operators import ann

    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build(v.union(spark.createDataFrame([(10_000, [0.0] * 64), (10_001, None)], "id long, embedding array<float>")))
    n, queries = v.count(), v.where("id % 50 = 0")
    assert sum(index.sizes.values()) == n and len(index.quantiser.centroids) == int(np.ceil(np.sqrt(n)))  # every vector with a direction is in a list
    read = [r["count"] for r in ann.candidates(index, queries, 10).groupBy("query_id").count().collect()]
    assert len(read) == queries.count() and max(read) <= 0.15 * n
    got = {}
    for r in ann.search(index, queries, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    rows = v.collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.id for r in rows])
    recall = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        assert sorted(k for k, _ in got[ids[i]]) == list(range(1, 11))
        recall.append(len({j for _, j in got[ids[i]]} & set(ids[np.argsort(-s)[:10]].tolist())) / 10)
    assert np.mean(recall) >= 0.9, np.mean(recall)
    whole = sorted(map(str, ann.search(index, queries, 3).collect()))
    monkeypatch.setattr(ann, "CELL", 7)
    assert sorted(map(str, ann.search(index, queries, 3).collect())) == whole
    assert ann.search(ann.build(v.limit(0)), queries, 3).count() == 0 == ann.search(index, queries.limit(0), 3).count()


def test_embedding_responses(spark):
    from pyspark.sql import functions as F
    from quire.operators.retrieval import response_vectors

    df = spark.createDataFrame([([(1, [0.0, 2.0]), (0, [3.0, 4.0])],)], "items array<struct<index: int, embedding: array<double>>>")
    assert df.select(response_vectors(F.col("items"), F.lit(2), 1)).first()[0] == [[1.0], [0.0]]
    with pytest.raises(Exception, match="for inputs: 3"):
        df.select(response_vectors(F.col("items"), F.lit(3), 1)).collect()


def test_research_rounds(spark):
    """A question with few results goes on until a round has no news; URLs and queries don't repeat."""
    from pyspark.sql import functions as F
    from quire.operators.research import research

    web = spark.createDataFrame([("paris", 1, "u1", "T", "about paris", 1.0), ("paris", 2, "u2", "T", "", 2.0), ("benchmarks", 3, "u3", "B", "x" * 400, 0.0), ("paris", 4, "u1", "again", "dup", 9.0)], "word string, position long, url string, title string, snippet string, score double")

    def search(asked):
        return asked.crossJoin(F.broadcast(web)).where(F.contains(F.lower("query"), F.col("word"))).drop("word")

    questions = spark.createDataFrame([(1, "paris", "p.pdf"), (2, "nothing here", None)], "question long, text string, title string")
    got = [(r.question, r.round, len(r.queries), r.urls, r.insights) for r in research(questions, search).orderBy("round").collect()]
    assert [g[:2] for g in got] == [(1, 1), (1, 2)]
    assert got[0][2] == 3 and got[0][3] == ["u2", "u1"] and got[0][4] == ["- T: about paris"]
    assert got[1][3] == ["u3"] and got[1][4] == ["- B: " + "x" * 280]
    assert research(questions.limit(0), search).count() == 0


# --- layout and repair


def test_glyph_repair(spark):
    from quire.operators.repair import LOST, repair_glyphs

    pages = spark.createDataFrame([("d", 1, "we have 𝑛 tokens here"), ("d", 2, "and x̂ = 5 or 𝑛 words, also ★ one"), ("d", 5, "far 𝑘 away")], "document_id string, page int, content string")
    lost = LOST
    chunks = spark.createDataFrame(
        [("d", 1, f"we have {lost}tokens here", 1), ("d", 2, f"a {lost} b {lost}", 2), ("d", 9, f"far {lost} away", 3), ("d", None, f"far {lost} away", 4), ("d", 1, "whole", 5), ("d", 1, None, 6), ("e", 1, f"we have {lost}tokens", 7)],
        "document_id string, page int, text string, id int",
    )
    got = {r.id: r.text for r in repair_glyphs(chunks, pages).collect()}
    assert got[1] == "we have $n$tokens here" and got[4] == "far $k$ away" and got[5] == "whole" and got[6] is None
    assert got[2] == f"a {lost} b {lost}" and got[3] == f"far {lost} away" and got[7] == f"we have {lost}tokens"


def test_glyph_repair_broadcasts_nothing(spark):
    """Rows that grow with the input don't go through the driver, however small their files are."""
    from quire.operators.repair import LOST, repair_glyphs

    pages = spark.createDataFrame([("d", i, f"page {i} has 𝑛 tokens") for i in range(20)], "document_id string, page int, content string")
    hurt = pages.selectExpr("document_id", "page", f"replace(content, '𝑛', '{LOST}') AS text")
    plan = repair_glyphs(hurt, pages)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_glyph_repair_keeps_rows(spark):
    """Equal damaged rows, adjacent losses, contexts with regular expressions' signs, answers that differ, texts longer than any context."""
    from quire.operators.repair import LOST, repair_glyphs

    content = "alpha (β) * [γ] \\\\E δ. one two three 𝟙 four. same x1y same x2y " + "filler " * 50 + "𝐀𝐁 end"
    pages = spark.createDataFrame([("d", 1, content)], "document_id string, page int, content string")
    hurt = [content.replace(ch, LOST) for ch in "βγδ𝟙"] + [content.replace("𝐀𝐁", LOST * 2), content.replace("x1y", f"x{LOST}y"), f"same x{LOST}y", LOST, f"alpha ({LOST}) * [{LOST}]"] * 2
    rows = spark.createDataFrame([("d", 1, h, 1) for h in hurt] + [("d", 1, None, 2), (None, 1, LOST, 3)], "document_id string, page int, text string, known int")
    got = sorted(str(r.text) for r in repair_glyphs(rows, pages).collect())
    whole = content
    want = [whole, whole, whole, whole.replace("𝟙", "$1$")] + [whole.replace("𝐀𝐁", "$A$$B$"), whole, f"same x{LOST}y", LOST, "alpha (β) * [γ]"] * 2 + ["None", LOST]
    assert got == sorted(want)


def test_hosts(spark):
    """Addresses in every way of writing them; what is public passes."""
    import ipaddress

    from pyspark.sql import functions as F
    from quire.sources.ingest import url_refusal

    internal = ["2130706433", "0x7f000001", "[::ffff:127.0.0.1]", "localhost.", "100.64.0.1", "127.1", "0177.0.0.1", "0", "a@b@10.0.0.1", "[::]", "[::1]", "[fe80::1%25eth0]", "[2002:7f00:1::]", "[64:ff9b::7f00:1]", "LOCALHOST", "x.internal", "db", "1.2.3.4.5", "256.1.1.1", "[1:2]", "[::g]", "[1::2::3]", "169.254.169.254", "10.0.0.1:80", "%31%32%37.0.0.1", "[::ffff:0:10.1.2.3]", "08.8.8.8"]
    public = ["8.8.8.8", "134744072", "0x8080808", "example.org", "example.org.", "EXAMPLE.org:443", "u:p@example.org", "[2606:4700::1111]", "[::ffff:8.8.8.8]", "[2002:808:808::]", "100.128.0.1", "172.32.0.1", "localhost.example.org"]
    urls = [(f"{s}://{h}/x", h in public) for h in internal + public for s in ("http", "HTTPS")] + [("ftp://8.8.8.8/", None), ("https://", None), (None, None), ("http://8.8.8.8\\@10.0.0.1/", None), ("http:// 8.8.8.8", None)]
    got = spark.createDataFrame(urls, "u string, public boolean").select("u", "public", url_refusal(F.col("u")).alias("r")).collect()
    for x in got:
        assert x.r == {True: None, False: "internal host"}.get(x.public, x.r) and (x.public is not None or x.r in ("not a web address", "no host")), x
    r = random.Random(3)
    numbers = [r.getrandbits(32) for _ in range(300)] + [r.getrandbits(128) for _ in range(100)] + [r.getrandbits(16) | r.choice([0x20010DB8, 0xFC000000, 0x20014860]) << 96 for _ in range(30)]
    hosts = [str(ipaddress.IPv4Address(n)) if n < 2**32 else f"[{ipaddress.IPv6Address(n)}]" for n in numbers]
    for x, n in zip(spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "i int, u string").orderBy("i").select(url_refusal(F.col("u")).alias("r")).collect(), numbers):
        a = ipaddress.ip_address(n)
        if not a.is_global:  # what Python's list has is refused; a few more networks are
            assert x.r == "internal host", a
        elif n < 2**32 and not a.is_multicast and a not in ipaddress.ip_network("192.88.99.0/24"):
            assert x.r is None, a


def test_assembled_pages(spark):
    from quire.operators.layout import assemble_pages

    schema = "page int, x0 double, y0 double, text string, size double, bold boolean, height double, body double, image string"
    rows = [
        (1, 0.0, 10.0, "A Title", 20.0, True, 1000.0, 10.0, None), (1, 0.0, 20.0, "Body text that goes on for a while.", 10.0, False, 1000.0, 10.0, None), (1, 0.0, 30.0, "x = α + β", 10.0, False, 1000.0, 10.0, None), (1, 0.0, 40.0, "∑ γ ≤ 1", 10.0, False, 1000.0, 10.0, None),
        (1, 0.0, 50.0, "More text of the page follows.", 10.0, False, 1000.0, 10.0, None), (1, 0.0, 45.0, "", 0.0, False, 1000.0, 10.0, "f.png"), (1, 0.0, 900.0, "small print", 8.0, False, 1000.0, 10.0, None), (1, 0.0, 720.0, "† marked note", 10.0, False, 1000.0, 10.0, None), (2, 0.0, 1.0, "Other", 10.0, False, 1000.0, 10.0, None),
    ]
    got = {r.page: r.markdown for r in assemble_pages(spark.createDataFrame(rows, schema), "page").collect()}
    assert got[1] == "\n# A Title\n\nBody text that goes on for a while.\n\n$$\nx = α + β \\\\ \n∑ γ ≤ 1\n$$\n\n\n![f.png](f.png)\n\nMore text of the page follows.\n\n† marked note\n\n\n∗ small print\n"
    assert got[2] == "Other"


def test_quotes_are_located(spark):
    from pyspark.sql import functions as F
    from quire.functions.text import locate_quote

    rows = [("one  two\n\tthree. four", "two three.", (5, 16)), ("a.b axb a.b", "a.b", (0, 3)), ("axb a.b", " a.b ", (4, 7)), ("x \\E y", "\\E  y", (2, 6)), ("text", "none", None), ("text", " ", None), (None, "a", None), ("a", None, None), ("𝑛𝑛 end of it", "end\u00a0of", (3, 9))]
    got = spark.createDataFrame([r[:2] for r in rows], "t string, q string").select(locate_quote(F.col("t"), F.col("q")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in got] == [r[2] for r in rows]


# --- ingestion


def test_ingestion_steps(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.sources.ingest import fetched_image, mode_once, run_chain, url_refusal
    from quire.sources.readers import find_blocks, write_chunks

    urls = {"http://127.0.0.1/x": "internal host", "https://localhost:80/": "internal host", "http://[::1]/": "internal host", "http://172.20.1.1/": "internal host", "http://172.40.1.1/a": None, "ftp://x": "not a web address", "https:///a": "no host", "https://u@169.254.1.1": "internal host", "https://example.org/a?b": None, None: "not a web address"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_refusal(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in got} == urls
    image = spark.range(1).select(fetched_image(F.lit("text/html"), F.lit("a").cast("binary")).alias("a"), fetched_image(F.lit("image/PNG; x"), F.lit("a").cast("binary")).alias("b")).first()
    assert image.a.refusal == "type" and image.a.name is None and image.b.name.endswith(".png") and len(image.b.name) == 20
    modes = spark.createDataFrame([("d", 2, "skip", "late"), ("d", 1, "embed", "first"), ("e", 1, None, "none")], "document_id string, at int, mode string, reason string")
    assert [tuple(r) for r in mode_once(modes).collect()] == [("d", "embed", "first")]
    tries = []

    def flaky(left):
        tries.append(left.count())
        return left.withColumn("ok", F.col("document_id") <= len(tries))

    log = run_chain(spark.range(1, 5).withColumnRenamed("id", "document_id"), [("a", flaky, 2), ("b", lambda d: d.withColumn("ok", F.lit(True)), 0)]).collect()
    assert tries == [4, 3, 2] and sorted(r.document_id for r in log if r.step == "b") == [1, 2, 3]
    schema = "document_id string, sequence_id int, markdown string"
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "new")], [("c", 1, "w")]):
        write_chunks(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert sorted((r.document_id, r.sequence_id, r.markdown) for r in stored.collect()) == [("a", 1, "new"), ("b", 1, "z"), ("c", 1, "w")]
    for name in ("p/content_list.json", "q/content_list.json", "q/x_content_list.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[]")
    assert sorted("/".join(r.path.split("/")[-2:]) for r in find_blocks(spark, str(tmp_path)).collect()) == ["p/content_list.json", "q/x_content_list.json"]


def test_embedding_retries():
    from quire.models import HashModel, embed_with_retries

    model = HashModel(16, longest=1000)
    assert embed_with_retries(model, "a" * 3000, 16) == model.embed(["a" * 1000])[0] and embed_with_retries(HashModel(16, longest=10), "a" * 3000, 16) == [0.0] * 16
    assert len(embed_with_retries(model, "a", 20)) == 20 and abs(sum(v * v for v in embed_with_retries(model, "a", 4)) - 1) < 1e-9


def test_stitching_keeps_all_text():
    """Whatever the lines, nothing but fences and white space is lost."""
    from plain.chunker import stitch

    r = random.Random(5)
    pieces = ["A sentence. And more.", "x =", "$$a + b$$", "$$c$$ (3)", "(12a)", ") V", "i", "", "", "# Head", "lead $$d$$", "| a | b |", "- item", "cost is $5 today, not $6"]
    for _ in range(300):
        md = "\n".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        left = lambda s: sorted(re.sub(r"\$\$|\\quad|[()\s]", "", s))
        got = stitch(md)
        missing = left(md)
        for ch in left(got):
            missing.remove(ch)
        assert not [ch for ch in missing if not ch.isdigit() and ch != "a"], (md, got)  # a second number of one equation is not kept


def test_stitching_as_a_plan(spark):
    """The plan's stitching is the plain fold's, over random lines; nulls; documents without mathematics."""
    from plain.chunker import stitch as plain
    from quire.operators.chunks import stitch

    r = random.Random(6)
    pieces = ["A sentence. And more.", "x =", "$$a + b$$", "$$c$$ (3)", "(12a)", ") V", "i", "", "", "# Head", "lead $$d$$", "| a | b |", "- item", "cost is $5 today, not $6", "f(", "softmax(QKT", "$$e$$$$f$$", "α ≤ √{x}", " "]
    texts = ["\n".join(r.choice(pieces) for _ in range(r.randint(1, 16))) for _ in range(600)] + ["", "$$", "$$a$$"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "document_id long, markdown string").repartition(6)
    got = {x.document_id: x.stitched for x in stitch(docs).collect()}
    assert len(got) == len(texts) + 1 and got[-1] is None
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_chunks_as_plans(spark):
    """Both chunkers against the plain ones: random blocks and Markdown, and whole documents with mathematics."""
    from plain.chunker import CHUNK_SCHEMA, chunk_blocks, chunk_markdown
    from quire.operators.chunks import COLUMNS, chunks_of_blocks, chunks_of_markdown

    assert [c.split()[0] for c in CHUNK_SCHEMA.split(", ")] == COLUMNS

    def same(got, want):
        got = sorted((tuple(x) for x in got), key=lambda x: (x[0], x[1]))
        for a, b in zip(got, sorted(want)):
            table = lambda v: v and {k: x for k, x in json.loads(v).items()}
            assert a[:10] == b[:10] and table(a[10]) == table(b[10]), (a, b)
        assert len(got) == len(want)

    r = random.Random(8)
    parts = ["# A", "## B b", "### C", "Text here. More of it.", "$$x = √{a} × b$$", "![f](images/f.png)", "| a | b |\n|---|---|\n| 1 | 2 |", "† now at a lab", "word " * 300 + "End. Then more. " * 40, "<table><tr><td>1|2|3|</td></tr></table>", "ab", "* equal contribution"]
    texts = ["\n\n".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(120)]
    texts += [t.replace("\n", "\n\n") for t in (x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()) if t]
    docs = [(f"d{i:04}", t) for i, t in enumerate(texts)]
    same(chunks_of_markdown(spark.createDataFrame([*docs, ("n", None), ("o", "")], "document_id string, markdown string").repartition(5)).collect(), [row for i, t in docs for row in chunk_markdown(i, t)])

    def block():
        kind = r.choice(["text", "text", "text", "header", "equation", "image", "chart", "table", "list", "code", "algorithm", "page_footnote", "odd", None])
        said = r.choice(["A paragraph with \\(x × y\\) in it.", "", "  ", "y = x^2 \\tag{3}", "$$a$$ (4)", '{"key": [1, 2, 3]}', "def f():\n  return 1\nclass A:", "Title"])
        return {
            "type": kind, "text": said, "text_level": r.choice([None, None, 1, 2, 8]) if kind == "text" else None, "page_idx": r.choice([None, 0, 3]), "img_path": r.choice([None, "a/b.png", "c.jpg"]), "img_caption": r.choice([None, [], [["One"], "two", [[" three "]]], "plain"]),
            "chart_caption": r.choice([None, ["x"]]), "table_caption": r.choice([None, ["T", ["1"]]]), "code_caption": r.choice([None, 'Say "so"']), "caption": r.choice([None, ["c"]]), "table_body": r.choice([None, "", "<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan='2'>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table>"]),
            "list_items": r.choice([None, ["a", " ", "b"]]), "code_body": r.choice([None, "def f():\n  pass", "```py\nx\n```"]),
        }

    many = [(f"b{i:04}", [block() for _ in range(r.randint(0, 12))]) for i in range(250)]
    rows = [(i, json.dumps(b)) for i, b in many] + [("n", None), ("bad", "[{")]
    same(chunks_of_blocks(spark.createDataFrame(rows, "document_id string, blocks string")).collect(), [row for i, b in many for row in chunk_blocks(i, b)])


def test_table_grids(spark):
    """Spans, header rows, entities and pipes against the plain parser, and the published shape of a two-row header."""
    from plain.tables import parse_table as plain
    from pyspark.sql import functions as F
    from quire.functions.tables import parse_table

    r = random.Random(4)
    spans = [["", "colspan=2", "COLSPAN = 3", "colspan=x"], ["", 'rowspan="2"', "rowspan=0", "rowspan=3"]]  # one kind a table, so that no cell runs into another
    cell = lambda own: f"<t{r.choice('ddh')} {r.choice(own)}>{r.choice(['a', 'b &amp; c', '<b>x</b> y', '', 'é'])}</td>"
    tables = ["<table>" + "".join("<tr>" + "".join(cell(own) for _ in range(r.randint(0, 4))) + "</tr>" for _ in range(r.randint(0, 4))) + "</table>" for own in spans for _ in range(100)]
    tables = [re.sub(r"<t([dh]) ([^>]*)>(.*?)</td>", r"<t\1 \2>\3</t\1>", t) for t in tables]
    tables += ["| a | b |\n|---|---|\n| 1 | 2 |", "no table", "", "|a|b|\n|-|-|", "<table></table>"]
    head = "<table><thead><tr><th rowspan='2'>Model</th><th colspan='2'>BLEU</th><th colspan=2>Training Cost</th></tr><tr><th>EN-DE</th><th>EN-FR</th><th>EN-DE</th><th>EN-FR</th></tr></thead><tbody><tr><td>A</td><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>B</td><td>5</td><td>6</td><td colspan='2'>7</td></tr></tbody></table>"
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*tables, head])] + [(-1, None)], "i int, t string").select("i", parse_table(F.col("t")).alias("g")).collect()
    by = {x.i: x.g and x.g.asDict(True) for x in got}
    for i, t in enumerate(tables):
        assert by[i] == plain(t), t
    assert by[-1] is None and by[len(tables)]["headers"] == ["Model", "BLEU EN-DE", "BLEU EN-FR", "Training Cost EN-DE", "Training Cost EN-FR"] and by[len(tables)]["rows"][1] == ["B", "5", "6", "7", "7"]


def test_tasks_of_nearest_grow_with_the_tables(spark, monkeypatch):
    """A task's sorts hold ranges of bounded size, of both sides together: their number grows with the rows of either."""
    from quire.operators import asof

    monkeypatch.setattr(asof, "RANGE_ROWS", 500)
    left, right = spark.range(10).selectExpr("1 as key", "id * 900 as at"), spark.range(9000).selectExpr("1 as key", "id as at", "id as v")
    found = asof.around(left, right, "key", "at", "v")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-9010 // 500))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(range#\d+, {n}\), REPARTITION_BY_NUM", plan)) == 2
    assert sorted((r.at, r.before.value, r.after.value) for r in found.collect()) == [(i * 900, i * 900, i * 900) for i in range(10)]


def test_tables_of_few_bytes_are_parsed_by_many_tasks(spark):
    from quire.plans import QUERIES

    assert QUERIES["X16_html_tables"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_nearest_of_two_tables(spark, monkeypatch):
    """One key with very many rows over many ranges, hot places, short keys, nulls, repeats, against bisection."""
    import bisect

    from pyspark.sql import functions as F
    from quire.operators import asof

    monkeypatch.setattr(asof, "RANGE_ROWS", 9000)
    r = random.Random(2)
    known = [("hot", r.randrange(60) * 5000, r.randrange(9)) for _ in range(300)] + [(f"k{i % 7}", r.randrange(50), i) for i in range(60)] + [(None, 3, 1), ("hot", None, 1)]
    lefts = [(f"k{i % 9}", r.choice([None, *range(60)])) for i in range(300)] + [(None, 5)] * 2 + [("hot", 150_000)] * 3
    many = spark.range(100_000).select(F.lit("hot").alias("key"), (F.col("id") * 7919 % 300_007).alias("at")).union(spark.range(30_000).select(F.lit("hot"), F.lit(5000).cast("long")))
    left = many.union(spark.createDataFrame(lefts, "key string, at long"))
    right = spark.createDataFrame(known, "key string, at long, v int")
    places = {}
    for k, p, v in known:
        if k is not None and p is not None:
            places.setdefault(k, {}).setdefault(p, []).append(v)
    order = {k: sorted(v) for k, v in places.items()}

    def want(k, p):
        at = order.get(k, []) if p is not None else []
        i, j = bisect.bisect_right(at, p) if at else 0, bisect.bisect_left(at, p) if at else 0
        return (at[i - 1], max(places[k][at[i - 1]])) if i else None, (at[j], min(places[k][at[j]])) if j < len(at) else None

    got = asof.around(left, right, "key", "at", "v").collect()
    assert len(got) == left.count() and {k: sum(x.key == k for x in got) for k in ("hot", None)} == {"hot": 130_003, None: 2}
    for x in got:
        assert (x.before and tuple(x.before), x.after and tuple(x.after)) == want(x.key, x.at), x
    near = {(x.key, x.at): x.found and x.found.at for x in asof.nearest(left, right, "key", "at", "v").where("key = 'k1'").collect()}
    for (k, p), found in near.items():
        b, a = want(k, p)
        assert found == min((abs(p - q[0]), q[0] > p, q[0]) for q in (b, a) if q)[2] if p is not None and (a or b) else found is None
    assert asof.around(left.limit(0), right, "key", "at", "v").count() == 0 and asof.at_or_before(spark.createDataFrame([("a", 1)], "key string, at long"), right.limit(0), "key", "at", "v").first().found is None


def test_batched_model_calls():
    """Calls are counted: batches within their bounds, one refused text among a thousand found by halving, order kept, other errors raised."""
    import threading

    from quire.models import HashModel, batches_of, embed_all, embed_batch

    class Counting(HashModel):
        def __init__(self):
            super().__init__(8, longest=1000)
            self.calls, self.lock, self.now, self.most = [], threading.Lock(), 0, 0

        def embed(self, texts):
            with self.lock:
                self.calls.append(len(texts))
                self.now += 1
                self.most = max(self.most, self.now)
            try:
                return super().embed(texts)
            finally:
                with self.lock:
                    self.now -= 1

    plain = HashModel(8)
    for at in (0, 1, 499, 500, 998, 999):
        model, texts = Counting(), [f"text {i}" for i in range(1000)]
        texts[at] = "x" * 1500
        got, refused = embed_batch(model, texts, 8)
        assert refused and got == plain.embed([t[:1000] for t in texts]) and len(model.calls) <= 24, (at, model.calls)
    assert len(model.calls) <= 14  # what stands last isn't asked for whole on the way
    model, texts = Counting(), ["word " * 100] * 200 + ["y" * 1200] + [""] * 3 + ["word " * 9000]
    assert [len(b) for b in batches_of(texts)][:3] == [63, 63, 63] and sum(len(b) for b in batches_of(texts)) == len(texts) and list(batches_of([])) == []
    got = embed_all(model, texts, 8, concurrent=3)
    assert got[:200] == plain.embed(texts[:200]) and got[200] == plain.embed(["y" * 1000])[0] and got[-1] == plain.embed([("word " * 9000)[:1000]])[0] and model.most <= 3
    model.embed = lambda texts: [[1.0]]
    with pytest.raises(RuntimeError):
        embed_all(model, ["a", "b"], 8)


def test_partial_updates(spark):
    """Nulls and values that aren't valid keep what was there; unknown keys go; rows without a patch stay."""
    from pyspark.sql import functions as F
    from quire.operators.store import partial_update

    rows = spark.createDataFrame([(1, "left", "a", 5), (2, "left", "b", 5), (3, None, "c", 5), (None, "left", "d", 5)], "id int, side string, label string, n int")
    patch = spark.createDataFrame([(1, "right", None), (2, "middle", "B"), (3, "left", "C"), (9, "left", "x"), (None, "right", "y")], "id int, side string, label string")
    got = partial_update(rows, patch, "id", {"side": F.col("side").isin("left", "right")}).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "right", "a", 5), (2, "left", "B", 5), (3, "left", "C", 5), (None, "left", "d", 5)]))


def test_versioned_tables(spark, tmp_path):
    """Changes against a dict of owners; failed writes, two writers, compaction, old versions and clean-up."""
    from pyspark.sql import functions as F
    from quire.sources.versions import VersionedTable, embeddings_of

    table, rng = VersionedTable(spark, str(tmp_path / "t"), "doc"), random.Random(5)
    frame = lambda of: spark.createDataFrame([(d, n) for d, ns in of.items() for n in ns], "doc string, n int")
    held = lambda version=None: sorted((r.doc or "", r.n) for r in table.read(version).collect())
    flat = lambda of: sorted((d or "", n) for d, ns in of.items() for n in ns)
    with pytest.raises(ValueError):
        table.read()
    state, history = {"a": [1, 1], None: [2], "b": [3]}, {}
    history[table.replace_all(frame(state))] = dict(state)
    for step in range(6):
        change = {d: [rng.randrange(9) for _ in range(rng.randrange(3))] for d in rng.sample(["a", "b", "c", "d", None], 2)}
        named = spark.createDataFrame([(d,) for d in change], "doc string")
        state |= change
        history[table.change(frame(change), named)] = dict(state)
        if step == 3:
            before = held()
            history[table.compact()] = dict(state)
            assert held() == before and len(table.manifest()["folders"]) == 1
    assert held() == flat(state) and all(held(v) == flat(s) for v, s in history.items())
    broken = frame({"a": [7]}).withColumn("n", F.when(F.lit(True), F.raise_error(F.lit("lost"))).otherwise(1).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.change(broken)
    with pytest.raises(ValueError, match="doesn't name"):
        table.change(frame({"a": [7], "b": [8]}), spark.createDataFrame([("a",)], "doc string"))
    with pytest.raises(ValueError, match="columns"):
        table.change(frame({"a": [7]}).withColumn("n", F.lit("x")))
    assert held() == flat(state) and table.versions() == sorted(history)
    late = table.manifest()
    table.change(frame({"a": [4]}))
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(late, late["schema"], late["folders"])
    table.restore(1)
    assert held() == flat(history[1])
    table.vacuum(2)
    assert len(table.versions()) == 2 and held() == flat(history[1]) and len(list((tmp_path / "t" / "data").iterdir())) == 5  # version 9: base and three changes; 10: the first base

    one, other = (embeddings_of(spark, str(tmp_path / "e"), m, d) for m, d in (("a/b", 2), ("a/b", 3)))
    one.change(spark.createDataFrame([(1, [0.1, 0.2])], "chunk_id int, embedding array<double>"))
    assert one.path != other.path and other.versions() == [] and one.read().count() == 1


def test_chain_resumes(spark, tmp_path):
    """A driver lost before or after any attempt; the log ends as without a loss, and no finished attempt is done again."""
    from pyspark.sql import functions as F
    from quire.scratch import write_once
    from quire.sources.ingest import run_chain

    docs = spark.range(6).withColumnRenamed("id", "document_id")

    def chain(log, lost=None, after=False):
        done = []

        def step(name, ok):
            def work(left):
                done.append(name)
                if len(done) == lost:
                    if not after:
                        raise KeyboardInterrupt
                    return left.withColumn("ok", F.raise_error(F.lit("lost")).cast("boolean"))
                return left.withColumn("ok", ok)

            return work

        steps = [("a", step("a", F.col("document_id") % 3 != 0), 1), ("b", step("b", F.lit(True)), 2)]
        return sorted(tuple(r) for r in run_chain(docs, steps, log).collect()), done

    plain, all_steps = chain(None)
    assert len(plain) == 12 and all_steps == ["a", "a", "b"]
    for lost in (1, 2, 3):
        log = str(tmp_path / f"log{lost}")
        with pytest.raises((KeyboardInterrupt, Exception)):
            chain(log, lost, lost == 2)
        assert chain(log) == (plain, all_steps[lost - 1 :]) and chain(log) == (plain, [])
    assert write_once(spark, f"{tmp_path}/once", "x") and not write_once(spark, f"{tmp_path}/once", "y") and (tmp_path / "once").read_text() == "x"


@pytest.fixture
def engine():
    """A search engine on this machine: its address, and what it was asked."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    asked = []

    class Engine(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append((q["q"], q.get("categories")))
            found = [{"title": f" {q['q']} {i} ", "url": f"https://x.org/{i}", "content": "text", "engine": "e", "score": [1, None, "high"][i % 3], "img_src": "//i.org/a.png" if i == 0 else None} for i in range(15)]
            self.send_response(500 if q["q"] == "broken" else 200)
            self.end_headers()
            self.wfile.write(b"no json" if q["q"] == "nonsense" else json.dumps({"results": found}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_web_search(spark, engine):
    from pyspark.sql import functions as F
    from quire.sources.search import register, searched

    url, asked = engine
    queries = spark.createDataFrame([("a & b", 1), ("a & b", 2), (None, 3), (" ", 4), ("broken", 5), ("nonsense", 6)], "query string, position int")
    rows = sorted(searched(queries, url).collect(), key=lambda r: r.position)  # a range sort would ask once more, for its sample
    assert [r.position for r in rows] == list(range(1, 11)) and {r["query"] for r in rows} == {"a & b"} and sorted(asked) == [("a & b", None), ("broken", None), ("nonsense", None)]
    assert rows[0].title == "a & b 0" and rows[0].image == "https://i.org/a.png" and rows[1].image is None and [r.score for r in rows[:3]] == [1.0, None, None]
    with pytest.raises(Exception, match="500"):
        searched(queries.where("query = 'broken'"), url, strict=True).collect()
    assert searched(queries.where("false"), url).count() == 0

    register(spark)
    source = spark.read.format("web_search").option("endpoint", url)
    asked.clear()
    assert source.option("queries", '["x", "y", "x"]').option("categories", "images").load().where("position <= 2").count() == 4 and sorted(asked) == [("x", "images"), ("y", "images")]
    asked.clear()
    source = spark.read.format("web_search").option("endpoint", url)
    got = source.load().where(F.col("query").isin("x", "y") & (F.col("categories") == "images") & (F.col("position") < 3)).collect()
    assert len(got) == 4 and sorted(asked) == [("x", "images"), ("y", "images")]
    with pytest.raises(Exception, match="needs its queries"):
        source.load().collect()


def test_page_spans(spark, tmp_path):
    """Dumped pages, whole and as a stream over a restart: the same lines; then Markdown and chunks of a document."""
    from pyspark.sql import functions as F
    from quire.operators.chunks import chunks_of_markdown
    from quire.operators.layout import join_spans
    from quire.sources.spans import line_text, markdown_of, page_lines, pages

    rng = random.Random(3)

    def span(text, left, size=10.0, **more):
        return {"text": text, "size": size, "bbox": [left, 0.0, left + 6.0 * len(text or ""), 9.0]} | more

    def line(y, *spans):
        return {"bbox": [50.0, y, 500.0, y + 9], "spans": list(spans)}

    def dump(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    first = {"document_id": "d", "page": 0, "height": 800.0, "snapshot": "p0.png", "blocks": [{"type": 0, "lines": [line(20, span("A Long Title", 50, 20.0, font="Serif-Bold")), line(50, span("body text of", 50), span("the page", 130, flags=16)), line(60, span(None, 50), span("  ", 60)), line(780, span("* a note", 50, 7.0))]}, {"type": 1, "image": "f.png", "bbox": [0, 40, 9, 45]}]}
    dump("a.jsonl", first, {"document_id": "d", "page": 1, "height": 800.0, "blocks": []}, {"document_id": "e", "page": 0, "blocks": None})
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), None
    for n in range(2):
        if n:
            dump("b.jsonl", {"document_id": "d", "page": 2, "height": 0.0, "blocks": [{"type": 0, "lines": [{"spans": [span("no place", 1)]}, line(1)]}]})
        stream = page_lines(pages(spark.readStream, source))
        schema = stream.schema
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-ck").trigger(availableNow=True).start(out).awaitTermination(120)
    whole = page_lines(pages(spark.read, source))
    assert sorted(map(repr, spark.read.schema(schema).parquet(out).collect())) == sorted(map(repr, whole.collect())) and whole.count() == 5
    got = {(r.page, r.text): r for r in whole.collect()}
    assert got[0, "body text of the page"].bold and got[0, "A Long Title"].bold and not got[0, "* a note"].bold and got[0, ""].image == "f.png" and got[2, "no place"].height == 1.0
    text = {r.document_id: r.markdown for r in markdown_of(pages(spark.read, source)).collect()}
    assert list(text) == ["d"] and re.sub("\\s+", " ", text["d"]).strip() == "# A Long Title ![f.png](f.png) body text of the page * a note ![Page 1](p0.png) no place"
    assert [r.chunk_type for r in chunks_of_markdown(markdown_of(pages(spark.read, source))).collect()][0] == "heading"

    rows, at = [], 0.0
    for n in range(60):
        words = [rng.choice(["ab", " c", "d ", "e", "fgh"]) for _ in range(rng.randrange(1, 5))]
        for i, w in enumerate(words):
            at += rng.choice([0.0, 1.0, 2.0, 9.0])
            rows.append((n, i, w, at, at + 4.0 * len(w)))
            at += 4.0 * len(w)
    table = spark.createDataFrame(rows, "n int, i int, text string, left double, right double")
    plain = {r.n: r.text for r in join_spans(table, ["n"], "i").collect()}
    nested = table.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct("text", F.array("left", "left", "right").alias("bbox")).alias("s")))), lambda e: e["s"]).alias("spans"))
    assert {r.n: r.text for r in nested.select("n", line_text(F.col("spans")).alias("text")).collect()} == plain
