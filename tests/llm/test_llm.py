"""Edge cases and brute-force checks of the training-data operators."""

from __future__ import annotations

import hashlib
import html as entities
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, node string, score double"
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with nulls, repeats and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], DOCS)


def some_rows():
    r = random.Random(3)
    words = "the of and to in is that it was for on are with as his they at be this from".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 40, 200]))), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", None, 1) for i in range(12)]
    rows += [(200 + i, rows[i][1] + " extra", "en", "s0", 1) for i in range(12)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", "s9", 3), (303, "word " * 30000, "en", "s1", 1), (300, None, None, None, None), (304, "ONE", "en", "s1", 1), (305, "one", "en", "s1", 1)]
    return rows


ROWS = some_rows()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def brute_mix(rows, quantum):
    """Words taken of each row: a queue that serves packets by virtual finish time until the budget is spent."""
    import hashlib as h

    size = [len(words(r[1])) for r in rows]
    sizes = {}
    for r, n in zip(rows, size):
        sizes[r[3]] = sizes.get(r[3], 0) + n
    targets = brute_targets(sizes)
    md5 = lambda r: h.md5(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()
    at, packets = dict.fromkeys(sizes, 0), []
    order = sorted(range(len(rows)), key=lambda i: md5(rows[i]))
    for copy in range(3):
        for i in order:
            s = rows[i][3]
            for p in range(0, size[i], quantum):
                n = min(quantum, size[i] - p)
                if at[s] < targets[s]:
                    packets.append(((at[s] + n) / targets[s], md5(rows[i]), i, n))
                at[s] += n
    left, taken = sum(size), [0] * len(rows)
    for _, _, i, n in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return sizes, targets, taken


def test_mixing(spark):
    from quire.llm.mixing import QUANTUM, mix, schedule

    docs = frame(spark, ROWS)
    got = schedule(docs).collect()
    sizes, targets, want = brute_mix(ROWS, QUANTUM)
    taken, per_doc = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.words
        per_doc[r.row_id] = per_doc.get(r.row_id, 0) + r.words
        assert per_doc[r.row_id] <= 3 * r.size
    assert all(abs(taken[s] - t) <= QUANTUM for s, t in targets.items()) and sum(taken.values()) == sum(sizes.values())
    assert len(per_doc) == len(ROWS)
    by_doc = {}
    for r in {r.row_id: r for r in got}.values():
        by_doc.setdefault(r.doc_id, []).append(per_doc[r.row_id])
    assert {d: sorted(t) for d, t in by_doc.items()} == {d: sorted(t for r, t in zip(ROWS, want) if r[0] == d) for d in by_doc}
    served = sorted((r.place, r.finish) for r in got if r.finish is not None)
    assert [f for _, f in served] == sorted(f for _, f in served)
    assert sorted(map(str, got)) == sorted(map(str, schedule(docs).collect()))
    assert schedule(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    """Whole rows in the order of the mix, proportions near the targets, copies told apart, rows of shared ids apart."""
    from quire.llm.mixing import mix

    rows = [(None if i % 5 == 0 else i // 3, f"w{i} " * 20, "en", f"s{i % 3}" if i % 7 else "s0", 1) for i in range(600)] + [(1, "same row", "en", "s2", 1)] * 3 + [(2, None, "en", "s0", 1)]
    docs = frame(spark, rows)
    out = mix(docs)
    got = out.collect()
    assert out.columns == [*docs.columns, "mix_copy", "mix_place"] and [r.mix_place for r in got] == sorted(r.mix_place for r in got)
    times = {}
    for r in got:
        times.setdefault((r.doc_id, r.text, r.source), []).append(r.mix_copy)
    copies = {}
    for r in rows:
        copies[r[0], r[1], r[3]] = copies.get((r[0], r[1], r[3]), 0) + 1
    assert all(k in copies and len(v) <= 3 * copies[k] and (copies[k] > 1 or sorted(v) == list(range(len(v)))) for k, v in times.items())
    _, targets, _ = brute_mix(rows, 32)
    for s, t in targets.items():
        assert abs(sum(len(words(r.text)) for r in got if r.source == s) - t) <= 40
    half = sum(len(words(r.text)) for r in got[: len(got) // 2] if r.source == "s0") / sum(len(words(r.text)) for r in got[: len(got) // 2])
    assert abs(half - targets["s0"] / sum(targets.values())) < 0.05  # sources are interleaved, not one after another


# --- tokens, files, packing

PIECES = ["a", "Ünï", "don't", "<|endoftext|>", "x,y", "12", "\n", "  ", "\t", "\x1c", "日本", "é", "'S", " ", "!!", "　"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_ids_are_the_librarys(text):
    import public_tokenizers
    from quire.llm.tokens import encoder

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(public_tokenizers.path(name))
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that cuts texts in another way gets none of the short cuts."""
    import json

    import public_tokenizers
    from quire.llm.tokens import Encoder

    made = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    e = Encoder(str(path))
    assert not e.known
    for text in ("one two", "a\nb c", "It's 3 o'clock", ""):
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_one_operators_memory(monkeypatch):
    import public_tokenizers
    import quire.llm.tokens as t
    from quire.llm.common import _remembered, remembered

    e = t.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encoder(public_tokenizers.path("byte_bpe_50k.json")) is e
    monkeypatch.setattr(t, "MEMO_BYTES", 20_000)
    long = "x" * 1000
    for i in range(2000):
        e.encode(f"word{i} other{i % 7} {long}")
    assert long not in e.units and sum(map(len, (e.units, e.old_units))) < 400
    remembered("jaccard")
    assert set(_remembered) == {"jaccard"}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 9000), st.data())
def test_packed_ids_round_trip(bits, n, data):
    from quire.llm.token_files import pack, unpack

    ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype("<u4")
    offsets, raw = pack(ids, bits)
    start = data.draw(st.integers(0, n))
    length = data.draw(st.integers(0, n - start))
    assert (unpack(raw, offsets, bits, start, length) == ids[start : start + length]).all()
    assert len(raw) <= n * bits / 8 + 1


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from quire.llm.token_files import read_span, read_token_files, write_token_files
    from quire.llm.tokens import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(frame(spark, [*ROWS, (None, "no id", None, None, 1)]), str(tmp_path / "t"), path, 2)
    slim = read_token_files(spark, str(tmp_path / "t"), with_ids=False)
    got = read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    at = 0
    order = sorted((r[0] for r in ROWS))
    assert [r.doc_id for r in got] == [*order, None]
    texts = {r[0]: r[1] for r in ROWS} | {None: "no id"}
    for r in got:
        ids = [*encoder(path).tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == at and r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(map(str, slim.collect())) == sorted(str(r) for r in read_token_files(spark, str(tmp_path / "t")).drop("ids").collect())
    first = np.frombuffer(got[0].ids, "<u4")
    assert (read_span(spark, str(tmp_path / "t"), 0, 0, 1, 3) == np.concatenate([np.frombuffer(r.ids, "<u4") for r in got[:9]])[1:4]).all() and len(first)
    write_token_files(frame(spark, ROWS).limit(0), str(tmp_path / "e"), path, 2)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_packing(spark):
    import public_tokenizers
    from quire.llm.packing import pack_sequences
    from quire.llm.tokens import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r for r in ROWS if r[0] != 300] + [(300, None, None, None, None)]
    got = pack_sequences(frame(spark, rows), path, 2).collect()
    want = {r[0]: [*encoder(path).tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    pieces, sequences = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == len(pieces.setdefault(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert pieces == want
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())
    assert pack_sequences(frame(spark, rows).limit(0), path, 2).count() == 0


def test_packing_of_copies(spark):
    """Repeated rows, repeated and null ids are packed as often as they come, copies of a row in different sequences."""
    import public_tokenizers
    from quire.llm.packing import pack_sequences

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(6)
    texts = [" ".join(r.choice("one two three four five six seven".split()) for _ in range(r.randint(50, 400))) for _ in range(150)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = pack_sequences(frame(spark, rows * 3 + [(None, "a", None, None, 1), (None, "b", None, None, 1), (3, "other text", None, None, 1)]), path, 2).collect()
    starts = {}
    for x in got:
        if x.start == 0:
            starts.setdefault((x.doc_id, x.doc_tokens), []).append(x.sequence_id)
    assert sum(len(v) for v in starts.values()) == 453
    apart = sum(len(set(v)) == 3 for v in starts.values() if len(v) == 3)
    assert apart >= 120  # all but those at the ends of ranges
    pieces = {}
    for x in got:
        pieces.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in p) == max(o + n for o, n in p) for p in pieces.values())


def test_ranges_of_the_curve_hold_as_many_bytes(spark, monkeypatch):
    """Long documents that lie together, and one key with very many documents, are dealt over ranges."""
    import quire.llm.common as common
    from quire.llm.packing import _dealer, _with_keys, byte_ranges
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "RANGE_BYTES", 20_000)
    rows = [(i, "same text " * 20) for i in range(600)] + [(1000 + i, f"long {i % 3} " * 800) for i in range(12)] + [(2000 + i, f"{i} x{i * i} y" * 9) for i in range(300)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(_with_keys, "doc_id long, text string, curve long").cache()
    keys, first, last, n = byte_ranges(keyed)
    dealt = keyed.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(_dealer(keys, first, last), "doc_id long, text string, curve long, h long, part int").collect()
    sizes = [0] * n
    for x in dealt:
        sizes[x.part] += len(x.text)
    assert n >= 10 and max(sizes) < 3 * sum(sizes) / n
    spans = sorted((x.part, x.curve) for x in dealt)
    assert [c for _, c in spans] == sorted(c for _, c in spans)  # ranges follow one another along the curve
    keyed.unpersist()


def test_neighbours_on_the_curve_are_alike():
    from quire.llm.packing import curve_keys, document_vectors

    r = random.Random(9)
    kinds = ["der die das und nicht ist ein zu", "le la les et pas est un que", "0123 4567 89 10 11 42 77 31", "the of and to in is that it"]
    texts = [" ".join(r.choice(k.split()) for _ in range(80)) for k in kinds for _ in range(40)]
    vectors = document_vectors(texts)
    order = np.argsort(curve_keys(texts), kind="stable")
    near = (vectors[order[:-1]] * vectors[order[1:]]).sum(1).mean()
    far = (vectors[:, None] * vectors[None]).sum(2).mean()
    assert near > far + 0.1


def test_hilbert_keys_are_a_curve():
    from quire.llm.packing import hilbert_keys

    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


# --- near duplicates


def brute_components(rows, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return sorted((r[0], len(sets[i]), min(least[find(i)]), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,percent,hot", [(3, 90, 128), (5, 80, 128), (5, 80, 8), (3, 90, 0)])
def test_jaccard_join(spark, k, percent, hot, monkeypatch):
    import quire.llm.jaccard as j

    r = random.Random(5)
    rows = list(ROWS)
    base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(300)]
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"w{r.randint(0, 99999)}"
        rows.append((1000 + i, " ".join(w), "en", "s1", 1))
    for i in range(60):  # a family of many sizes
        rows.append((2000 + i, " ".join(base[: 150 + 2 * i]), "en", "s1", 1))
    monkeypatch.setattr(j, "TILE_ROWS", 20)
    monkeypatch.setattr(j, "WIDE_ROWS", 40)
    monkeypatch.setattr(j, "HOT_STEP", hot)
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in j.jaccard_join(frame(spark, rows), k, percent).collect())
    assert got == brute_components(rows, k, percent)
    assert j.jaccard_join(frame(spark, rows).limit(0), k, percent).count() == 0


def rows_of_shared_ids():
    """Near copies whose ids are null or those of other texts, the same row several times, and blank texts."""
    r = random.Random(8)
    rows = []
    for family in range(12):
        base = [f"f{family}w{r.randint(0, 999)}" for _ in range(120)]
        for copy in range(4):
            w = list(base)
            w[copy] = f"c{copy}"
            rows.append(((None, 7, 7, 10 + family)[copy] if family % 2 else (None, None, 8, None)[copy], " ".join(w), "en", "s1", 1))
    return rows + rows[:3] + rows[:3] + [(None, None, "en", "s1", 1), (None, " ", "en", "s1", 1), (7, "", "en", "s1", 1), (7, "", "en", "s1", 1)]


def test_jaccard_blocks_of_chance(spark):
    """Texts that each have one n-gram in common with the next are no block; near copies are, and links stay."""
    import quire.llm.jaccard as j
    from pyspark.sql import functions as F

    fresh = lambda n, at: [f"w{at}x{i}" for i in range(n)]
    chain = [(i, " ".join(["a", str(i), "b"] + fresh(40, i) + ["a", str(i + 1), "b"])) for i in range(60)]
    near = " ".join(fresh(80, 99))
    docs = frame(spark, [(*r, "en", "s1", 1) for r in chain + [(60, near), (61, near + " more")]])
    keyed = docs.select(j.row_key(["doc_id", "text"]).alias("key"), "doc_id", "text")
    order = spark.sparkContext.broadcast(j.common_order(keyed, 3))
    schema = "key struct<a: long, b: long>, doc_id long, n_shingles long, one long, two long, first array<long>, hot array<long>"
    classes = j.materialize(keyed.mapInArrow(j._prefixes(3, 90, order), schema).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "first", "hot"), "classes")
    assert {tuple(sorted(r)) for r in j._candidates(classes, 90).collect()} == {(60, 61)}
    got = {x.doc_id: x.component_id for x in j.jaccard_join(docs, 3, 90).collect()}
    assert got == {i: i for i in range(61)} | {61: 60}
    keys = keyed.where("doc_id >= 60").select(F.col("key").alias("of"))
    assert [r.doc_id for r in j._may_be_among(keyed, "key", keys).where("__may").collect()] == [60, 61]


@pytest.mark.parametrize("tile", [2, 1024])
def test_jaccard_join_of_shared_ids(spark, tile, monkeypatch):
    import quire.llm.jaccard as j

    monkeypatch.setattr(j, "TILE_ROWS", tile)
    rows = rows_of_shared_ids()
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0, x[3])
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in j.jaccard_join(frame(spark, rows), 3, 80).collect()), key=order)
    # the brute force orders ids: a null counts as one above all others
    want = [tuple(None if x == 10**9 else x for x in w) for w in brute_components([(10**9 if x[0] is None else x[0], *x[1:]) for x in rows], 3, 80)]
    assert got == sorted(want, key=order) and max(x[3] for x in got) > 3


def test_hashes_of_long_texts(monkeypatch):
    """Words of any length have the same hashes whatever the chunk."""
    import quire.llm.common as common
    import quire.llm.jaccard as j

    r = random.Random(1)
    data = (" ".join("".join(r.choice("abcé") for _ in range(r.choice([1, 2, 5, 300]))) for _ in range(400)) + "  \n x " + "y" * 5000 + " end ").encode()
    whole = j.word_hashes(data)
    monkeypatch.setattr(j, "CHUNK", 97)
    common._remembered.clear()
    parts = j.word_hashes(data)
    common._remembered.clear()
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == len(data.split())


@pytest.mark.parametrize("fold", [10, 500_000])
def test_components(spark, fold, monkeypatch):
    import quire.llm.graph
    from quire.llm.graph import components

    monkeypatch.setattr(quire.llm.graph, "FOLD", fold)  # on the driver: several tasks, then rounds of stars

    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(500, 500)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    from quire.llm.graph import forest

    want = forest([a for a, _ in edges], [b for _, b in edges])
    assert all(got.get(n, n) == root for n, root in want.items())


# --- fingerprints


def test_fingerprints(spark):
    from quire.llm.fingerprints import against_next, digest, fingerprint, from_text, likeness, to_text

    rows = [r for r in ROWS if r[0] != 300] + [(300, None, None, None, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in against_next(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for r, n in zip(order, [*order[1:], order[0]]):
        text, other = r[1] or "", n[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == to_text(digest(text)) and g.edited_fingerprint == to_text(digest(edited))
        assert g.near_next == likeness(digest(text), digest(other)) and 0 <= g.near_edited <= 1
        assert (from_text(g.fingerprint) == digest(text)).all()
    by_id = {}
    for r in fingerprint(docs).collect():
        by_id[r.doc_id] = r.fingerprint
    assert by_id[304] != by_id[305] and by_id[300] == by_id[301]
    assert against_next(docs.limit(0)).count() == 0
    one = against_next(frame(spark, ROWS[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def brute_digest(text):
    """The digest with plain dictionaries and sorted counts."""
    data, mask = (text or "").encode(), 0xFFFFFFFF
    counts = dict.fromkeys(range(512), 0)
    for a, b, c in zip(data, data[1:], data[2:]):
        h = a * 0x9E3779B1 & mask
        h ^= h >> 15
        h = h + b * 0x85EBCA77 + c * 0xC2B2AE3D & mask
        h ^= h >> 13
        counts[(h * 0x27D4EB2F & mask) >> 23] += 1
    ranked = sorted(counts.values())
    return [min(255, round(math.log1p(len(data)) / math.log(1.1))), *(sum(counts[i] > ranked[q * 128 - 1] for q in (1, 2, 3)) for i in range(512))]


def brute_likeness(a, b):
    far = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1:], b[1:])) + min(24, abs(a[0] - b[0]))
    return max(0.0, 1 - far / 1024)


def test_digests_against_brute_force():
    from quire.llm.fingerprints import digest, likeness

    texts = [r[1] for r in ROWS if len(r[1] or "") < 4000] + ["ab", "日本語テキスト", "aaa" * 300]
    found = [digest(t) for t in texts]
    assert [d.tolist() for d in found] == [brute_digest(t) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert likeness(found[i], found[j]) == brute_likeness(found[i].tolist(), found[j].tolist())


def test_fingerprints_of_shared_ids(spark):
    """Null ids and an id that many rows share are dealt over ranges, in the order of their texts' hashes."""
    from pyspark.sql import functions as F
    from quire.llm.fingerprints import against_next

    r = random.Random(1)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "".join(r.choice("abc ") for _ in range(r.randint(0, 40)))) for i in range(300)] + [(2**63 - 1, "max"), (-(2**63), "min"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]]))
    want = sorted((str(a[0]), hashlib.sha256((a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(x.doc_id), x.edited_sha256) for x in against_next(docs).collect()) == want


# --- chat


def test_escapes_are_reversible(spark):
    from quire.llm.chat import CONTROL, escape, unescape
    from pyspark.sql import functions as F

    r = random.Random(2)
    bits = [*CONTROL, "\\", "<", "|", "[", "s>", "/", "x", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t and not any(c in row.e for c in CONTROL)


def test_chat_reconstruction(spark):
    from quire.llm.chat import parse, reconstruct, render
    from pyspark.sql import functions as F

    events = [
        (1, 1, 1, "message", "user", "Hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", None, "lo"), (1, 4, 3, "message", "user", "dropped"),
        (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "Good "), (1, 7, 2, "delta", None, "day"), (1, 8, 1, "edit", None, "Hi you"), (1, 9, 4, "message", "user", "later"),
        (1, 10, 5, "message", "user", "gone"), (1, 11, 5, "delete", None, None), (2, 1, 1, None, None, None), (None, 1, 1, "message", "system", "</s>"), (2, 2, 2, "message", "assistant", "<|end|>\\"),
    ]
    log = spark.createDataFrame([(*e, 1) for e in events], "conv_id long, seq long, message long, kind string, role string, text string, place int")
    got = [(r.conv_id, r.place, r.role, r.text) for r in reconstruct(log).orderBy("conv_id", "place").collect()]
    want = [(None, 1, "system", "</s>"), (1, 1, "user", "Hi you"), (1, 2, "assistant", "Good day"), (1, 3, "user", "later"), (2, 1, "", ""), (2, 2, "assistant", "<|end|>\\")]
    assert got == want
    done = render(reconstruct(log)).select("*", parse(F.col("formatted")).alias("turns")).collect()
    for r in done:
        assert [(t.role, t.text) for t in r.turns] == [(w[2], w[3]) for w in want if w[0] == r.conv_id]
        texts = [s and r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [t is not None for t in texts] == [w[2] == "assistant" for w in want if w[0] == r.conv_id]
    assert render(reconstruct(log.limit(0))).count() == 0


def fold(events):
    """The final messages of a log, event by event."""
    lives, order, at = {}, [], 0  # of each message its present life: [began, role, text, dropped]
    for conv, seq, message, kind, role, text in sorted(events, key=lambda e: (e[1], e[2], e[3] or "message", e[4] is not None, e[4] or "", e[5] or "")):
        at += 1
        kind, text = kind or "message", text or ""
        if kind == "delete":
            if message in lives:
                order.remove(lives.pop(message))
            continue
        if message not in lives:
            lives[message] = [at, None, "", False]
            order.append(lives[message])
        life = lives[message]
        life[1] = role if role is not None else life[1]
        if kind == "regenerate":
            life[2] = ""
            for other in order:
                other[3] = other[3] or other[0] > life[0]
        else:
            life[2] = life[2] + text if kind == "delta" else text
    return [(n[1] or "", n[2]) for n in order if not n[3]]


def test_random_logs_against_a_fold(spark):
    from quire.llm.chat import reconstruct

    r = random.Random(11)
    log = [(conv, r.randint(1, 40) if conv % 2 else i, r.randint(1, 6), r.choice(["message", "delta", "delta", "edit", "regenerate", "delete", None]), r.choice([None, "user", "assistant"]), r.choice([None, "a", "b", "cd", ""])) for conv in range(60) for i in range(r.randint(1, 40))]
    log += log[:50]  # repeated events
    got = {}
    for x in reconstruct(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("conv_id", "place").collect():
        got.setdefault(x.conv_id, []).append((x.role, x.text))
        assert x.place == len(got[x.conv_id])
    want = {c: fold([e for e in log if e[0] == c]) for c in range(60)}
    assert got == {c: m for c, m in want.items() if m} and sum(map(len, want.values())) > 60


def test_message_after_delete_and_a_long_log(spark):
    from pyspark.sql import functions as F
    from quire.llm.chat import as_log, parse, reconstruct, render, under_mask

    log = [(1, 1, 1, "message", "user", "one"), (1, 2, 2, "message", "assistant", "two"), (1, 3, 1, "delete", None, None), (1, 4, 1, "message", "user", "again")]
    got = reconstruct(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("place").collect()
    assert [(x.role, x.text) for x in got] == [("assistant", "two"), ("user", "again")]
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s> \\ <|end|>") for i in range(3000)]
    done = render(reconstruct(as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).select(parse(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in done.turns] == [r[2:] for r in rows] and done.loss == [r[3] for r in rows if r[2] == "assistant"]


# --- exact search


@pytest.mark.parametrize("segment,group", [(8192, 4096), (40, 3)])
def test_exact_topk(spark, segment, group, monkeypatch):
    import quire.llm.topk as topk
    from quire.llm.topk import top_k

    monkeypatch.setattr(topk, "SEGMENT", segment)
    monkeypatch.setattr(topk, "QUERY_GROUP", group)

    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.standard_normal(8) / 3], 0) for i in range(300)]
    rows += [(400 + i, rows[5][1], 0) for i in range(20)] + [(5, rows[5][1], 0), (None, rows[5][1], 0), (500, None, 0), (600, [1.0, None], 0), (700, [float("nan")], 0), (800, [], 0), (900, [0.5, 0.25], 0), (1000, [float("inf")] * 8, 0), (1100, [3e30] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for x in top_k(df, 10, 100).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for n, (q, v) in enumerate(usable):
        if q is not None and q % 100 == 0:
            scored = sorted(((-hold(sum(a * b for a, b in zip(v, w))), i is None, i or 0, i) for m, (i, w) in enumerate(usable) if m != n))[:10]
            assert sorted(got[q]) == [(k + 1, s[3], -s[0]) for k, s in enumerate(scored)], q
    assert set(got) == {i for i, _ in usable if i is not None and i % 100 == 0}
    assert top_k(df.limit(0)).count() == 0
    assert len(top_k(df.where("vec_id in (100, 7)"), 10, 100).collect()) == 1


# --- language


def test_language_id(spark):
    from pyspark.sql import functions as F
    from quire.llm.language import fit, held_out, identify

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    samples = fit(docs.where(~held_out(F.col("doc_id"))))
    assert set(samples) == {"en", "fr", "de", "es"}
    test = docs.where(held_out(F.col("doc_id")))
    got = identify(test, samples, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = identify(frame(spark, [(1, None, None, None, 0), (2, "123 !?", "en", "a", 6), (3, "", "en", "a", 0), (4, "the " * 50000, "en", "a", 0)]), samples, ["doc_id", "score"], "p_").collect()
    assert [r.p_lang_pred for r in odd[:3]] == ["und"] * 3 and not any(r.p_accepted for r in odd[:3]) and odd[3].p_lang_pred == "en"
    assert fit(docs.limit(0)) == {} and identify(docs.limit(0), samples, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in identify(docs.limit(3), {}, ["doc_id"]).collect()} == {"und"}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect())


def test_language_fit_is_of_rows(spark):
    """Whole texts, so many different ones of a language, picked by their text alone; copies count once."""
    from quire.llm.language import Classifier, fit, identify, normalise

    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"wort{letters[i % 26] * (1 + i // 26)} und nicht " * (20 + i) for i in range(40)] + ["lang " * 5000]
    rows = [(i, t, "de", "s", 1) for i, t in enumerate(texts)] + [(None, texts[3], "de", "s", 1)] * 300 + [(9, "some english words " * 10, "en", None, 1), (10, None, "en", None, 1), (11, "x " * 90, None, None, 1)]
    got = fit(frame(spark, rows), texts=12)
    assert set(got) == {"de", "en"} and got == fit(frame(spark, [(7, *r[1:]) for r in rows]).repartition(3), texts=12)
    parts = [normalise(t) for t in texts]
    assert sum(p in got["de"] for p in parts) == 12 and len(got["de"]) == sum(len(p) for p in parts if p in got["de"])
    assert set(fit(frame(spark, rows), languages=1)) == {"de"}
    model = Classifier(got)
    for n in (3, 510, 511, 512, 513, 5000):  # every length goes the same way
        text = ("wortd und nicht " * n)[:n]
        data = normalise(text)
        sizes = sorted(sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for c in model.by.values())
        assert model.predict(text)[2] == (sizes[1] - sizes[0]) / max(1, sizes[1])
    twice = identify(frame(spark, [rows[0]] * 3), got, ["doc_id"]).collect()
    assert len(twice) == 3 and len(set(twice)) == 1


# --- pages


def test_main_text_of_made_pages():
    """Held-out accuracy on pages that the model hasn't seen, by words."""
    from quire.llm.html_text import _MARK, Maker, extract, model, parse

    maker = Maker(12345)
    right = kept = wanted = 0
    for _ in range(120):
        made = maker.page()
        want = [w for t in parse(made).texts if t and _MARK in t for w in t.replace(_MARK, "").split()]
        got = extract([made.replace(_MARK, "")], model())[0].split()
        kept, wanted = kept + len(got), wanted + len(want)
        right += sum(min(got.count(w), want.count(w)) for w in set(want))
    assert right / kept > 0.97 and right / wanted > 0.97


def test_main_text_of_given_pages(spark):
    from quire.llm.html_text import main_text

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.text for r in main_text(pages, ["page_id"]).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        assert texts[r.page_id] == " ".join(entities.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", inner)).split())


def test_pages_of_any_shape(spark):
    from quire.llm.html_text import main_text, parse

    odd = [(1, None), (2, ""), (3, "plain &amp; simple"), (4, "<div>" * 20000 + "x"), (5, "<p>a<b>b</b>c<p>d&nbsp; e<br>f"), (6, "<p>cut in a <a hre"), (7, "<script>never"), (8, '<a href="un>closed'), (8, "</div></p><li>x<li>y")]
    df = spark.createDataFrame([(*r, "t") for r in odd], "page_id long, html string, text string")
    got = main_text(df, ["page_id"]).collect()
    assert len(got) == len(odd) and [r.text for r in got if r.page_id in (1, 2, 7)] == ["", "", ""]
    assert [t for t in parse(odd[4][1]).texts if t] == ["a", "b", "c", "d\xa0 e", "f"]
    assert main_text(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</section>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<li>" * 25_000 + "<ul>" * 25_000, "<a '" * 50_000, "<p>" * 50_000 + "</p>" * 50_000])
def test_broken_pages_take_linear_time(page):
    import time

    from quire.llm.html_text import parse

    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 2


def test_decoding_against_all_labellings():
    """On small trees, the kept nodes' log-odds sum to the best of all labellings in which kept lies in kept."""
    from itertools import product

    from quire.llm.html_text import Page, decode

    r = random.Random(4)
    for _ in range(150):
        page = Page()
        n = r.randint(1, 7)
        for i in range(1, n + 1):
            page.tags.append("div")
            page.parents.append(r.randrange(i))
            page.attrs.append("")
            page.texts.append(None)
            page.breaks.append(False)
        score = np.array([0.0, *(r.uniform(-2, 2) for _ in range(n))])
        value = lambda kept: sum(s for s, k in zip(score[1:], kept[1:]) if k)
        best = max(value((True, *kept)) for kept in product((False, True), repeat=n) if all(not k or p == 0 or kept[p - 1] for k, p in zip(kept, page.parents[1:])))
        got = decode(page, score)
        assert all(not got[i] or got[page.parents[i]] for i in range(1, n + 1)) and math.isclose(value(got), best, abs_tol=1e-9)


def test_pages_without_head_end_and_body(spark):
    from quire.llm.html_text import main_text

    words = " ".join(f"<p>Sentence {i} of the article says a little more, and then it ends.</p>" for i in range(12))
    pages = [(1, f"<html><head><title>t</title><meta charset=utf-8><article>{words}</article></html>"), (2, f"<html><head><title>t</title></head><body><article>{words}</article></body></html>"), (3, "<head><title>t</title>Only text stands here, and it is a whole sentence of its own.")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, html string"), ["page_id"]).collect()}
    assert got[1] == got[2] and "Sentence 11" in got[1] and got[3].startswith("Only text")


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = frame(spark, ROWS + [(5000 + i, f"der die und nicht ist das wort {i} ein satz von hier nach dort", "de", "s0", 1) for i in range(20)])
    one = c.identify_language(spark, docs, SMALL)
    assert one.columns == docs.columns
    assert not {300, 301, 302} & {r.doc_id for r in one.collect()}
    two = c.one_of_each_group(spark, one, SMALL)
    rows = [tuple(r)[:5] for r in one.collect()]
    want = {x[0] for x in brute_components(rows, 5, 80) if x[0] == x[2]}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want
    three = c.mix_sources(spark, two, SMALL)
    assert three.columns == docs.columns
    assert c.pack(spark, three, SMALL).count() > 0
    assert [n for n, _ in c.STAGES] == ["language_id", "ngram_jaccard_join", "mix_sources", "pack"]


def test_pipeline_runs_whole(spark, tmp_path):
    """run() over a folder: what its stages give one after another; pieces are whole documents of the mix; empty tables pass."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    r = random.Random(2)
    vocabulary = {"de": "der die und nicht ist das wort ein satz von hier nach dort auch noch".split(), "en": "the of and not is that word a sentence from here to there also still".split()}
    rows = [(i if i % 11 else None, " ".join(r.choice(vocabulary[lang]) + r.choice(["", str(r.randint(0, 99))]) for _ in range(r.randint(30, 300))), lang, f"s{i % 4}", 1) for i in range(200) for lang in (("de", "en")[i % 2],)]
    rows += [(500 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(30)] + [rows[5], rows[5], (3, None, "en", "s0", 1), (4, "", "de", None, 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = c.run(spark, str(tmp_path)).collect()
    docs = frame(spark, rows)
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame(spark, rows[:1]).columns
    kept = docs.collect()
    assert kept and sum(x.start == 0 for x in got) == len(kept)
    ends = sum(x.start + x.length == x.doc_tokens for x in got)
    assert ends == len(kept) and len({x.sequence_id for x in got}) > 1
    frame(spark, rows).limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "e")).count() == 0
    empty = frame(spark, rows).limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in c.STAGES)


def test_one_row_of_each_component(spark):
    """Rows that only share an id, or have none, stay; of a component, one row does."""
    import corpus_pipeline as c

    rows = rows_of_shared_ids()
    got = [tuple(r)[:5] for r in c.one_of_each_group(spark, frame(spark, rows), SMALL).collect()]
    with_set = [r for r in got if (r[1] or "").strip()]
    assert len(with_set) == 12 and len({re.search(r"f\d+w", r[1])[0] for r in with_set}) == 12
    assert {r[0] for r in with_set} == {7, 8}  # the smallest id of each
    assert len(got) - len(with_set) == 4  # the four rows without words
    again = [tuple(r)[:5] for r in c.one_of_each_group(spark, frame(spark, rows[::-1]).repartition(5), SMALL).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


# --- token counts


def brute_count(word, entries, longest):
    n = at = 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in entries)
        at, n = at + size, n + 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=2, max_size=6), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=25), min_size=1, max_size=8))
def test_automaton_is_greedy(entries, texts):
    from quire.llm.token_counts import Automaton

    entries = {e.encode() for e in entries} | {bytes([b]) for b in range(256)}
    got = Automaton(sorted(entries)).count([t.encode() for t in texts]).tolist()
    assert got == [brute_count(t.encode(), entries, 6) for t in texts]


def test_automaton_counts_beyond_a_byte():
    from quire.llm.token_counts import Automaton

    entries = {bytes([b]) for b in range(256)} | {b"a" * 600 + b"b"}
    words_ = [b"a" * 600 + b"c", b"a" * 600 + b"b", b"a" * 70_000, b"a" * 255 + b"c", b"a" * 256 + b"c"]
    assert Automaton(sorted(entries)).count(words_).tolist() == [601, 1, 70_000, 256, 257]


def test_token_counts(spark):
    import public_tokenizers
    from quire.llm.token_counts import token_counts
    from quire.llm.tokens import _byte_letters
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    letters = {c: b for b, c in _byte_letters().items()}
    entries = {bytes(letters[c] for c in t) for t in Tokenizer.from_file(path).get_vocab() if all(c in letters for c in t)}
    longest = max(map(len, entries))
    rows = ROWS + [(7000, "Ünï çode — 日本語 x" + "y" * 500, None, None, 1)]
    got = sorted((r.n_words, r.n_tokens, r.doc_id) for r in token_counts(frame(spark, rows), path).collect())
    memo = {}
    count = lambda w: memo.setdefault(w, brute_count(b" " + w, entries, longest))
    want = sorted((len((r[1] or "").encode().split()), sum(count(w) for w in (r[1] or "").encode().split()), r[0]) for r in rows)
    assert got == want and token_counts(frame(spark, rows).limit(0), path).count() == 0


# --- importance resampling


def brute_resample(docs, target, percent, buckets=10000, longest=1, min_words=20):
    """(id, text) rows: by id and text, (n_features, weight, score), and the ids drawn in order."""
    def feats(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for f in feats(text)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        ws, fs = feats(text)
        w = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    return out, fit[: len(fit) * percent // 100]


@pytest.mark.parametrize("longest,buckets", [(1, 10000), (3, 97)])
def test_resampling(spark, longest, buckets):
    """Weights, scores and ranks against brute force; null ids and texts, repeated rows, very long texts and words."""
    from quire.llm.resampling import resample

    rows = [(r[0], r[1]) for r in ROWS] + [(400 + i, f"Ärger Z{i} " + "eins ZWEI the, of " * (6 + i % 9)) for i in range(40)] + [(500, "x" * 9_000_000 + " the " * 30), (None, "the of " * 40), (None, None)]
    target = [(1, "the Of and in eins"), (2, None), (3, "ärger zwei " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, weight int, bucket string")
    got = resample(docs, spark.createDataFrame(target, "item_id long, text string"), 30, buckets, longest).collect()
    want, drawn = brute_resample(rows, target, 30, buckets, longest)
    assert sorted(str((r.id, r.n_words, r.n_features, r.weight, r.score)) for r in got) == sorted(map(str, want))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_resampling_of_nothing(spark):
    from quire.llm.resampling import resample

    docs, target = frame(spark, ROWS[:30]), spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert resample(docs.limit(0), target, 10).count() == 0
    assert resample(docs, target.limit(0), 100).where("rank is not null").count() == sum(len(words(r[1])) >= 20 for r in ROWS[:30])


def test_words_in_pieces(monkeypatch):
    """Texts longer than a piece, words longer than a piece, words at its edges."""
    import quire.llm.resampling as m

    monkeypatch.setattr(m, "PIECE", 16)
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["ab", "Ü", " ", "  ", "-", "x" * 20, "Q9"]) for _ in range(r.randrange(30)))
        plain = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        assert list(m.words_of(text.encode())) == plain
        index, counts, n = m._row(text.encode(), 50, 2, {})
        both = [b" ".join(plain[i : i + k]) for k in (1, 2) for i in range(len(plain) - k + 1)]
        assert n == len(plain) and sorted(zlib.crc32(f) % 50 for f in both) == [int(i) for i, c in zip(index, counts) for _ in range(c)]


# --- structure repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """rows (turn, role, text) in order: the counts, cost, audit and digest, by the cheapest way over all edits, ends first."""
    from functools import cache

    seen, kinds = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, said, inserted):
        ways = [(0, "", ())] if i == len(rows) and said in ("", "a") else []
        if inserted < 3:
            for r in "ua":
                if (said, r) in after:
                    c, a, out = best(i, after[said, r], inserted + 1)
                    ways.append((c + 3, "I" + a, (f"{full[r]}:", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, said, 0)
            ways.append((c + 4, "D" + a, out))
            if kinds[i] in ("", "truncated"):
                for edit, name in [("K", role), ("R", "user"), ("R", "assistant")]:
                    if (said, name[:1]) in after:
                        c, a, out = best(i + 1, after[said, name[:1]], 0)
                        ways.append((c + (3 if edit == "R" else 0) + (3 if kinds[i] else 0), edit + a, (f"{name}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def some_conversations(r, count=150):
    rows = []
    for conv in range(count):
        for turn in range(r.choice([1, 2, 3, 6, 9])):
            role = r.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "Ü", "sudo"])
            rows.append((conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 2]), role, r.choice(["Yes.", "No!", "and so", " \t", "", None, "Fin. ", "é?", f"{turn}."])))
    return rows + r.sample(rows, 40) + [(None, 0, "user", "Hm."), (None, None, "user", "Hm."), (-7, None, None, None)]


@pytest.mark.parametrize("segment", [4096, 2])
def test_structure_repair(spark, monkeypatch, segment):
    """Random conversations, damaged, against the cheapest of all edits; nulls, repeated rows, odd roles, clashing columns."""
    import quire.llm.structure_repair as m

    monkeypatch.setattr(m, "SEGMENT", segment)
    rows = some_conversations(random.Random(segment))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    hurt = brute_damage(rows)
    assert sorted(map(str, map(tuple, m.damage(table).collect()))) == sorted(map(str, hurt))
    found, _ = m.repair(m.damage(table))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}
    by = {}
    for conv, *row in sorted(hurt, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode())):
        by.setdefault(conv, []).append(tuple(row))
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == brute_repair(own), (conv, own)
    after = {}
    for r in sorted(m.repaired(m.damage(table)).collect(), key=lambda r: r.place):
        after.setdefault(r.conv_id, []).append(r)
    for conv in by:
        mine = after.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine)) and [r.place for r in mine] == list(range(1, len(mine) + 1))


def test_repair_of_nothing(spark, tmp_path):
    """Empty tables; conversations that lose every row; one conversation of 60,000 rows."""
    import quire.llm.structure_repair as m

    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert m.repair(empty)[0].count() == 0 and m.repaired(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hm.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in m.op12_structure_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = [(1, i, "user" if i % 3 else "assistant", f"{i}.") for i in range(60000)]
    one = m.repair(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))[0].first()
    a = m.Determinised()
    symbols = "".join("u" if i % 3 else "a" for i in range(60000))
    assert one.cost == a.scan(symbols)[0] and len(a.vectors) < 40 and one.audit.count("K") + one.audit.count("R") + one.audit.count("D") == 60000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="suaxSUAX-", max_size=14))
def test_automaton(symbols):
    """Costs and audits of every kind of row against the cheapest of all edits; few states."""
    from quire.llm.structure_repair import Determinised

    full = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, "user", " ") if x == "-" else (i, full[x.lower()], f"{i}" + ("" if x.isupper() else ".")) for i, x in enumerate(symbols)]
    a = Determinised()
    cost, path = a.scan(symbols)
    assert (cost, a.audit(symbols, path)) == brute_repair(rows)[5:7] and len(a.vectors) < 60


# --- toxicity


def brute_grams(text):
    """Character runs of 3 to 6 inside a word with the spaces beside it."""
    plain = re.sub(r"[\s]+", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
    return {plain[i : i + n] for n in range(3, 7) for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1]}


def test_toxic_features(monkeypatch):
    """Features are the buckets of the n-grams; blocks change nothing; the model's subset."""
    import quire.llm.toxicity as m

    texts = ["", None, "a", "An idiot's TRASH,x", "Ünï 日本語テキスト 12 ab", " \n", "word " * 50 + "scum", "İstanbul ß", "a" * 40]
    whole = [m.features(t) for t in texts]
    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        return (h ^ h >> 32) % m.BUCKETS

    for t, f in zip(texts, whole):
        assert list(f) == sorted({bucket(g) for g in brute_grams(t)})
    monkeypatch.setattr(m, "BLOCK", 7)
    known = np.arange(m.BUCKETS) % 2 == 0
    for t, f in zip(texts, whole):
        assert list(m.features(t)) == list(f) and list(m.features(t, known)) == [x for x in f if x % 2 == 0]


def test_toxicity(spark):
    """Planted insults, at any length and place, nulls, both labels, one label, no labels, clashing columns."""
    import quire.llm.toxicity as m

    r = random.Random(11)
    plain = "the of and to in is that it was for on are with as his they at be this from over lake tree".split()
    text = lambda n, bad: " ".join(r.choice(plain) for _ in range(n)) if not bad else " ".join(r.choice(plain) if r.random() > 0.1 else r.choice(["numbskull", "blockhead"]) for _ in range(n)) + " numbskull"
    rows = [(i, text(r.choice([5, 30, 200]), i % 4 == 0)) for i in range(400)] + [(900, None), (901, ""), (None, "x"), (5, "the of")]
    docs = spark.createDataFrame([(i, t, "x", 9.0) for i, t in rows], "doc_id long, text string, toxic string, toxic_score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(8, 0, 1), (9, None, 0), (None, 1, 1), (7, 5, 0), (901, 0, 1)], "doc_id long, toxic int, quality int")
    model = m.fit(docs, labels)
    got = {(x.doc_id, x.text): x.toxic_score for x in m.score(docs.select("doc_id", "text", F_lit(1, "toxic")), model, ["doc_id", "text", "toxic"]).collect()}
    assert len(got) == len(rows) and all((s >= 0.5) == bool(t and "numbskull" in t) for (i, t), s in got.items())
    assert model.score(None) == model.score("") == model.score("12 !") < 0.5 and model.score("the of " * 200_000 + "blockhead numbskull") >= 0.5 > model.score("the of " * 300_000)
    again = m.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(again.weight, model.weight, atol=1e-6) and (again.ratio == model.ratio).all()
    assert m.fit(docs, labels.where("toxic = 1")).score("the") == 1.0 and m.fit(docs, labels.where("toxic = 0")).score("the") == 0.0 and m.fit(docs, labels.limit(0)).score(None) == 0.0
    assert m.score(docs.limit(0), model, ["doc_id"]).count() == 0
    few = m.candidates(docs, labels, 50)
    assert 30 <= few.count() <= 120 and m.sample(few, 20).count() == 20 and m.sample(few.limit(0), 20).count() == 0


def F_lit(value, name):
    from pyspark.sql import functions as F

    return F.lit(value).alias(name)


def test_toxicity_held_out(spark):
    """On documents that taught nothing: ranks and decisions."""
    from quire.llm.toxicity import op11_toxicity

    got = op11_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, toxic = got["score"].rank(), got["toxic"] == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.98 and ((got["predicted"] == 1) == toxic).mean() > 0.975 and (got["predicted"] == 1)[~toxic].mean() < 0.01


# --- what doesn't depend on how rows are dealt, and names that clash


def test_mix_over_layouts(spark, tmp_path):
    """Rows with null and shared ids, written as one file and as seven in another order: the same words are taken."""
    from quire.llm.mixing import op1_mix_sources

    r = random.Random(9)
    rows = [(None if i % 3 else i % 40, f"t{i % 700} " * r.choice([1, 5, 60]), "en", f"s{i % 4}" if i % 5 else None, 1) for i in range(1500)]
    for name, n in (("one", 1), ("seven", 7)):
        r.shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    one, seven = (sorted(map(str, op1_mix_sources(spark, f"{tmp_path}/{n}").collect())) for n in ("one", "seven"))
    assert one == seven


def test_mix_with_its_own_names(spark):
    from quire.llm.mixing import mix

    docs = frame(spark, ROWS[:20]).withColumnsRenamed({"words": "mix_copy", "node": "MIX_PLACE"})
    out = mix(docs)
    assert out.columns == [*docs.columns, "mix_copy_", "mix_place_"] and out.select(*docs.columns).count() == out.count()
    assert mix(docs, names=("a", "a")).columns[-2:] == ["a", "a_"]


def test_render_without_text(spark):
    """A turn whose text or role is null is a turn."""
    from quire.llm.chat import parse, render
    from pyspark.sql import functions as F

    m = spark.createDataFrame([(1, 1, "user", None), (1, 2, "assistant", "Yes."), (1, 3, None, "no one")], "conv_id long, place int, role string, text string")
    row = render(m).select("n_turns", parse(F.col("formatted")).alias("t"), "loss_spans").first()
    assert row.n_turns == 3 and [tuple(t) for t in row.t] == [("user", ""), ("assistant", "Yes."), ("", "no one")] and [s is not None for s in row.loss_spans] == [False, True, False]
