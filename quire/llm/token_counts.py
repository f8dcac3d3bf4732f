"""Token counts by a linear longest-match automaton.

Word pieces are taken greedily: from a word's start the longest vocabulary entry that
matches, then the longest from there on. The automaton is the trie of the vocabulary; a
node's failure link leads to the node where matching goes on once the tokens that its
string surely holds are popped, and the number of these tokens is computed beforehand.
Counting reads each byte once and builds no pieces.

The vocabulary is that of a byte-level tokenizer. A word is a run without ASCII white space
and is matched with one space before it, so entries that begin with a space are initial
pieces and the others continue a word; single bytes are entries, so every word matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, remembered, table
from .tokens import _byte_letters

#: Words that a worker remembers in each of two generations; the memory that words take is bounded by their length as well.
MEMO_WORDS, MEMO_LONGEST = 200_000, 64


class Automaton:
    """Dense transitions of the trie with failure links: next node, and tokens popped on the way."""

    def __init__(self, entries: list[bytes]):
        children: list[dict[int, int]] = [{}]
        parent, byte, is_entry, depth = [0], [0], [False], [0]
        for entry in entries:
            node = 0
            for b in entry:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    parent.append(node)
                    byte.append(b)
                    is_entry.append(False)
                    depth.append(depth[node] + 1)
                node = nxt
            is_entry[node] = bool(entry)
        n = len(children)
        if len(children[0]) < 256:
            raise ValueError("every single byte must be an entry")
        self.next = np.zeros((n, 256), np.int32)
        self.pops = np.zeros((n, 256), np.uint8)  # wider as soon as a count asks for it
        fail, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.last = np.zeros(n, np.int32)  # tokens to pop where the word ends
        for v in sorted(range(n), key=depth.__getitem__):
            if v:
                p, b = parent[v], byte[v]
                if is_entry[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    fail[v], popped[v] = self.next[fail[p], b], popped[p] + int(self.pops[fail[p], b])
                self.next[v] = self.next[fail[v]]
                pops = self.pops[fail[v]].astype(np.int64) + popped[v]
                if pops.max() > np.iinfo(self.pops.dtype).max:
                    self.pops = self.pops.astype(np.uint16 if pops.max() < 1 << 16 else np.int64)
                self.pops[v] = pops
                self.last[v] = self.last[fail[v]] + popped[v]
            for b, child in children[v].items():
                self.next[v, b], self.pops[v, b] = child, 0

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, all words a byte at a time."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        at, left = at[order], size[order]
        node, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))
            b = data[at[:live] + step]
            total[:live] += self.pops[node[:live], b]
            node[:live] = self.next[node[:live], b]
        total += self.last[node]
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters = {c: b for b, c in _byte_letters().items()}
        vocab = Tokenizer.from_file(path).get_vocab()
        self.automaton = Automaton([bytes(letters[c] for c in t) for t in sorted(vocab) if all(c in letters for c in t)])
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def count(self, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each whole text."""
        split = [(t or b"").split() for t in texts]
        fresh: dict[bytes, int] = {}
        young, old = self.young, self.old
        for words in split:
            for w in words:
                if w not in young and w not in fresh:
                    fresh[w] = old.get(w, -1)
        unknown = [w for w, n in fresh.items() if n < 0]
        for at in range(0, len(unknown), 100_000):
            some = unknown[at : at + 100_000]
            fresh.update(zip(some, self.automaton.count([b" " + w for w in some]).tolist()))
        young.update(fresh)
        totals = [sum(map(young.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > MEMO_LONGEST:
                del young[w]
        if len(young) > MEMO_WORDS:
            self.old, self.young = young, {}
        return [len(w) for w in split], totals


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = remembered("token_counts")
        if path not in kept:
            kept.clear()
            kept[path] = Counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words, tokens = kept[path].count(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of the whole text of each row of docs (doc_id, text).

    Null, empty and blank texts have 0. Equal texts have equal counts; repeated rows and
    null ids are kept, other columns ignored; an empty table gives no rows. Map-side only.
    """
    return pick(docs, ["doc_id", "text"]).mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document in the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
