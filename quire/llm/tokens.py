"""Exact ids of a public tokenizer, faster than encoding whole texts.

Byte-pair merges never cross the pieces that a tokenizer cuts a text into, and both
tokenizers used here always cut between a character that is not white space and a single
space or newline. So a text is split at spaces and newlines, each distinct unit is encoded
once by the tokenizers library and remembered, and a document's ids are the concatenation.
A text where the cut would not be sure (white space next to white space, a special
token's string) is encoded whole by the library, and so is every text if the tokenizer is
of another make than these two: how it cuts texts is compared with what is known on load.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .common import remembered

#: Bytes that one generation of units, or of pieces, may take in a worker, which keeps two of either; longer units are not kept.
MEMO_BYTES, MEMO_LONGEST = 64 << 20, 64
#: Bytes of an entry besides those of its unit: two objects and a place in a table.
ENTRY_BYTES = 200

# How the two known makes of tokenizers normalise and cut texts, as their files say it.
SPACED = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
LOWERED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}

#: A word and marks after it: two pieces for either tokenizer. No apostrophe, which may start a contraction.
_SIMPLE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%#$&|()-]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian ids (uint16 if the vocabulary allows it, else uint32)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 65536 else "<u4")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        make = {k: spec[k] for k in SPACED}
        plain = spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and all(t["special"] for t in spec["added_tokens"])
        self.known = plain and make in (SPACED, LOWERED)
        #: a tokenizer that keeps case and white space puts the space before a word into its piece
        self.spaced = make == SPACED
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.unit_bytes = self.piece_bytes = 0

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if self.piece_bytes >= MEMO_BYTES:
                self.old_pieces, self.pieces, self.piece_bytes = self.pieces, {}, 0
            got = self.old_pieces.get(piece)
            if got is None:
                if piece.isascii():
                    letters = "Ġ" + piece[1:] if piece[0] == " " else "Ċ" if piece == "\n" else piece
                else:
                    letters = piece.encode().decode("latin-1").translate(self.letters)
                got = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(piece) <= MEMO_LONGEST:
                self.pieces[piece] = got
                self.piece_bytes += ENTRY_BYTES + len(piece) + len(got)
        return got

    def unit(self, unit: str, first: bool) -> bytes | None:
        """Ids of one unit as it stands in a text; None if it can't be encoded alone."""
        simple = _SIMPLE.fullmatch(unit)
        if simple:
            line, word, mark = simple.groups()
            if self.spaced:
                return (self.piece(line) if line else b"") + self.piece(word if line or first else " " + word) + (self.piece(mark) if mark else b"")
            return self.piece(word.lower()) + (self.piece(mark) if mark else b"")
        if not unit or unit[-1].isspace() or (unit[0].isspace() and unit[0] != "\n") or (unit[0] == "\n" and unit[1:2].isspace()) or any(s in unit for s in self.specials):
            return None
        return self.whole(unit if not self.spaced or first or unit[0] == "\n" else " " + unit)

    def remember(self, unit: str) -> bytes | None:
        """Ids of a unit that was not among the young ones when its text was looked up."""
        got = self.units.get(unit) or self.old_units.get(unit) or self.unit(unit, False)
        if got is not None and len(unit) <= MEMO_LONGEST:
            if self.unit_bytes >= MEMO_BYTES:
                self.old_units, self.units, self.unit_bytes = self.units, {}, 0
            self.units[unit] = got
            self.unit_bytes += ENTRY_BYTES + len(unit) + len(got)
        return got

    def encode(self, text: str | None) -> bytes:
        """Bytes of the ids of the whole text; null is empty."""
        if not text:
            return b""
        if not self.known:
            return self.whole(text)
        head, *units = text.replace("\n", " \n").split(" ")
        found = list(map(self.units.get, units))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = got = self.remember(units[at])
            if got is None:
                return self.whole(text)
        start = self.unit(head, True)
        if start is None:
            return self.whole(text)
        return start + b"".join(found)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between the tasks of a worker that encode."""
    kept = remembered("tokens")
    if path not in kept:
        if len(kept) > 1:
            kept.clear()
        kept[path] = Encoder(path)
    return kept[path]
