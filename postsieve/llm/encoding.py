"""Token ids of whole texts by a vocabulary file of the tokenizers library, with a memo of pieces.

Byte-level BPE never merges across the border between a word and the blank before the next, so the ids of a
text are those of its pieces in a row. Words repeat, so each task encodes the pieces it has not met yet, by
the library, and looks up the rest. For a vocabulary whose rules are not known to split at
blanks, whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from types import ModuleType

import numpy as np

from .common import ENCODERS

END_ID = 2
MEMO = 1_600_000  # some 200 MB
PUNCTUATION = frozenset(".,;:!?")

_INNER = re.compile(r"(?<=\S)(?=[ \n]\S)")


def vocabulary(path: str) -> str:
    """The file's text, some megabytes: it is sent to the executors, which need not have the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def blanks(rules: str) -> str:
    """What blanks do to a text under these rules: ``keep``, ``drop`` or ``unknown``."""
    parsed = json.loads(rules)
    before, normal = parsed.get("pre_tokenizer") or {}, parsed.get("normalizer")
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "keep"
    steps = [(s["type"], s.get("behavior"), s.get("invert")) for s in before.get("pretokenizers", [])]
    kinds = {s["type"] for s in (normal or {}).get("normalizers", [])}
    drops = steps[:1] == [("Split", "Removed", True)] and "[^\\s" in json.dumps(before).replace("\\\\", "\\")
    return "drop" if drops and kinds <= {"NFC", "Replace", "Lowercase"} else "unknown"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Torn(Exception):
    """A piece that begins or ends where a text may not be parted."""


class Encoder(dict):
    """Memo of the ids of pieces. What is met while the memo is full moves the older half out."""

    def __init__(self, rules: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(rules)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.blanks, self.limit, self.old = blanks(rules), memo // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.fresh(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def fresh(self, piece: str) -> bytes:
        word = piece[1:] if self.blanks == "keep" and piece[:1] == " " else piece
        if word.isalpha() and max(word) < "\u0100":  # one word for the model: no rule parts or changes letters
            if self.blanks == "drop":
                piece = piece.lower()
            word = piece.translate(self.letters) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if not self.whole(piece):
            raise Torn
        if piece[:1] == "\n" and len(piece) > 1:
            return self["\n"] + self[piece[1:]]
        if piece[-1:] in PUNCTUATION and piece[-2:-1].isalpha():  # letters and other signs are never merged
            return self[piece[:-1]] + self[piece[-1]]
        return self.library(piece)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if self.blanks == "drop":
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            return _INNER.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def whole(self, piece: str) -> bool:
        """Whether the piece begins and ends where a text may be parted: no blank next to another."""
        if self.blanks != "keep" or not piece or piece == "\n":
            return True
        inner = piece[1:2].isspace() or len(piece) == 1 if piece[0] in " \n" else False
        return not inner and not piece[-1].isspace()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [self.ids(t) for t in texts]

    def ids(self, text: str) -> bytes:
        if self.blanks == "unknown":
            return self.library(text)
        try:
            pieces = self.pieces(text)
            if self.blanks == "keep" and "\n" in pieces:  # a line end before a blank
                raise Torn
            return b"".join(map(self.__getitem__, pieces))
        except Torn:
            pieces = _INNER.split(text)
            return b"".join([self[p] if self.whole(p) and p != "\n" else self.library(p) for p in pieces])


def encoder(rules: str) -> Encoder:
    """The encoder of this Python worker: its memo outlives the task, until one that does not encode."""
    kept = sys.modules.setdefault(ENCODERS, ModuleType(ENCODERS))
    key = f"of_{hash(rules)}"
    if not hasattr(kept, key):
        setattr(kept, key, Encoder(rules))
    return getattr(kept, key)
