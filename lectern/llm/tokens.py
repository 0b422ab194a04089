"""Subword ids by the tokenizers library, with a bounded memo of words.

Both supported pipelines cut a text into words before any merge, and merge within a word alone. So the
ids of a text are the ids of its words in turn, and a word that was seen before needn't be merged again.
A text of other than Latin letters, digits, ASCII signs and plain white space goes to the library whole,
because its cutting then depends on Unicode tables that Python's `re` doesn't share.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNSAFE = re.compile(f"[^\t\n\r -~{_LETTERS}]")
_SPACED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_SPACED_SOURCE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words kept by one memo; there are two generations, so about 0.1 GB a worker at the most.
MEMO_WORDS = 200_000
LONGEST_KEPT = 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers; of a few, struct makes them faster than numpy."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Word to the little-endian 32-bit ids of its tokens."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.old = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.merge(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """`encode(text)`: the ids of a whole text as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text. An empty text has no ids.
    """

    def __init__(self, path: str, memo: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before, normal = said.get("pre_tokenizer") or {}, said.get("normalizer") or {}
        model = self.tokenizer.model
        letters = _byte_letters()

        def merge(w: str) -> bytes:
            # of plain ASCII only the blank has another letter
            spelt = w.replace(" ", letters[32]) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters)
            return _packed([t.id for t in model.tokenize(spelt)])

        self.cut = None
        if memo and not normal and _SPACED_SOURCE.items() <= before.items():
            self.cut = _SPACED.findall
        elif memo and [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            first = (before.get("pretokenizers") or [{}])[0]
            if first.get("pattern") == {"Regex": _PLAIN_PATTERN} and first.get("behavior") == "Removed" and first.get("invert"):
                self.cut = lambda text: _PLAIN.findall(text.lower())
        self.memo = _Memo(merge)

    def encode(self, text: str) -> bytes:
        if self.cut is None or _UNSAFE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo = self.memo
        ids = b"".join(map(memo.__getitem__, self.cut(text)))
        memo.trim()
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a file and worker process: reused workers keep their memo from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
