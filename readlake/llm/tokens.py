"""Token ids of whole texts as little-endian unsigned 32-bit bytes.

The tokenizers library is the measure; its own encoder keeps offsets and makes objects, which is most of its time. Where a
tokenizer file is of one of two known kinds, its merges run in a leaner engine that gives the same ids (the tests hold both against
each other): byte-level BPE with the usual split, and word BPE with an end-of-word mark. The mark becomes byte 0xFF, which no
UTF-8 text holds: a word's last byte and the mark merge first, as the file's ids 256 to 511 are those pairs. Texts with
characters whose case or composition is more than a table look-up go to the library itself, as do texts that may hold one of the file's
added tokens (which the library finds in texts and gives their own ids), and files of any other kind.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cached_property

#: The splits of the two kinds, as the tokenizer files write them.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to here have plain case and composition, but for those that are named.
LAST = 0x24F
ODD = re.compile(f"[^\x00-\x1b\x20-{chr(LAST)}]|İ")
#: Pieces that are remembered by a worker at most; a matter of speed alone.
MEMORY = 250_000


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # How added tokens begin, up to the first letter: a text without any of these holds none of them, whatever is done to its case.
        self.marks = {re.match(r"[^\w\s]*", x["content"])[0] for x in spec.get("added_tokens", [])}
        kind = "other" if "" in self.marks else self._kind(spec)
        self.encode = {"byte": self._byte, "word": self._word}.get(kind, self._library)

    def _kind(self, spec: dict) -> str:
        import tiktoken

        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        vocab, at = model.get("vocab"), byte_values()
        if model.get("type") != "BPE" or spec.get("post_processor") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            return "other"
        end = model.get("end_of_word_suffix") or ""
        special = {x["content"] for x in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if made != sorted(made) or len(set(made)) != len(made):
            return "other"  # ids are not in the order of the merges

        def raw(token: str) -> bytes:
            mark = bool(end) and token.endswith(end)
            return bytes(at[c] for c in (token[: -len(end)] if mark else token)) + b"\xff" * mark

        ranks = {raw(t): i for t, i in vocab.items() if t not in special}
        if not end and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.engine = tiktoken.Encoding("byte", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
            return "byte"
        split = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])]
        steps = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if end and split == [WORD_SPLIT, None] and steps == ["NFC", "Replace", "Lowercase"] and all(ranks.get(bytes([b, 255]), 1 << 30) < min(made) for b in range(255) if bytes([b]) in ranks):
            kind = {k: "".join(re.escape(chr(c)) for c in range(LAST + 1) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
            self.split = re.compile(f"[{kind['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{kind['N']}]|[^\\s{kind['L']}{kind['N']}]+").findall
            ranks.setdefault(b"\xff", max(vocab.values()) + 1)
            self.seen = Pieces(tiktoken.Encoding("word", pat_str=".", mergeable_ranks=ranks, special_tokens={}))
            return "word"
        return "other"

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _marked(self, text: str) -> bool:
        return any(m in text for m in self.marks)

    def _library(self, text: str | None) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _byte(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self._library(text) if self._marked(text) else array("I", self.engine.encode_ordinary(text)).tobytes()

    def _word(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._marked(text) or ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._library(text)
        if len(self.seen) > MEMORY:
            self.seen.clear()
        return b"".join(map(self.seen.__getitem__, self.split(text.lower())))


class Pieces(dict):
    """Ids of word pieces, found when first asked for."""

    def __init__(self, engine):
        self.one = engine._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = array("I", self.one(piece.encode() + b"\xff")).tobytes()
        return out


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
