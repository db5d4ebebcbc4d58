"""Ids of whole texts from public vocabulary files, words remembered.

Byte-level BPE without a normaliser cuts text before each single space, so a text's ids are those of its words, each with
the space before it, one after another; the same holds for sentence pieces that have no space inside. Words are
remembered (``limit`` at most, then all are forgotten). A text in which a space stands between other white space goes
to the library whole, and so does one with a special token that the library knows.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from pathlib import Path

from voxmill.llm.tokens import CUTS

#: A space after white space and before more of it, or at the end: the text is not cut there.
UNCUT = re.compile(r"\s (?!\S)")
#: Longer words are neither remembered nor given to the fast encoder, whose time grows with their square.
LONG_WORD = 200


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256 up."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """word -> value, by ``make``; all are forgotten when ``limit`` words are held."""

    def __init__(self, make: Callable[[str], object], limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> object:
        value = self.make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


class ByteLevel:
    """A byte-level BPE file of the library ``tokenizers``. ``plain``: special tokens' strings in texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False, limit: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        told = json.loads(Path(path).read_text(encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [x["content"] for x in told.get("added_tokens") or []]
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.pieces = [as_bytes(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())]
        self.fast = self._fast(told)
        self.words = Words(lambda word: packed(self.word_ids(" " + word)), limit)

    def _fast(self, told: dict) -> object | None:
        """An encoder by ranks, where ranks say the same as the file's merges: each merge makes a token of a greater id than those before."""
        model, cutter = told["model"], told.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or told.get("normalizer") or model.get("dropout"):
            return None
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        special = {x["content"] for x in told.get("added_tokens") or []}
        if any(b <= a for a, b in zip(made, made[1:])) or len(made) + 256 != len(set(model["vocab"]) - special):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=CUTS, mergeable_ranks={self.pieces[i]: i for t, i in model["vocab"].items() if t not in special}, special_tokens={})

    def whole_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text that has no special token."""
        return self.fast.encode_ordinary(word) if self.fast and len(word) <= LONG_WORD else self.whole_ids(word)

    def ids(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if self.fast is None or UNCUT.search(text) or any(x in text for x in self.special):
            return packed(self.whole_ids(text))
        first, *rest = text.split(" ")
        return packed(self.word_ids(first)) + b"".join(map(self.words.__getitem__, rest))


class Pieces:
    """A sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        #: No piece goes over from a word into the next, so words can be encoded one by one.
        self.by_word = all("▁" not in x.lstrip("▁") for x in names)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
