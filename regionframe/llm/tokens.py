"""Token ids of whole texts, as the tokenizers library gives them, quickly.

A text of characters below U+0300 without special strings is cut into words by the tokenizer's own rule, and the ids of
each distinct word come from the library once and are kept; every other text goes to the library whole. The character
classes of the rule are asked of the tokenizer itself, one character at a time.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

KEPT_WORDS = 400_000  # of a Python worker; then all are dropped and learned anew
LOW = 0x300


def vocabulary(name: str) -> str:
    """The path of one of the public tokenizers' files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def char_class(tokenizer, c: str) -> str:
    """L, N, S or O: how the tokenizer's cutting rule takes the character c."""
    cut = lambda s: [x for _, x in tokenizer.pre_tokenizer.pre_tokenize_str(s)]
    if cut("a" + c) == [(0, 1 + len(c))]:
        return "L"
    if cut("!" + c) == [(0, 1 + len(c))]:
        return "O"
    if tokenizer.normalizer is not None:  # here numbers are cut one by one, and white space is dropped
        return "N" if cut(c) else "S"
    return "N" if cut("1" + c) == [(0, 1 + len(c))] else "S"


def byte_level_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Encoder:
    """The ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.lowers = t.normalizer is not None
        kinds: dict[str, list[str]] = {k: [] for k in "LNSO"}
        for c in map(chr, range(LOW)):
            kinds[char_class(t, c)].append(re.escape(c))
        L, N, S, O = ("".join(kinds[k]) for k in "LNSO")  # noqa: E741
        # The contractions and the order of alternatives that the tokenizers' files state
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = re.compile(f"{short}|[{L}]+|[{N}]|[{O}]+" if self.lowers else f"{short}| ?[{L}]+| ?[{N}]+| ?[{O}]+|[{S}]+(?![^{S}])|[{S}]+").findall
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.high = re.compile(f"[^\\x00-{chr(LOW - 1)}]|\u0130").search  # U+0130 in lower case is two characters
        byte_chars = byte_level_alphabet()
        self.spelled = {c: "".join(byte_chars[b] for b in chr(c).encode()) for c in range(LOW)}
        self.kept: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.kept) + len(words) > KEPT_WORDS:
            self.kept.clear()
        cut, spelled, kept = self.tokenizer.model.tokenize, self.spelled, self.kept
        for w in words:
            kept[w] = np.array([x.id for x in cut(w.translate(spelled))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not (text.isascii() or not self.high(text)) or self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words(text.lower() if self.lowers else text)
        if len(words) <= KEPT_WORDS // 2:
            return self._ids(words)
        return b"".join(self._ids(words[at : at + KEPT_WORDS // 2]) for at in range(0, len(words), KEPT_WORDS // 2))

    def _ids(self, words: list[str]) -> bytes:
        kept = self.kept
        if new := set(itertools.filterfalse(kept.__contains__, words)):
            self.learn(new if len(kept) + len(new) <= KEPT_WORDS else set(words))
        return b"".join(map(kept.__getitem__, words))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One a worker process and file: the words it has learned serve all tasks that run there."""
    return Encoder(path)
