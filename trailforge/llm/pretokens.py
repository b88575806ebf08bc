"""Splitting texts by a pre-tokenizer's pattern, as the tokenizer libraries split them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import regex


@cache
def _cut():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str


@cache
def _stand_in(character: str) -> str:
    """A well-known character of the kind (letter, number, other) that a tokenizer library takes this one for."""
    return next((known for known in "a1" if len(_cut()(known + character)) == 1), "!")


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its matches.

    ``regex`` and the tokenizer libraries follow different versions of Unicode. Characters
    that this Python's tables, older than both, do not know may be letters for one of them only; while
    the pattern is matched, characters of the kind they have in the libraries stand for them.
    """
    compiled = regex.compile(pattern)
    find = compiled.findall

    def split(text: str) -> list[str]:
        if text.isascii() or not (odd := [c for c in set(text) if unicodedata.category(c) == "Cn"]):
            return find(text)
        known = text.translate({ord(c): _stand_in(c) for c in odd})
        return [text[m.start() : m.end()] for m in compiled.finditer(known)]

    return split
