"""Splitting texts into pre-tokens exactly as the tokenizer libraries do.

The standard `re` module splits several times faster than the libraries, but knows
neither \\p{L} nor their Unicode version. Its pattern is therefore spelled out for the
code points below SAFE_END, where the general categories are settled and were compared
one by one with both libraries (tests/llm); a text with any other code point is split
by the library itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: First code point on which Python's and the libraries' Unicode tables differ.
SAFE_END = 0x558


def _ranges(keep) -> str:
    out, start = [], None
    for c in range(SAFE_END + 1):
        inside = c < SAFE_END and keep(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


LETTERS = _ranges(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = _ranges(lambda c: unicodedata.category(c)[0] == "N")
SPACES = _ranges(lambda c: c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z")
_outside = re.compile(f"[^\\u0000-\\u{SAFE_END - 1:04x}]")


def is_safe(text: str) -> bool:
    """Whether the spelled-out patterns hold for all of the text."""
    return text.isascii() or _outside.search(text) is None


def spelled_out(pattern: str) -> str:
    """A library pattern with \\p{L}, \\p{N} and \\s replaced by the ranges below SAFE_END."""
    known = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES, r"\S": None}
    out, i, inside = [], 0, False
    while i < len(pattern):
        name = next((k for k in known if pattern.startswith(k, i)), None)
        if name:
            if name == r"\S":
                out.append(f"[^{SPACES}]")
            else:
                out.append(known[name] if inside else f"[{known[name]}]")
            i += len(name)
            continue
        if pattern[i] == "[":
            inside = True
        elif pattern[i] == "]":
            inside = False
        out.append(pattern[i])
        i += 1
    return "".join(out)


@lru_cache(maxsize=8)
def splitter(pattern: str, removed: bool = False):
    """A function from text to its list of matches of pattern.

    removed: the pattern does not cover the text and what lies between matches is dropped.
    """
    find = re.compile(spelled_out(pattern)).findall

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Regex, pre_tokenizers

        return pre_tokenizers.Split(Regex(pattern), "removed" if removed else "isolated", invert=removed)

    def split(text: str) -> list[str]:
        if is_safe(text):
            return find(text)
        return [piece for piece, _ in library().pre_tokenize_str(text)]

    return split
