"""Splitting by a published pre-token pattern, with a fast form for Latin text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Below this every letter and digit is precomposed Latin, so `re` classes can be listed by category.
LATIN_END = 0x250
#: Unicode White_Space, which the reference libraries mean by \s (Python's re adds U+001C..1F).
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=None)
def _class(prefix: str) -> str:
    """The members below LATIN_END of a general category, as ranges for a character class."""
    inside, out, c = lambda i: unicodedata.category(chr(i)).startswith(prefix), [], 0
    while c < LATIN_END:
        if inside(c):
            end = c
            while end + 1 < LATIN_END and inside(end + 1):
                end += 1
            out.append(f"\\u{c:04x}-\\u{end:04x}" if end > c else f"\\u{c:04x}")
            c = end
        c += 1
    return "".join(out)


def latin_form(pattern: str) -> str:
    """The pattern with \\p{L}, \\p{N}, \\s and \\S spelt as classes that hold below LATIN_END."""
    out, depth, i = [], 0, 0
    names = {"\\p{L}": _class("L"), "\\p{N}": _class("N"), "\\s": SPACE}
    while i < len(pattern):
        for name, body in names.items():
            if pattern.startswith(name, i):
                out.append(body if depth else f"[{body}]")
                i += len(name)
                break
        else:
            if pattern.startswith("\\S", i):
                if depth:
                    raise ValueError("\\S inside a class")
                out.append(f"[^{SPACE}]")
                i += 2
                continue
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """text -> its matches in order."""
    fast, full = re.compile(latin_form(pattern)).findall, regex.compile(pattern.replace("\\s", f"[{SPACE}]").replace("[^[" + SPACE + "]", "[^" + SPACE).replace("\\S", f"[^{SPACE}]")).findall
    odd = re.compile(f"[^\\x00-\\u{LATIN_END - 1:04x}]").search
    return lambda text: full(text) if odd(text) else fast(text)


class Memo(dict):
    """A dictionary that fills itself and holds two generations of at most ``most`` entries: when the young one is
    full it becomes the old one, and what is asked for again moves back. A worker's memory stays bounded."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if not isinstance(key, (str, bytes)) or len(key) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
