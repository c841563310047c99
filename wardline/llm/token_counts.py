"""Token counts with a whole-token shortcut proved before any text is read.

A pre-token's count depends on its string alone. Each vocabulary string that ends a word is merged once before
any text is read; those that come out as one token form the shortcut set. A text is then counted by its
pre-tokens: one for each member of the set, and the number of merged tokens for the rest. Every text goes this
way: strings of special tokens are cut out first and count one each, what lies between is normalized (NFC,
lower case character by character) and split. Characters on which Python's Unicode tables and those of the
tokenizer's library differ are normalized and classed by the file's own steps; the counting is the same.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_column, sliced
from .pretokens import Memo, splitter

#: Marks whose combining class the library's normalizer does not know. Code points that Python's tables
#: leave unassigned are taken to differ as well.
UNKNOWN_MARKS = frozenset(map(chr, (
    0x07FD, 0x0899, 0x089A, 0x089B, *range(0x08CF, 0x08D4), 0x0C3C, 0x0D3B, 0x0D3C, 0x0EBA, 0x1715, 0x1ABF, 0x1AC0, 0x1AC3, 0x1AC4, 0x1ACA,
    *range(0x1DF6, 0x1DFB), 0xA82C, *range(0x10EFD, 0x10F00), 0x10F46, 0x10F47, 0x10F4B, *range(0x10F4D, 0x10F51), 0x10F83, 0x10F85, 0x11070, 0x1133B,
    0x11839, 0x1183A, 0x1193D, 0x1193E, 0x11943, 0x119E0, 0x11A34, 0x11A47, 0x11A99, 0x11D42, 0x11D44, 0x11D45, 0x11D97, 0x11F41, 0x11F42,
    0x16FF0, 0x16FF1, 0x1E4EC, 0x1E4ED, 0x1E4EE,
)))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first and leftmost among equals. A heap holds the pairs that can merge
    and links name each symbol's neighbours, so n symbols take n log n steps."""
    parts, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or (parts[i], parts[j]) != pair:
            continue  # one of the two has merged since
        parts[i], parts[j] = pair[0] + pair[1], ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(p := (parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (r, k, p))
    return [p for p in parts if p]


class Counter:
    """For a tokenizers file with: NFC, white space to a space, lower case; a split pattern; byte-level word BPE."""

    def __init__(self, path: str, max_pieces: int = 200_000):
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        steps = about["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in about["normalizer"]["normalizers"]], [x["type"] for x in steps]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not steps[0]["invert"] or steps[0]["behavior"] != "Removed":
            raise ValueError(f"not a tokenizer of this kind: {kinds}")
        self.split = splitter(steps[0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in about["added_tokens"])) if about["added_tokens"] else None
        self.path, self.library = path, None
        self.odd = Memo(lambda c: unicodedata.category(c) == "Cn" or c in UNKNOWN_MARKS, 50_000)
        self.letters = byte_letters()
        self.end = about["model"]["end_of_word_suffix"]
        self.ranks = {tuple(pair): k for k, pair in enumerate(about["model"]["merges"])}
        back = self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.single = set()
        for string in about["model"]["vocab"]:
            body = string.removesuffix(self.end)
            if not body or body == string or not all(c in back for c in body) or len(self.merge(body)) != 1:
                continue
            try:
                self.single.add(bytes(back[c] for c in body).decode("utf-8"))
            except UnicodeDecodeError:
                pass  # a part of a code point is no pre-token
        self.merged = Memo(lambda piece: len(self.merge("".join(map(self.letters.__getitem__, piece.encode("utf-8"))))), max_pieces)
        self.counts = Memo(lambda piece: 1 if piece in self.single else self.merged[piece], max_pieces)

    def merge(self, word: str) -> list[str]:
        """Tokens of one word in byte letters."""
        return merged([*word[:-1], word[-1] + self.end], self.ranks)

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case. Characters are lowered one by one: a capital sigma at a word's end is no final sigma."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or not any(map(self.odd.__getitem__, set(text))):
            return self.split(self.normal(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, letters)).decode("utf-8") for letters, _ in found]

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(n for part in parts for n in map(self.counts.__getitem__, self.pieces(part)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_documents(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row. Null text is empty: no bytes, no tokens. Repeated and
    null ids pass through; other columns are not read. No shuffle."""
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in sliced(batches, text_column):
            raw = byte_column(batch, text_column)
            n = [c.count(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
