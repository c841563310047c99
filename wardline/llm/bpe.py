"""Byte-level BPE by a lazily determinised transducer, and streaming decode by a UTF-8 state machine.

Why a finite-state machine can do it: a sequence of tokens is the merge result of its bytes exactly when
each token merges back to itself and each neighbouring pair, encoded together, stays that pair (merges
never cross a boundary that they do not cross within the pair). So after any prefix there is one last
token, and the future depends only on the open token starts: which vocabulary path has been read from
there, and which token ended there. The machine's state is the set of these (path, last token) pairs,
each with the tokens not emitted yet; what all pairs agree on is emitted at once. An open path is at most
as long as the longest token, so lookahead is bounded. States and moves are made when first met and the
table starts anew beyond ``max_states``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_column, sliced
from .pretokens import Memo, splitter

ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging, lowest rank first and leftmost among equals; used for short strings only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one pre-token after another; all tables are bounded."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = bytearray(1)  # whether a path goes on
        for t, i in ranks.items():
            node = ROOT
            for b in t:
                self.inner[node] = 1
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                node = nxt
            self.token[node] = i
        self.whole = Memo(lambda t: merge(self.bytes_of[t], ranks) == [t], len(ranks) + 1)
        self.fits = Memo(lambda k: merge(self.bytes_of[k >> 24] + self.bytes_of[k & 0xFFFFFF], ranks) == [k >> 24, k & 0xFFFFFF], 500_000)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.configs: list[tuple] = []  # (path << 20 | last token + 1, tokens held back, ...) of each state
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next state << 20 | place of what is emitted
        self.outs: list[tuple[int, ...]] = [()]
        self.out_at: dict[tuple[int, ...], int] = {(): 0}
        self.tail: list[tuple[int, ...]] = []
        self.same: dict = {}
        self.start = self._state(((ROOT << 20, ()),))

    def _state(self, configs: tuple) -> int:
        flat = tuple(x for c in configs for x in c)
        s = self.ids.get(flat)
        if s is None:
            s = self.ids[flat] = len(self.configs)
            self.configs.append(flat)
            self.tail.append(next((res for key, res in configs if key >> 20 == ROOT), ()))
        return s

    def _move(self, state: int, byte: int) -> int:
        new = []
        flat, child, token, inner = self.configs[state], self.child.get, self.token, self.inner
        for i in range(0, len(flat), 2):
            key, res = flat[i], flat[i + 1]
            nxt = child((key >> 20) << 8 | byte)
            if nxt is None:
                continue
            last = key & 0xFFFFF
            if inner[nxt]:
                new.append((nxt << 20 | last, res))
            t = token[nxt]
            if t >= 0 and self.whole[t] and (not last or self.fits[last - 1 << 24 | t]):
                new.append((ROOT << 20 | t + 1, (*res, t)))
        if not new:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        out, first = (), new[0][1]
        if first:
            emitted = 0
            while emitted < len(first) and all(len(r) > emitted and r[emitted] == first[emitted] for _, r in new):
                emitted += 1
            if emitted:
                out = first[:emitted]
                new = [(k, r[emitted:]) for k, r in new]
        new.sort()
        same = self.same.setdefault
        place = self.out_at.get(out)
        if place is None:
            place = self.out_at[out] = len(self.outs)
            self.outs.append(out)
        move = self.moves[state << 8 | byte] = self._state(tuple((same(k, k), same(r, r)) for k, r in new)) << 20 | place
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        direct = self.ranks.get(piece)
        if direct is not None:
            return [direct]
        if len(self.configs) > self.max_states or len(self.outs) > 900_000:
            self._reset()
        state, get, outs, out = self.start, self.moves.get, self.outs, []
        for b in piece:
            move = get(state << 8 | b)
            if move is None:
                move = self._move(state, b)
                if len(self.configs) > 2 * self.max_states or len(outs) > 1_000_000:  # one very long piece
                    flat = self.configs[move >> 20]
                    out.extend(outs[move & 0xFFFFF])
                    self._reset()
                    get, outs = self.moves.get, self.outs
                    move = self._state(tuple(zip(flat[::2], flat[1::2], strict=True))) << 20
            state = move >> 20
            if move & 0xFFFFF:
                out.extend(outs[move & 0xFFFFF])
        out.extend(self.tail[state])
        return out


#: Bytes that may come next in each state of the UTF-8 machine, and the state after them (fixed values of Unicode table 3-7).
#: 0 is between code points; 1, 2 and 3 want as many continuation bytes; 4 to 7 follow E0, ED, F0 and F4.
STEPS = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
}
BROKEN = 8
MOVES = bytes(next((to for lo, hi, to in STEPS[state] if lo <= b <= hi), BROKEN) for state in range(8) for b in range(256))
#: The bits of a lead byte that belong to the code point, by the state after it.
LEAD_BITS = bytes((0x7F, 0x1F, 0x0F, 0x07, 0x0F, 0x0F, 0x07, 0x07))
_runs = re.compile(rb"[\x00-\x7f]+|[\x80-\xff]+").findall


class Utf8Machine:
    """Turns bytes into code points one byte at a time; an unfinished code point waits for the next chunk.

    A byte that breaks a sequence yields U+FFFD for the prefix read so far and is read again between code points,
    as strict decoders with replacement do. ASCII bytes between code points leave the state as it is, so a run of
    them passes at once.
    """

    def __init__(self):
        self.state = self.point = 0

    def feed(self, chunk: bytes) -> str:
        if not self.state and chunk.isascii():
            return str(chunk, "ascii")
        out: list[str] = []
        state, point = self.state, self.point
        for run in _runs(chunk):
            if run[0] < 0x80:
                if state:
                    out.append("\ufffd")
                    state = 0
                out.append(str(run, "ascii"))
                continue
            for b in run:
                to = MOVES[state << 8 | b]
                if to == BROKEN:
                    out.append("\ufffd")
                    if not state:
                        continue
                    state, to = 0, MOVES[b]
                    if to == BROKEN:
                        out.append("\ufffd")
                        continue
                point = point << 6 | b & 0x3F if state else b & LEAD_BITS[to]
                state = to
                if not state:
                    out.append(chr(point))
        self.state, self.point = state, point
        return "".join(out)

    def end(self) -> str:
        unfinished, self.state = self.state, 0
        return "\ufffd" if unfinished else ""


def decode_stream(ids: Iterable[int], table: dict[int, bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of ids, chunk by chunk; no chunk splits a code point."""
    machine = Utf8Machine()
    for part in batched(ids, chunk):
        yield machine.feed(b"".join(map(table.__getitem__, part)))
    yield machine.end()


def digest_stream(ids: Iterable[int], table: dict[int, bytes], chunk: int = 4096, parts: list[str] | None = None) -> str:
    """SHA-256 of the decoded text in UTF-8, fed chunk by chunk; parts, where given, takes the chunks."""
    digest = hashlib.sha256()
    for part in decode_stream(ids, table, chunk):
        digest.update(part.encode("utf-8"))
        if parts is not None:
            parts.append(part)
    return digest.hexdigest()


class Codec:
    """Text to ids and back for one rank file and pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str, max_pieces: int = 100_000):
        self.ranks = read_ranks(ranks_path)
        self.machine = Transducer(self.ranks)
        self.split = splitter(pattern)
        self.table = self.machine.bytes_of
        pack = lambda piece: (ids := self.machine.encode_piece(piece.encode("utf-8"))) and struct.pack(f"<{len(ids)}I", *ids)
        self.packed = Memo(pack, max_pieces)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also input_ids and decoded_text.

    Null text is empty; empty text has no ids and the digests of no bytes. Rows are handled one by one:
    repeated ids and null ids pass through, other columns are not read. No shuffle; memory is bounded by
    the batch, the piece memo and the state table.
    """
    kind = docs.schema[id_column].dataType
    schema = f"{id_column} {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>, decoded_text string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in sliced(batches, text_column):
            out: list[list] = [[] for _ in range(5)]
            for raw in byte_column(batch, text_column):
                packed = c.encode_packed(raw.decode("utf-8", "replace"))
                ids_of = memoryview(packed).cast("I").tolist() if packed else []
                parts: list[str] | None = [] if ids else None
                out[0].append(len(ids_of))
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(digest_stream(ids_of, c.table, parts=parts))
                if ids:
                    out[3].append(ids_of)
                    out[4].append("".join(parts))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["input_ids", "decoded_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
