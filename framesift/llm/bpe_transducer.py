r"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

The merges of a vocabulary are a transducer from bytes to token ids.  A state is what the bytes since the
last certain token boundary leave open: for each place from which a token may still reach into bytes to
come, the tokens that lead there.  A new byte closes a token at exactly one of these places, the one after
which the token may stand (two tokens may be neighbours if merging their bytes alone gives these two).  Tokens
on which all open places agree are certain and are emitted, which happens within a bounded lookahead for
ordinary text; states and transitions are made when they are first met and kept.  At the end of a piece the
path to its last byte is emitted.  The table of states is bounded; where it ends, and where the open part of
a piece grows long (runs of one character), the transitions are followed depth first without making states, with the
same result, so there is no longest piece.

Texts are split by the vocabulary's pattern; a piece that is a token is that token.  Where the pattern begins a piece at
every space behind another character than white space, a batch is cut there, its parts are numbered by dictionary
encoding, and each distinct part is split and encoded once.  Pieces and parts met before come
from tables of bounded size.

Decoding joins the tokens' bytes and runs a table-driven UTF-8 machine over the end of each portion: a
character cut in two waits for its other bytes, anything ill-formed becomes U+FFFD.

Defined results: a null or empty text has no tokens (its digests are those of nothing); repeated rows give
repeated rows; empty input gives empty output; other columns are ignored by `digests` and kept by `encode`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from framesift.llm.common import free_name
from framesift.llm.text import buffers, part_starts, slices

#: Pieces whose ids are kept, per task process.
KEPT_PIECES = 150_000
#: Parts whose ids are kept, and the most characters of one.
KEPT_PARTS, KEPT_BYTES = 150_000, 64
#: States that are made, and open bytes beyond which none is made: what goes on from there is followed byte by byte.
KEPT_STATES = 10_000
OPEN_BYTES = 48
KEPT_PAIRS = 400_000
#: Matches that are encoded together, and ids that are decoded together.
PORTION = 1 << 16
#: Bytes of text that are cut into parts together; digests, which hand on no ids, take twice as many.
TOGETHER = 1 << 20

#: Open places in ascending order with the tokens that lead to each; the last place is the end.
Paths = list[tuple[int, tuple[int, ...]]]
_BYTES = [bytes((b,)) for b in range(256)]
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of a token's bytes and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _Sizes(dict):
    """Sizes that a token may have, the largest first, by the next bytes of a text (HEAD of them, or all to its end)."""

    HEAD = 4

    def __init__(self, ranks: dict[bytes, int]):
        found: dict[bytes, set[int]] = {}
        for token in ranks:
            found.setdefault(token[:self.HEAD], set()).add(len(token))
        for head, sizes in found.items():
            sizes.update(k for k in range(1, len(head)) if head[:k] in ranks)
            self[head] = tuple(sorted(sizes, reverse=True))

    def __missing__(self, head: bytes) -> tuple[int, ...]:
        return self[head[:-1]] if head else ()


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        grows = {t[:k] for t in ranks for k in range(len(t))}
        #: Token id, if it is one, and whether it may grow into a token, of everything that is either.
        self.known = {t: (ranks.get(t), t in grows) for t in grows.union(ranks)}
        self.sizes = _Sizes(ranks)
        self._pairs: dict[int, bool] = {}
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, float]] | None] = {}
        self._ids: dict[tuple[int, bytes], int] = {}
        self._states: list[tuple[int, bytes, Paths]] = []
        self._moves: dict[int, tuple[tuple[int, ...], int]] = {}
        self._start = self._state(-1, b"", [(0, ())])

    def _state(self, before: int, pending: bytes, paths: Paths) -> int:
        key = (before, pending)
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self._states)
            self._states.append((before, pending, paths))
        return found

    def merged(self, text: bytes, down_to: int = 1) -> list[bytes]:
        """The definition: join the neighbours of lowest rank, the leftmost first, until none can be joined."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]] | None:
        """The parts that stand at one end of a token (side 0: its start, -1: its end) while it is merged, each
        with the rank of the merge that ends it; None if the token's bytes do not merge into the token."""
        found = self._edges.get((token, side))
        if found is None and (token, side) not in self._edges:
            if len(token) == 1:
                found = [(token, float("inf"))]
            else:
                halves = self.merged(token, 2)
                inner = self._edge(halves[side], side) if len(halves) == 2 else None
                other = self._edge(halves[-1 - side], side) if len(halves) == 2 else None
                if inner is not None and other is not None:
                    found = [*inner[:-1], (inner[-1][0], self.ranks[token]), (token, float("inf"))]
            self._edges[token, side] = found
        return found

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging the two tokens' bytes gives the two tokens: then nothing is ever joined across."""
        key = before << 32 | token
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > KEPT_PAIRS:
                self._pairs.clear()
            right = self._edge(self.bytes_of[token], 0)
            left = [(b"", float("inf"))] if before < 0 else self._edge(self.bytes_of[before], -1)
            found = self._pairs[key] = left is not None and right is not None and self._apart(left, right)
        return found

    def _apart(self, left: list[tuple[bytes, float]], right: list[tuple[bytes, float]]) -> bool:
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get(x + y, float("inf")) if x else float("inf")
            if across < x_ends and across <= y_ends and across < float("inf"):
                return False
            if x_ends <= y_ends:
                if x_ends == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def _step(self, before: int, pending: bytes, paths: Paths, byte: int) -> tuple[tuple[int, ...], int, bytes, Paths]:
        """(certain tokens, and the open rest: token before it, its bytes, path to each open place)."""
        text = pending + _BYTES[byte]
        known, pairs = self.known, self._pairs
        whole, after = None, []
        for place, path in paths:
            found = known.get(text[place:])
            if found is None:
                continue
            token, grows = found
            if whole is None and token is not None:
                last = path[-1] if path else before
                fits = pairs.get(last << 32 | token)
                if fits if fits is not None else self._may_follow(last, token):
                    whole = path + (token,)
            if grows:
                after.append((place, path))
        if whole is None:
            raise ValueError("the vocabulary lacks single bytes")
        after.append((len(text), whole))
        first = after[0][1]  # of the earliest open place
        common = len(first)
        for _, path in after:
            while common and path[:common] != first[:common]:
                common -= 1
        if not common:
            return (), before, text, after
        certain = first[:common]
        done = sum([len(self.bytes_of[t]) for t in certain])
        return certain, certain[-1], text[done:], [(p - done, q[common:]) for p, q in after]

    def run(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        out: list[int] = []
        state, moves = self._start, self._moves
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                before, pending, paths = self._states[state]
                if len(self._states) >= KEPT_STATES or len(pending) >= OPEN_BYTES:
                    return out + self._follow(before, pending + piece[at:])
                certain, before, rest, paths = self._step(before, pending, paths, byte)
                move = moves[state << 8 | byte] = certain, self._state(before, rest, paths)
            if move[0]:
                out += move[0]
            state = move[1]
        paths = self._states[state][2]
        out += paths[-1][1]  # the last open place is the end
        return out

    def _follow(self, before: int, text: bytes) -> list[int]:
        """As `run`, from an open state on, without making states: the transitions are followed depth first, the longest token first.

        One path leads to a place at most (the tokens of the bytes before it), so a place from which nothing goes on is
        never come to again, and the work is in proportion to the bytes.
        """
        ranks, sizes, pairs, n = self.ranks, self.sizes, self._pairs, len(text)
        out: list[int] = []
        ends = [0]  # where each token of the path begins, and the path's end
        dead: set[int] = set()
        last, at, upto = before, 0, n
        while at < n:
            for size in sizes[text[at:at + _Sizes.HEAD]]:
                end = at + size
                if end > upto:
                    continue
                token = ranks.get(text[at:end])
                if token is None or end in dead:
                    continue
                fits = pairs.get(last << 32 | token)
                if fits if fits is not None else self._may_follow(last, token):
                    out.append(token)
                    ends.append(end)
                    last, at, upto = token, end, n
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                # Nothing goes on from here: the token before it has to be a shorter one.
                dead.add(at)
                upto = ends.pop() - 1
                out.pop()
                at, last = ends[-1], out[-1] if out else before
        return out


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers, made when first asked for.

    When the table is full it becomes the old one, and what is asked for again moves over.
    """

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.transducer.ranks.get(raw)
            ids = self.transducer.run(raw) if whole is None else [whole]
            found = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            if len(raw) > 64:
                return found
        if len(self) >= KEPT_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class _Parts(dict):
    """Ids of parts, in the same way: the old table gives back what is asked for again."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = b"".join(self.codec.encode_portions(part))
            if len(part) > KEPT_BYTES:
                return found
        if len(self) >= KEPT_PARTS:
            self.old = dict(self)
            self.clear()
        self[part] = found
        return found


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _plain_words(parts: pa.LargeStringArray) -> np.ndarray:
    """Whether each part is ASCII letters alone, or with a space in front."""
    data, offsets = buffers(parts)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)))
    sizes = np.diff(offsets)
    spaces = np.append(data, 0)[offsets[:-1]] == 0x20
    return (sizes > spaces) & (np.diff(letters[offsets]) + spaces == sizes)


class Codec:
    """`parts`: the pattern begins a piece at every space behind another character than white space, whatever follows.
    `words`: ASCII letters alone, or with a space in front, are one piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, parts: bool = False, words: bool = False):
        self.ranks, self.pattern, self.parts, self.words = ranks, pattern, parts, words

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "parts": self.parts, "words": self.words}

    @cached_property
    def _pieces(self) -> _Pieces:
        return _Pieces(Transducer(self.ranks))

    @cached_property
    def _known(self) -> _Parts:
        return _Parts(self)

    @cached_property
    def _find(self):
        return regex.compile(self.pattern)

    @cached_property
    def _bytes_of(self) -> pa.Array:
        """Bytes by id."""
        found: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            found[i] = token
        return pa.array(found, pa.large_binary())

    def encode_portions(self, text: str) -> Iterator[bytes]:
        """The ids of a text, portion by portion."""
        ids = self._pieces.__getitem__
        if len(text) < 8 * PORTION:
            yield b"".join(map(ids, self._find.findall(text)))
            return
        matches = (m.group() for m in self._find.finditer(text))
        while part := list(islice(matches, PORTION)):
            yield b"".join(map(ids, part))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_portions(text)), "<u4")

    def encode_column(self, column: pa.Array, together: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets of texts in them) for runs of texts of bounded size; a null is an empty text."""
        data, offsets = buffers(column)
        known, words = self._known.__getitem__, self._pieces.__getitem__
        for lo, hi in slices(offsets, together or TOGETHER):
            own, where = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            if not len(own):
                yield np.zeros(0, np.uint32), where
                continue
            starts = part_starts(own, where) if self.parts else where[:-1][np.diff(where) > 0]
            cuts = pa.py_buffer(np.append(starts, len(own)).astype(np.int64))
            coded = pa.LargeStringArray.from_buffers(len(starts), cuts, pa.py_buffer(own.tobytes())).dictionary_encode()
            own_parts = coded.dictionary
            plain = _plain_words(own_parts).tolist() if self.words else [False] * len(own_parts)
            # Words of letters are one piece and kept as that.
            made = [words(part) if one else known(part)
                    for part, one in zip(own_parts.to_numpy(zero_copy_only=False).tolist(), plain)]
            ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 4)
            rows = coded.indices.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends, prepend=0)[rows]
            total = np.concatenate(([0], np.cumsum(sizes)))
            # Each part's ids lie at one place; they are copied to where the part stands.  Ids are no more than bytes.
            short = np.int32 if len(own) < 1 << 31 else np.int64
            at = np.repeat((ends[rows] - total[1:]).astype(short), sizes)
            at += np.arange(total[-1], dtype=short)
            yield np.frombuffer(b"".join(made), "<u4")[at], total[np.searchsorted(starts, where)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        found = self._bytes_of.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id is no token")
        _, where, body = found.buffers()
        ends = np.frombuffer(where, np.int64)
        return memoryview(body)[ends[0]:ends[len(found)]].tobytes() if body is not None else b""

    def decode_portions(self, ids: np.ndarray, portion: int = PORTION) -> Iterator[str]:
        """The text of the ids, as far as it is complete after each portion."""
        stream = Utf8Stream()
        for a in range(0, len(ids), portion):
            yield stream.feed(self.decode_bytes(ids[a:a + portion]))
        yield stream.close()


def _utf8_machine() -> np.ndarray:
    """Next state by state and byte.  0: between characters, 1-3: that many plain continuation bytes to come,
    4-7: after E0, ED, F0, F4, whose second byte has a narrower range, 8: ill-formed."""
    move = np.full((9, 256), 8, np.uint8)
    move[0, :0x80] = 0
    move[0, 0xC2:0xE0] = 1
    move[0, 0xE1:0xF0] = 2
    move[0, 0xF1:0xF4] = 3
    for state, lead, low, high, after in ((4, 0xE0, 0xA0, 0xC0, 1), (5, 0xED, 0x80, 0xA0, 1),
                                          (6, 0xF0, 0x90, 0xC0, 2), (7, 0xF4, 0x80, 0x90, 2)):
        move[0, lead] = state
        move[state, low:high] = after
    for state in (1, 2, 3):
        move[state, 0x80:0xC0] = state - 1
    return move


_MOVE = _utf8_machine()


class Utf8Stream:
    """Bytes in, characters out; what a portion cuts in two waits for the next one."""

    def __init__(self):
        self._waiting = b""

    def feed(self, portion: bytes) -> str:
        data = self._waiting + portion
        # The machine is between characters at the last byte that is not a continuation, 3 bytes back at most.
        at = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                at = len(data) - back
                break
        state = 0
        for byte in data[at:]:
            state = _MOVE[state, byte]
        end = len(data) if state in (0, 8) else at
        self._waiting = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._waiting = self._waiting, b""
        return rest.decode("utf-8", "replace")


def digests(docs: DataFrame, codec: Codec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; the ids are decoded again for the last."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")

    def decoded(ids: np.ndarray) -> str:
        digest = hashlib.sha256()
        for portion in shared.value.decode_portions(ids):
            digest.update(portion.encode())
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second = [], [], []
            for ids, where in shared.value.encode_column(batch.column(1), 2 * TOGETHER):
                for a, b in zip(where[:-1], where[1:]):
                    own = ids[a:b]
                    n.append(len(own))
                    first.append(hashlib.sha256(own.astype("<u4", copy=False)).hexdigest())
                    second.append(decoded(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """The documents with their token ids, in place of the text or beside it."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    at = docs.columns.index(text)
    ids = free_name([c for c in docs.columns if keep_text or c != text], ids)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            # Runs of texts of bounded size are handed on one by one, with their ids in one buffer.
            for flat, where in shared.value.encode_column(batch.column(at)):
                part = batch.slice(a, len(where) - 1)
                a += len(where) - 1
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(flat.view(np.int32)))
                columns = [c for k, c in enumerate(part.columns) if keep_text or k != at]
                yield pa.RecordBatch.from_arrays([*columns, lists], schema.names)
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, codec: Codec, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their token ids in place of the ids; a null list is the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(codec)
    at = tokens.columns.index(ids)
    text = free_name([c for c in tokens.columns if c != ids], text)
    schema = T.StructType([*[f for f in tokens.schema.fields if f.name != ids], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["".join(shared.value.decode_portions(np.array(x.as_py() or [], np.int64))) for x in batch.column(at)]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], schema.names)
    return tokens.mapInArrow(run, schema)
