r"""Alignment of two tokenizers over a corpus: which tokens of one share bytes with which tokens of the other.

Both tokenizers write a text as bytes.  Byte offsets where a token of A and a token of B both end cut the text into
groups; all token pairs of a group are linked.  The weight of an id pair is the number of documents that hold it
linked.

Work goes in Arrow tables.  A text is cut in front of every space that follows a character other than white space: there
both tokenizers begin a token whatever stands around (checked against the vocabulary of B when it is loaded, else texts
stay whole).  The parts of a batch are numbered by dictionary encoding, and each distinct one is encoded and aligned once:
lists of ids are flattened with their parent indices, byte lengths are summed up within each part, an Acero hash join on
(part, end) gives the common ends, and a second one on the group gives the pairs.  Parts met before come from a table
of bounded size.  For each document the numbers of its parts are added up, its distinct pairs come from `Table.group_by`,
and so do partial counts for each task, which Spark merges.  Encoding is done once: the pairs of each document are
stored, and its weights are looked up when the corpus counts are known, in a table sent to all tasks while its
measured size allows it (`LOOKUP_PAIRS`), by a join on the pair beyond that, with the same result.

Hot sources and groups of copies cost what other rows cost, as every row is encoded where it is read.

Defined results: a null or empty text, and one whose bytes under A or B differ from space + text (such as one with
U+2581), has no tokens: its numbers are 0 and its groups are the empty string.  Rows with the same or a null id are
documents of their own.  A link counts as best if its weight equals the highest of its A id, ties included.  Empty
input gives empty output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from framesift.llm.text import buffers, part_starts, slices
from framesift.session import materialise

BLANK = "▁"
#: Bytes of text that are cut into parts together.
SLICE = 2 << 20
#: Parts, and bytes of each, whose alignment is kept for the next batch.
KEPT_PARTS, KEPT_BYTES = 400_000, 64
#: Parts that are encoded together.
TOGETHER = 1 << 15
#: Rows that one join makes at most, as far as a single token of A allows.
JOIN_ROWS = 1 << 22
#: Distinct pairs that a task counts before it hands the counts on, and pairs in a row of counts.
COUNTED_PAIRS, ROW_PAIRS = 1 << 20, 1 << 15
#: Distinct pairs of the corpus that are sent to all tasks (at 9 bytes each).
LOOKUP_PAIRS = 8_000_000


class Tokenizers:
    """Two tokenizers by their files: A a byte-level BPE (tokenizers), B a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            self._json = file.read()
        with open(path_b, "rb") as file:
            self._proto = file.read()
        vocabulary = Tokenizer.from_str(self._json).get_vocab(with_added_tokens=True)
        self.size_a = max(vocabulary.values()) + 1
        byte_of = _byte_characters()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        model = sentencepiece.SentencePieceProcessor(model_proto=self._proto)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.size_b = len(pieces)
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        #: Whether parts can be encoded by themselves: no piece of B reaches over a blank behind another character.
        self.cuts = not any(x != BLANK and y == BLANK for p in pieces for x, y in zip(p, p[1:]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not isinstance(getattr(type(self), k, None), cached_property)}

    @cached_property
    def _a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self._json)
        found.encode_special_tokens = True
        return found

    @cached_property
    def _b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self._proto)

    def encode_a(self, texts: list[str]) -> pa.Array:
        """Ids of space + text for each of `texts`, which have the space already."""
        found = [e.ids for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        return pa.array(found, pa.large_list(pa.int64()))

    def encode_b(self, texts: list[str]) -> pa.Array:
        found = self._b.encode([t[1:] for t in texts], num_threads=1)
        return pa.array(found, pa.large_list(pa.int64()))

    @cached_property
    def token_a(self) -> pa.Array:
        return pa.array(self.bytes_a, pa.large_binary())

    @cached_property
    def token_b(self) -> pa.Array:
        return pa.array(self.bytes_b, pa.large_binary())

    @cached_property
    def length_a(self) -> np.ndarray:
        return np.array([len(x) for x in self.bytes_a], np.int64)

    @cached_property
    def length_b(self) -> np.ndarray:
        return np.array([len(x) for x in self.bytes_b], np.int64)

    @cached_property
    def written(self) -> pa.Array:
        """Ids as they are written in groups: of A before `,` and `|`, of B before `,` and `;`."""
        a, b = [str(i) for i in range(self.size_a)], [str(i) for i in range(self.size_b)]
        return pa.array([f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b], pa.large_string())


def _byte_characters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    found = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return found | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, parent indices) of a list array."""
    return (pc.list_flatten(lists).to_numpy(zero_copy_only=False),
            pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64))


def _running(values: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Sums of `values` up to and including each one within its parent; parents stand in order."""
    total = np.cumsum(values)
    first = np.searchsorted(parents, parents)
    return total - np.where(first > 0, total[first - 1], 0)


class Aligned:
    """What is known of some parts: numbers of each, its groups as written, and its pairs with their links."""

    def __init__(self, n_a, n_b, n_groups, n_links, good, groups, pairs, times, offsets):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.good = n_a, n_b, n_groups, n_links, good
        self.groups, self.pairs, self.times, self.offsets = groups, pairs, times, offsets

    def __len__(self) -> int:
        return len(self.n_a)

    def plus(self, other: "Aligned") -> "Aligned":
        join = np.concatenate
        return Aligned(*(join((getattr(self, k), getattr(other, k))) for k in ("n_a", "n_b", "n_groups", "n_links", "good")),
                       pa.concat_arrays([self.groups, other.groups]), join((self.pairs, other.pairs)),
                       join((self.times, other.times)), join((self.offsets, other.offsets[1:] + self.offsets[-1])))


def _nothing() -> Aligned:
    none, small = np.zeros(0, np.int64), np.zeros(0, np.int32)
    return Aligned(small, small, small, none, np.zeros(0, bool), pa.array([], pa.large_string()), small, none, np.zeros(1, np.int64))


def align(parts: list[str], by: Tokenizers) -> Aligned:
    """Alignment of each of `parts` (space + text)."""
    n = len(parts)
    ids_a, of_a = _flat(by.encode_a(parts))
    ids_b, of_b = _flat(by.encode_b(parts))
    end_a, end_b = _running(by.length_a[ids_a], of_a), _running(by.length_b[ids_b], of_b)
    n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    raw = [p.encode("utf-8", "replace") for p in parts]
    good = _equal(by.token_a, ids_a, n_a, raw) & _equal(by.token_b, ids_b, n_b, raw)
    keep_a, keep_b = good[of_a], good[of_b]
    ids_a, of_a, end_a = ids_a[keep_a], of_a[keep_a], end_a[keep_a]
    ids_b, of_b, end_b = ids_b[keep_b], of_b[keep_b], end_b[keep_b]
    n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)

    # Common ends: tokens without bytes end where the one before them does, so each end counts once.
    left = pa.table({"part": of_a, "end": end_a}).group_by(["part", "end"], use_threads=False).aggregate([])
    right = pa.table({"part": of_b, "end": end_b}).group_by(["part", "end"], use_threads=False).aggregate([])
    common = left.join(right, ["part", "end"], join_type="inner", use_threads=False)
    part, end = (common[c].to_numpy() for c in ("part", "end"))
    stride = int(max(end_a.max(initial=0), end_b.max(initial=0))) + 1
    ends = np.sort(part * stride + end)
    group_a = np.searchsorted(ends, of_a * stride + end_a)
    group_b = np.searchsorted(ends, of_b * stride + end_b)
    n_groups = np.bincount(ends // stride, minlength=n)
    size_a, size_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    group_part = ends // stride
    n_links = _sums(size_a * size_b, group_part, n)

    groups = _written(by, ids_a, ids_b, group_a, group_b, np.bincount(np.concatenate((of_a, of_b)), minlength=n))
    pairs = _pairs(ids_a, group_a, ids_b, group_b, group_part, by.size_b)
    order = np.lexsort((pairs["pair"].to_numpy(), pairs["part"].to_numpy()))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(pairs["part"].to_numpy(), minlength=n))))
    kind = np.int32 if by.size_a * by.size_b < 1 << 31 else np.int64
    return Aligned(n_a.astype(np.int32), n_b.astype(np.int32), n_groups.astype(np.int32), n_links, good, groups,
                   pairs["pair"].to_numpy()[order].astype(kind), pairs["times"].to_numpy()[order], offsets)


def _equal(tokens: pa.Array, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of each part's tokens are its own."""
    found = tokens.take(pa.array(ids))
    _, where, body = found.buffers()
    joined = bytes(body or b"")
    if joined == b"".join(raw):
        ends = np.frombuffer(where, np.int64)[np.cumsum(sizes)] if len(ids) else np.zeros(len(raw), np.int64)
        return ends == np.cumsum([len(r) for r in raw])
    cuts = np.frombuffer(where, np.int64)[np.concatenate(([0], np.cumsum(sizes)))]
    return np.array([joined[a:b] == r for a, b, r in zip(cuts[:-1], cuts[1:], raw)], bool)


def _sums(values: np.ndarray, parents: np.ndarray, n: int) -> np.ndarray:
    """The sum for each of `n` parents, whose values stand in order."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[np.searchsorted(parents, np.arange(n + 1))])


def _written(by: Tokenizers, ids_a, ids_b, group_a, group_b, sizes: np.ndarray) -> pa.Array:
    """The groups of each part as text, every group closed by a semicolon."""
    last_a = np.append(group_a[1:] != group_a[:-1], True)[:len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[:len(group_b)]
    index = np.concatenate((ids_a + by.size_a * last_a, 2 * by.size_a + ids_b + by.size_b * last_b))
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    tokens = by.written.take(pa.array(index[order]))
    _, where, body = tokens.buffers()
    cuts = np.frombuffer(where, np.int64)[np.concatenate(([0], np.cumsum(sizes)))] if len(tokens) else np.zeros(len(sizes) + 1, np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(cuts), body or pa.py_buffer(b""))


def _pairs(ids_a, group_a, ids_b, group_b, group_part, size_b: int) -> pa.Table:
    """(part, pair, times): the distinct pairs of each part and how many of its links have them."""
    left = pa.table({"group": group_a, "a": ids_a}).group_by(["group", "a"], use_threads=False).aggregate([([], "count_all")])
    right = pa.table({"group": group_b, "b": ids_b}).group_by(["group", "b"], use_threads=False).aggregate([([], "count_all")])
    right = right.rename_columns({"count_all": "times_b"})
    left = left.sort_by([("group", "ascending")])
    # Joined rows that each row on the left makes, to join in portions of bounded size.
    fan = np.bincount(right["group"].to_numpy(), minlength=len(group_part) + 1)[left["group"].to_numpy()] if len(left) else np.zeros(0, int)
    portion = np.cumsum(fan) // JOIN_ROWS
    found = []
    for p in range(int(portion[-1]) + 1 if len(portion) else 0):
        a, b = np.searchsorted(portion, [p, p + 1])
        if a == b:
            continue
        own = left.slice(int(a), int(b - a)).join(right, "group", join_type="inner", use_threads=False)
        own = pa.table({"part": group_part[own["group"].to_numpy()], "pair": own["a"].to_numpy() * size_b + own["b"].to_numpy(),
                        "times": own["count_all"].to_numpy() * own["times_b"].to_numpy()})
        found.append(own.group_by(["part", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns({"times_sum": "times"}))
    if not found:
        return pa.table({"part": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)})
    if len(found) == 1:
        return found[0]
    return (pa.concat_tables(found).group_by(["part", "pair"], use_threads=False).aggregate([("times", "sum")])
            .rename_columns({"times_sum": "times"}))


class Lexicon:
    """Numbers of parts, with the alignment of those met lately."""

    def __init__(self, by: Tokenizers):
        self.by = by
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.known = _nothing()

    def look_up(self, parts: pa.Array) -> np.ndarray:
        """The row of `known` of each distinct part; valid until the next call."""
        if len(self.known) > KEPT_PARTS or len(self.known.pairs) > 8 * KEPT_PARTS:
            self._clear()
        found = parts.to_pylist()
        rows = np.array([self.number.get(p, -1) for p in found], np.int64)
        new = np.flatnonzero(rows < 0)
        for lo in range(0, len(new), TOGETHER):
            own = new[lo:lo + TOGETHER]
            texts = [found[i] for i in own]
            rows[own] = np.arange(len(own)) + len(self.known)
            for text, row in zip(texts, rows[own].tolist()):
                if len(text) <= KEPT_BYTES:
                    self.number[text] = row
            self.known = self.known.plus(align(texts, self.by))
        return rows


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def _documents(texts: pa.Array, lexicon: Lexicon) -> Iterator[pa.Table]:
    """For runs of texts: numbers, digest of the groups, and distinct pairs of each."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    joined = pc.binary_join_element_wise(space, pc.fill_null(texts.cast(pa.large_string()), ""), nothing)
    empty = pc.equal(pc.binary_length(joined), 1).to_numpy(zero_copy_only=False)
    data, offsets = buffers(joined)
    for lo, hi in slices(offsets, SLICE):
        own, where = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        n = hi - lo
        starts = part_starts(own, where) if lexicon.by.cuts else where[:-1]
        text_of = np.searchsorted(where, starts, "right") - 1
        keep = ~empty[lo:hi][text_of]
        cuts = np.append(starts, len(own))
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(own.tobytes()))
        coded = parts.filter(pa.array(keep)).dictionary_encode()
        rows = lexicon.look_up(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if keep.any() else np.zeros(0, np.int64)
        text_of = text_of[keep]
        known = lexicon.known
        # A text with a part that does not come back has no tokens.
        bad = np.bincount(text_of, weights=~known.good[rows], minlength=n) > 0
        stay = ~bad[text_of]
        rows, text_of = rows[stay], text_of[stay]
        numbers = {c: _sums(getattr(known, c)[rows], text_of, n) for c in _COLUMNS}
        bounds = np.searchsorted(text_of, np.arange(n + 1))
        hashes = [_digest(known.groups, rows[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        text, pair, times = _text_pairs(known, rows, text_of)
        lists = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
        yield pa.table({**numbers, "groups_sha256": pa.array(hashes, pa.string()),
                        "pairs": pa.LargeListArray.from_arrays(pa.array(lists), pa.array(pair)),
                        "times": pa.LargeListArray.from_arrays(pa.array(lists), pa.array(times))})


def _digest(groups: pa.Array, rows: np.ndarray) -> str:
    if not len(rows):
        return ""
    found, held = hashlib.sha256(), b""
    for lo in range(0, len(rows), 1 << 18):
        own = groups.take(pa.array(rows[lo:lo + (1 << 18)]))
        _, where, body = own.buffers()
        ends = np.frombuffer(where, np.int64)
        found.update(held)
        # The last semicolon separates nothing.
        found.update(memoryview(body)[ends[0]:ends[len(own)] - 1])
        held = b";"
    return found.hexdigest()


def _text_pairs(known: Aligned, rows: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of the distinct pairs of each text, sorted by both."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    seen = pa.table({"text": text_of, "row": rows}).group_by(["text", "row"], use_threads=False).aggregate([([], "count_all")])
    row, text, often = (seen[c].to_numpy() for c in ("row", "text", "count_all"))
    size = known.offsets[row + 1] - known.offsets[row]
    which = np.repeat(np.arange(len(row)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + known.offsets[row][which]
    flat = pa.table({"text": text[which], "pair": known.pairs[at], "times": known.times[at] * often[which]})
    found = flat.group_by(["text", "pair"], use_threads=False).aggregate([("times", "sum")])
    text, pair, times = (found[c].to_numpy() for c in ("text", "pair", "times_sum"))
    order = np.argsort(text, kind="stable")
    return text[order], pair[order], times[order]


class _Counts:
    """Partial counts of one task: in how many documents each pair is linked."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.tables: list[pa.Table] = []
        self.waiting = self.distinct = 0

    def add(self, pairs: pa.Array) -> None:
        own = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        self.tables.append(own.rename_columns({"count_all": "docs"}))
        self.waiting += len(own)
        if self.waiting > COUNTED_PAIRS:
            self._merge()

    def _merge(self) -> None:
        own = pa.concat_tables(self.tables).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
        self.tables = [own.rename_columns({"docs_sum": "docs"})]
        self.distinct, self.waiting = len(own), 0

    @property
    def full(self) -> bool:
        return self.distinct > COUNTED_PAIRS

    def take(self) -> pa.Table | None:
        if not self.tables:
            return None
        self._merge()
        found = self.tables[0]
        self._clear()
        return found


def _found(docs: DataFrame, by: Tokenizers, text: str, key: str) -> DataFrame:
    """Rows of documents (with their pairs) and, with `docs` not null, of partial counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(by)
    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    number = pa.int32() if by.size_a * by.size_b < 1 << 31 else pa.int64()
    kind = "int" if number == pa.int32() else "bigint"

    def counted(counts: pa.Table | None, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(counts) if counts is not None else 0, ROW_PAIRS):
            own = counts.slice(lo, ROW_PAIRS)
            none = [pa.nulls(1, pa.int64())] * len(_COLUMNS)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own[c].combine_chunks().cast(t))
                     for c, t in (("pair", number), ("docs", pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_type), *none, pa.nulls(1, pa.string()), lists[0], pa.nulls(1, pa.list_(pa.int32())), lists[1]], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts, key_type = _lexicon(shared), _Counts(), None
        for batch in batches:
            key_type, at = batch.column(0).type, 0
            for own in _documents(batch.column(1), lexicon):
                counts.add(pc.list_flatten(own["pairs"]))
                for lo in range(0, len(own), 1000):
                    some = own.slice(lo, 1000)
                    lists = {c: some[c].combine_chunks().cast(pa.list_(t)) for c, t in (("pairs", number), ("times", pa.int32()))}
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at + lo, len(some)), *(some[c].combine_chunks() for c in _COLUMNS),
                         some["groups_sha256"].combine_chunks(), lists["pairs"], lists["times"],
                         pa.nulls(len(some), pa.list_(pa.int64()))], NAMES)
                at += len(own)
                if counts.full:
                    yield from counted(counts.take(), key_type)
        yield from counted(counts.take(), key_type)
    kept = slim.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _COLUMNS)
    return slim.mapInArrow(run, f"doc_id {kept}, {numbers}, groups_sha256 string, pairs array<{kind}>, times array<int>, docs array<long>")


NAMES = ["doc_id", *_COLUMNS, "groups_sha256", "pairs", "times", "docs"]
_lexicons: dict[int, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    """One for each Python worker, which is used by task after task."""
    if id(shared.value) not in _lexicons:
        _lexicons.clear()
        _lexicons[id(shared.value)] = Lexicon(shared.value)
    return _lexicons[id(shared.value)]


def weights(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): documents that hold each pair, and whether no pair of its A id has more.

    An A id has at most as many pairs as B has ids, so the window over it is bounded.
    """
    partial = found.where("docs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    merged = partial.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"))
    of_a = F.expr(f"pair div {size_b}")
    return merged.select("pair", "docs", (F.col("docs") == F.max("docs").over(W.partitionBy(of_a))).alias("best"))


def _weighed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` with n_best and count_sum, by looking their pairs up in a table sent to all tasks."""
    arrow = table.toArrow().combine_chunks().sort_by("pair")
    pairs, docs, best = (arrow[c].to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best"))
    docs = docs.astype(np.int32) if docs.max(initial=0) < 1 << 31 else docs
    shared = rows.sparkSession.sparkContext.broadcast((pairs, docs, best))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("pairs"))
            pair, of = _flat(lists)
            times = pc.list_flatten(batch.column(batch.schema.get_field_index("times"))).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pairs, pair)
            sums = [_sums(times * value, of, batch.num_rows) for value in (best[at].astype(np.int64), docs[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same by a join on the pair: each document's pairs go to their weights and its sums come back."""
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "alignment_rows")
    flat = numbered.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*")
    sums = (flat.join(table, flat["pairs"] == table["pair"])
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("times") * F.col("docs")).alias("count_sum")))
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    return numbered.join(sums, "row", "left").select(
        *names, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def links(docs: DataFrame, by: Tokenizers, text: str = "text", key: str = "doc_id", lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """One row per document: tokens, groups, links, and how common its links are in the corpus."""
    found = materialise(_found(docs, by, text, key), "alignment")
    table = materialise(weights(found, by.size_b), "alignment_weights")
    rows = found.where("docs IS NULL").select("doc_id", *_COLUMNS, "groups_sha256", "pairs", "times")
    weighed = _weighed if table.count() <= lookup_pairs else _joined
    return weighed(rows, table).select("doc_id", *_COLUMNS, "n_best", "count_sum", "groups_sha256")


def pair_counts(docs: DataFrame, by: Tokenizers, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(a, b, docs, best) of every pair of ids that some document holds linked."""
    found = materialise(_found(docs, by, text, key), "alignment")
    return weights(found, by.size_b).select(F.expr(f"cast(pair div {by.size_b} as int)").alias("a"),
                                            F.expr(f"cast(pair % {by.size_b} as int)").alias("b"), "docs", "best")
