r"""Class-based n-gram language model: exchange clustering, class transitions and word emissions.

log10 P(text) = sum over its words w of log10 P(class(w) | class before) + log10 P(w | class(w)), and the
transition to the end of the text; before the first word stands the end class.

* Word counts of all training texts: tasks count their words, Spark adds up.  The table has a row per word
  and grows with the corpus, so it stays a table.
* Classes: every word that occurs `MIN_COUNT` times is clustered, into `CLASSES` classes for 1,000 words and
  more with the fourth root of their number.  The `EXACT` most frequent words are dealt to `CLASSES` classes by
  exchange on the driver (each word in turn moves to the class that gives the training text the highest
  class-bigram likelihood); the next most frequent words begin the other classes.  All clustered words but the
  `EXACT` first then move in `ROUNDS` rounds, which are Spark jobs: the neighbours of each word are stored once,
  each round counts classes by class before, and every word goes to the class that predicts its neighbours'
  classes best, its own part in the counts taken out.  A round after the first counts only if it raises the
  likelihood.  Words below `MIN_COUNT` share one class; words never seen belong to one of `RULES` classes by a
  checksum of their last two bytes.
* Words are known by 63-bit hashes of their bytes.  What tasks look them up in is sent in parts of `SHARED` words:
  one part up to that many, else texts go through the parts one after another.  A class for each clustered word
  (four bytes) is sent whole.

Smoothing: 0.5 is added to every count; each rule class and the base model have one more type for what was
never seen.  Nothing is capped.  With `clustered` given, only so many words are clustered and all others, seen
or not, belong to the rule classes.

Defined results: a null or empty text has one token, its end; without training texts all counts are 0; ties
in frequency go by the words' bytes; a document that is repeated (same id and text) counts in training each
time and gives one result row each time; a null id counts as the empty text for the held-out rule; empty
input gives empty output; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.llm.common import fold
from framesift.llm.packed import bucket_count
from framesift.llm.text import _WHITE, buffers, slices, words as hashes
from framesift.session import materialise

EXACT = 1000
CLASSES = 64
RULES = 32
MIN_COUNT = 2
SHARED = 1 << 23
ROUNDS = 3
EXCHANGES = 5
ALPHA = 0.5
#: Distinct words a task holds before it hands its counts on, neighbours it holds before it counts them, and
#: (word, class) counts that are scored together.
HELD_WORDS = 200_000
HELD_PAIRS = 1 << 21
PORTION = 1 << 14
END = b""


def rule(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RULES


_RULE_1 = np.array([rule(bytes([b])) for b in range(256)], np.uint8)
_RULE_2 = np.array([rule(bytes([a, b])) for a in range(256) for b in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    data, offsets = buffers(batch.column(column))
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield data[a:b].tobytes().lower().split()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()),
                                            pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return found
    for batch in batches:
        for words in _texts(batch, 0):
            held.update(words)
            held[END] += 1
            if len(held) > HELD_WORDS:
                yield out()
    yield out()


@dataclass
class Model:
    shared: list[bytes]         # the most frequent words, most frequent first, whose classes exchange found
    ends: int                   # training texts
    tokens: int                 # N
    types: int                  # V
    unit_class: np.ndarray      # class of each unit: clustered words, words too rare, rules, end
    transition: np.ndarray      # log10 P(class | class before)
    class_total: np.ndarray     # log10 of the denominators of the emissions, 0 for the end
    vocabulary: DataFrame       # (key, n, unit) of all words
    parts: int                  # in which it is sent
    sent: dict = field(default_factory=dict)

    @property
    def units(self) -> np.ndarray:
        """Unit by the number of a shared word, and of a rule from the end."""
        first_rule = len(self.unit_class) - RULES - 1
        return np.concatenate((np.arange(len(self.shared)), first_rule + np.arange(RULES)[::-1]))


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, key of each word, its rule, first word of each row) over slices of a column's texts."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets):
        body, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        found, start = hashes(body, at)
        inside = ~_WHITE[body]
        cut = np.zeros(len(body) + 1, bool)
        cut[at] = True
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        last = np.flatnonzero(last)
        low = _LOWER[body]
        rules = np.where(begin[last], _RULE_1[low[last]],
                         _RULE_2[low[np.maximum(last - 1, 0)].astype(np.int64) << 8 | low[last]])
        yield lo, hi, (found >> np.uint64(1)).astype(np.int64), rules, start


def _resolve(keys: np.ndarray, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of the words that this part of the vocabulary has, 0 for others; their keys become -1 - unit."""
    known, counts, units = part
    n = np.zeros(len(keys), np.int64)
    if len(known) and len(keys):
        own, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        n = np.where(hit, counts[at], 0)[back]
        keys[:] = np.where(hit, -1 - units[at], own)[back]
    return n


def _part(model: Model, part: int):
    """A part of the vocabulary, sorted by key, as a broadcast."""
    if part not in model.sent:
        rows = model.vocabulary.where(F.col("key") % model.parts == part).toArrow()  # about SHARED rows
        key = rows.column("key").to_numpy()
        order = np.argsort(key)
        model.sent[part] = model.vocabulary.sparkSession.sparkContext.broadcast(
            (key[order], rows.column("n").to_numpy()[order], rows.column("unit").to_numpy()[order].astype(np.int64)))
    return model.sent[part]


def _blobs(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of a column of packed numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = body.to_pybytes()[offsets[0]:offsets[-1]] if body is not None else b""
    return np.frombuffer(data, kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _looked_up(sent, batch: pa.RecordBatch):
    """(first row, last row, keys, rules, starts, known, counted) over slices of rows of (..., body, rules, known, counted).

    A body is a text, or the keys and rules of its words if they have been through a part of the vocabulary before.
    """
    body, rules, known, counted = batch.columns[-4:]
    known, counted = known.to_numpy(zero_copy_only=False), counted.to_numpy(zero_copy_only=False)
    if pa.types.is_string(body.type) or pa.types.is_large_string(body.type):
        found = _tokens(body)
    else:
        keys, start = _blobs(body, np.int64)
        found = [(0, len(body), keys.copy(), _blobs(rules, np.uint8)[0], start)]
    for lo, hi, keys, rule_of, start in found:
        n = _resolve(keys, sent.value)
        yield (lo, hi, keys, rule_of, start, known[lo:hi] + _by_row((n > 0).astype(np.int64), start),
               counted[lo:hi] + _by_row(np.where(n > 0, np.log10(n + ALPHA), 0.0), start))


def _by_row(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    if values.dtype.kind == "i":
        return total[start[1:]] - total[start[:-1]]
    out = np.zeros(len(start) - 1)
    some = np.flatnonzero(start[1:] > start[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, start[some])
    return out


def _prepared(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (..., text) with its words looked up in all parts of the vocabulary but the last."""
    docs = docs.select(*[c for c in docs.columns if c != "text"], F.coalesce("text", F.lit("")).alias("body"),
                       F.lit(b"").alias("rules"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("counted"))
    others = docs.select(docs.columns[:-4])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in others.schema.fields],
                        "body binary, rules binary, known long, counted double"])
    for part in range(model.parts - 1):
        sent = _part(model, part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, keys, rules, start, known, counted in _looked_up(sent, batch):
                    packed = [[x[a:b].tobytes() for a, b in zip(start[:-1], start[1:])] for x in (keys, rules)]
                    rest = batch.slice(lo, hi - lo).columns[:-4]
                    yield pa.RecordBatch.from_arrays(
                        [*rest, pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()),
                         pa.array(known), pa.array(counted)], batch.schema.names)
        docs = materialise(docs.mapInArrow(run, schema), "looked_up")
    return docs


def _chain(keys: np.ndarray, rules: np.ndarray, start: np.ndarray, units: int) -> np.ndarray:
    """Units of whole texts; the end stands between, before and behind them."""
    found = np.where(keys < 0, -1 - keys, units - RULES - 1 + rules.astype(np.int64))
    return np.insert(found, start, units - 1)


def _neighbours(sent, buckets: int, exact: int, units: int):
    """The neighbours in a task's texts as (bucket, block of words, neighbours and counts).

    A neighbour is twice its unit, and one more if it stands behind the word.  The words are the clustered ones from
    `exact` on.  All pairs are counted by the units that are not among these, too, with words among these under
    their rules; the words of these rows are -1 less the unit's number.
    """
    rare = units - RULES - 2
    size = exact + units - rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        total = np.zeros(size * size, np.int64)

        def out(word: np.ndarray, other: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = np.where(word < 0, -1 - word, word) % buckets
            order = np.argsort(bucket, kind="stable")
            word, other, n, bucket = word[order], other[order], n[order], bucket[order]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            cut = np.append(edge, len(bucket))
            blocks = [word[a:b].astype(np.int32).tobytes() + other[a:b].astype(np.int32).tobytes() + n[a:b].astype(np.int64).tobytes()
                      for a, b in zip(cut[:-1], cut[1:])]
            for a in range(0, len(blocks), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[a:a + 2048]].astype(np.int32)),
                                                  pa.array(blocks[a:a + 2048], pa.binary())], ["bucket", "block"])

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from out(found >> 32, found & 0xFFFFFFFF, n)
        for batch in batches:
            for _, _, keys, rules, start, _, _ in _looked_up(sent, batch):
                chain = _chain(keys, rules, start, units)
                lumped = np.insert(units - RULES - 1 + rules.astype(np.int64), start, units - 1)
                moved = (chain >= exact) & (chain < rare)
                fixed = np.where(moved, lumped, chain)
                fixed = np.where(fixed < exact, fixed, fixed - rare + exact)
                np.add(total, np.bincount(fixed[:-1] * size + fixed[1:], minlength=size * size), out=total)
                a, b = chain[:-1], chain[1:]
                held.append((a << 32 | b << 1 | 1)[moved[:-1]])
                held.append((b << 32 | a << 1)[moved[1:]])
                rows += len(held[-1]) + len(held[-2])
                if rows > HELD_PAIRS:
                    yield from flush()
                    rows = 0
        if rows:
            yield from flush()
        at = np.flatnonzero(total)
        if len(at):
            yield from out(-1 - at // size, at % size, total[at])
    return run


def _merged(rows: pa.Table) -> pa.Table:
    """(word, neighbours, counts) of a bucket of blocks."""
    parts = []
    for block in rows.column("block"):
        data = block.as_buffer()
        n = len(data) // 16
        parts.append((np.frombuffer(data, np.int32, n), np.frombuffer(data, np.int32, n, 4 * n), np.frombuffer(data, np.int64, n, 8 * n)))
    word, other, n = (np.concatenate(x) for x in zip(*parts))
    key = word.astype(np.int64) << 32 | other
    order = np.argsort(key)
    key, word, other = key[order], word[order], other[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    word, other, n = word[first], other[first], np.add.reduceat(n[order], first)
    edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    cut = np.append(edge, len(word))
    return pa.table({"word": pa.array(word[edge], pa.int32()),
                     "others": pa.array([other[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     "ns": pa.array([n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _classed(batch: pa.RecordBatch, own: np.ndarray):
    """(words, row, unit, whether behind, class, count) of each neighbour that has a class."""
    words = batch.column(0).to_numpy()
    other, start = _blobs(batch.column(1), np.int32)
    n = _blobs(batch.column(2), np.int64)[0]
    row = np.repeat(np.arange(len(words)), np.diff(start))
    unit = other >> 1
    group = own[unit]
    some = group >= 0
    return words, row[some], unit[some], (other & 1)[some], group[some], n[some]


def _grid(contexts: DataFrame, own: np.ndarray, number: int, exact: int) -> np.ndarray:
    """Counts of class pairs with at least one word that moves."""
    sent = contexts.sparkSession.sparkContext.broadcast(own)
    rare = len(own) - RULES - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number * number)
        for batch in batches:
            words, row, unit, behind, group, n = _classed(batch, sent.value)
            mine = sent.value[words][row].astype(np.int64)
            # A pair of two moving words is counted where the first one is.
            use = (mine >= 0) & ((behind == 1) | (unit < exact) | (unit >= rare))
            pair = np.where(behind == 1, mine * number + group, group.astype(np.int64) * number + mine)
            total += np.bincount(pair[use], n[use], minlength=number * number)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["pair", "n"])
    found = contexts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # number^2 rows at most
    out = np.zeros(number * number)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    sent.unpersist()
    return out.reshape(number, number)


def best_classes(words: np.ndarray, row: np.ndarray, behind: np.ndarray, group: np.ndarray, n: np.ndarray,
                 own: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """The class of the first `classes` that predicts the neighbours of each word best, without the word's own counts."""
    number = len(grid)
    heads = np.stack((grid.sum(0), grid.sum(1)))                # by side
    wide = heads + ALPHA * number
    logs = np.empty((2 * number, classes), np.float32)          # by neighbour and side
    logs[0::2] = np.log((grid[:, :classes] + ALPHA) / wide[0, :classes])
    logs[1::2] = np.log((grid[:classes].T + ALPHA) / wide[1, :classes])
    key, back = np.unique(row * (2 * number) + group.astype(np.int64) * 2 + behind, return_inverse=True)
    x = np.bincount(back, n, minlength=len(key))
    row, column = key // (2 * number), key % (2 * number)
    old = own[words].astype(np.int64)
    out = old.copy()
    start = np.searchsorted(row, np.arange(len(words) + 1))
    # What is left of the old class without the word, and whether anything is.
    mine, side, near = old[row], column & 1, column >> 1
    parts = np.stack([np.bincount(row[side == s], x[side == s], minlength=len(words)) for s in (0, 1)])
    left = np.where(side == 1, grid[mine, near], grid[near, mine]) - x
    stay = x * np.log((np.maximum(left, 0) + ALPHA) / (wide[side, mine] - parts[side, row]))
    alone = (old >= 0) & (heads[1, old] <= parts[1])
    lo = 0
    while lo < len(words):
        hi = max(int(np.searchsorted(start, start[lo] + PORTION, "right")) - 1, lo + 1)
        hi = min(hi, len(words))
        a, b = start[lo], start[hi]
        some = np.flatnonzero(start[lo + 1:hi + 1] > start[lo:hi])
        score = np.zeros((hi - lo, classes), np.float32)
        if len(some):
            score[some] = np.add.reduceat(logs[column[a:b]] * x[a:b, None].astype(np.float32), start[lo + some] - a, axis=0)
            again = some[old[lo + some] >= 0]
            kept = np.zeros(hi - lo)
            kept[some] = np.add.reduceat(stay[a:b], start[lo + some] - a)
            score[again, old[lo + again]] = kept[again]
        out[lo:hi] = np.where(alone[lo:hi], old[lo:hi], score.argmax(1))
        lo = hi
    return out


def _moved(contexts: DataFrame, own: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """The classes after a round."""
    sent = contexts.sparkSession.sparkContext.broadcast((own, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grid = sent.value
        for batch in batches:
            words, row, _, behind, group, n = _classed(batch, own)
            found = best_classes(words, row, behind, group, n, own, grid, classes)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(found.astype(np.int32))], ["word", "class"])
    found = contexts.mapInArrow(run, "word int, class int").toArrow()  # eight bytes for each clustered word
    out = own.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    sent.unpersist()
    return out


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Class of each unit from the counts of unit pairs; units from `clustered` on keep classes of their own."""
    n = len(pairs)
    k = max(1, min(classes, clustered))
    total = k + n - clustered
    own = np.concatenate((np.arange(clustered) % k, k + np.arange(n - clustered)))
    pairs = pairs.astype(float)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))
    hot = np.zeros((n, total))
    hot[np.arange(n), own] = 1
    after, before = pairs @ hot, pairs.T @ hot      # by unit and class of its neighbour
    grid = hot.T @ after
    at = np.arange(k)
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            old = own[w]
            right, left, twice = after[w].copy(), before[w].copy(), pairs[w, w]
            right[old] -= twice
            left[old] -= twice
            # Take the word out of its class, then see what each class would gain by it.
            grid[old] -= right
            grid[:, old] -= left
            grid[old, old] -= twice
            rows, columns = grid[:k], grid[:, :k].T
            gain = (f(rows + right) - f(rows)).sum(1) + (f(columns + left) - f(columns)).sum(1)
            both = grid[at, at]
            gain -= f(both + right[:k]) - f(both) + f(both + left[:k]) - f(both)
            gain += f(both + right[:k] + left[:k] + twice) - f(both)
            # The words before and after it count for their own classes wherever it goes.
            sums, heads = rows.sum(1) + left[:k], columns.sum(1) + right[:k]
            gain -= f(sums + right.sum() + twice) - f(sums) + f(heads + left.sum() + twice) - f(heads)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new] += right
            grid[:, new] += left
            grid[new, new] += twice
            if new != old:
                moved += 1
                own[w] = new
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
        if not moved:
            break
    return own


def likelihood(grid: np.ndarray) -> float:
    """Class-bigram likelihood of the training texts, but for what no classes change."""
    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(grid) - f(grid.sum(0)) - f(grid.sum(1))


def _vocabulary(table: DataFrame, top: list[bytes], every: bool, types: int) -> DataFrame:
    """(key, n, unit) of all words: the top ones have their ranks, -1 is too rare, -2 - rule a rule's."""
    buckets = bucket_count(table.sparkSession, types)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, keys, rules, _ in _tokens(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array((keys % buckets).astype(np.int32)), pa.array(keys), pa.array(rules.astype(np.int32)),
                                                  batch.column(1).slice(lo, hi - lo)], ["bucket", "key", "rule", "n"])
    rank = {int(k): i for _, _, keys, _, _ in _tokens(pa.array([" ".join(w.decode() for w in top)])) for i, k in enumerate(keys)}

    def numbered(rows: pa.Table) -> pa.Table:
        key = np.sort(rows.column("key").to_numpy())
        order = np.argsort(rows.column("key").to_numpy())
        n, rules = rows.column("n").to_numpy()[order], rows.column("rule").to_numpy()[order]
        unit = np.array([rank.get(int(k), -1) for k in key], np.int64)
        free = np.flatnonzero((unit < 0) & (n >= MIN_COUNT))
        if every:
            unit[free] = len(rank) + np.arange(len(free)) * buckets + rows.column("bucket")[0].as_py()
        else:
            unit = np.where(unit < 0, -2 - rules, unit)
        return pa.table({"key": key, "n": n, "unit": unit})
    return materialise(table.where(F.octet_length("word") > 0).mapInArrow(keyed, "bucket int, key long, rule int, n long")
                       .groupBy("bucket").applyInArrow(numbered, "key long, n long, unit long"), "vocabulary")


def class_count(clustered: int) -> int:
    return int(CLASSES * max(1.0, clustered / EXACT) ** 0.25)


def train(texts: DataFrame, clustered: int | None = None, shared: int = SHARED) -> tuple[Model, DataFrame]:
    """(model, table of all words with their counts) from the training texts (column `text`)."""
    texts = texts.select("text")
    table = materialise(texts.mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    suffix = F.crc32(F.when(F.octet_length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))) % RULES
    sums = table.groupBy(F.when(F.octet_length("word") > 0, suffix).alias("rule")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # one row a rule
    every = clustered is None
    common = table.where(F.octet_length("word") > 0)
    top = (common.where(F.col("n") >= MIN_COUNT) if every else common).orderBy(F.desc("n"), "word")
    begun = class_count(table.where(F.col("n") >= MIN_COUNT).count()) - CLASSES if every else 0
    words = [bytes(w) for w in top.limit(EXACT + begun if every else clustered).toArrow().column("word").to_pylist()]
    exact = min(len(words), EXACT if every else clustered)
    ends = next((r["n"] for r in sums if r["rule"] is None), 0)
    types = sum(r["types"] for r in sums if r["rule"] is not None)

    vocabulary = _vocabulary(table, words, every, types)
    last = vocabulary.agg(F.max("unit"), F.count_if(F.col("unit") == -1)).first()
    rare = max(-1 if last[0] is None else last[0], len(words) - 1) + 1
    units = rare + RULES + 2
    vocabulary = vocabulary.select("key", "n", F.when(F.col("unit") < -1, rare - 1 - F.col("unit"))
                                   .when(F.col("unit") == -1, rare).otherwise(F.col("unit")).alias("unit"))
    parts = max(1, -(-types // shared))
    model = Model(words[:exact], ends, sum(r["n"] for r in sums), sum(r["types"] for r in sums), None, None, None, vocabulary, parts)

    docs = _prepared(texts, model)
    sent = _part(model, parts - 1)
    buckets = bucket_count(texts.sparkSession, 2 * model.tokens)
    found = docs.mapInArrow(_neighbours(sent, buckets, exact, units), "bucket int, block binary")
    contexts = materialise(found.groupBy("bucket").applyInArrow(_merged, "word int, others binary, ns binary"), "neighbours")
    size = exact + RULES + 2
    pairs = np.zeros((size, size))
    for r in contexts.where("word < 0").toLocalIterator():  # size rows at most
        pairs[-1 - r["word"], np.frombuffer(r["others"], np.int32)] = np.frombuffer(r["ns"], np.int64)
    contexts = contexts.where("word >= 0")

    # Exchange of the most frequent words; the units behind them keep classes of their own.
    own = exchange(pairs, exact)
    k = max(1, min(CLASSES, exact)) + max(0, len(words) - exact)
    few = int(last[1] > 0)
    number = k + few + RULES + 1
    unit_class = np.full(units, -1, np.int32)
    unit_class[:exact] = own[:exact]
    unit_class[exact:len(words)] = k - len(words) + np.arange(exact, len(words))
    unit_class[rare] = k if few else -1
    unit_class[rare + 1:] = k + few + np.arange(RULES + 1)
    # Pairs of units that never move; in them a rule stands for words that do if there are any.
    mark = np.concatenate((unit_class[:exact], unit_class[rare:]))
    if every:
        mark[exact + 1:-1] = -1
    hot = np.zeros((size, number))
    hot[np.flatnonzero(mark >= 0), mark[mark >= 0]] = 1
    still = hot.T @ pairs @ hot
    grid = still
    if rare > exact:
        grid = still + _grid(contexts, unit_class, number, exact)
        best = None
        for _ in range(ROUNDS):
            moved = _moved(contexts, unit_class, grid, k)
            then = still + _grid(contexts, moved, number, exact)
            reached = likelihood(then)
            if best is not None and reached <= best:
                break
            unit_class, grid, best = moved, then, reached

    transition = np.log10((grid + ALPHA) / (grid.sum(1, keepdims=True) + ALPHA * number))
    mass = grid.sum(0)
    kinds = np.bincount(unit_class[:rare][unit_class[:rare] >= 0], minlength=number).astype(float)
    first_rule = number - RULES - 1
    if few:
        kinds[k] = last[1]
    kinds[first_rule:-1] = 1  # what was never seen
    if not every:
        for r in sums:
            if r["rule"] is not None:
                kinds[first_rule + r["rule"]] += r["types"]
        for word in words:
            kinds[first_rule + rule(word)] -= 1
    total = np.zeros(number)
    total[:-1] = np.log10(np.maximum(mass[:-1] + ALPHA * kinds[:-1], ALPHA))
    model.unit_class, model.transition, model.class_total = unit_class, transition, total
    return model, table


def score(docs: DataFrame, model: Model, table: DataFrame, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs (doc_id, text)."""
    slim = _prepared(docs.select("doc_id", (fold() == held).alias("held_out"), "text"), model)
    kind = slim.schema["doc_id"].dataType.simpleString()
    part = _part(model, model.parts - 1)
    sent = docs.sparkSession.sparkContext.broadcast((model.unit_class, model.transition, model.class_total))
    ends, tokens = model.ends, model.tokens
    base = float(np.log10(tokens + ALPHA * (model.types + 1)))
    unseen, of_end = float(np.log10(ALPHA)), float(np.log10(ends + ALPHA))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, transition, class_total = sent.value
        for batch in batches:
            for lo, hi, keys, rules, start, known, counted in _looked_up(part, batch):
                classes = own[_chain(keys, rules, start, len(own))]
                n = np.diff(start) + 1
                counted = counted + (n - 1 - known) * unseen + of_end
                # A step for each word and the end; the end's emission is certain.
                step = transition[classes[:-1], classes[1:]] - class_total[classes[1:]]
                classed = _by_row(step, start + np.arange(len(start))) - of_end
                total = counted + classed
                rest = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1), pa.array(n), pa.array(known + (ends > 0)),
                     pa.array(np.full(hi - lo, tokens, np.int64)), pa.array(counted - n * base), pa.array(total),
                     pa.array(10.0 ** (-total / n))], names)
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame, text: str = "text", key: str = "doc_id", held: int = 1) -> DataFrame:
    """Learn from the documents that are not held out and score all of them."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model, table = train(slim.where(fold() != held))
    return score(slim, model, table, held)
