"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams of one to three characters per language come from a bounded sample of labelled rows
(`sample_docs` rows, equally many of each language if there are, chosen by a hash of their id, each with its
whole text; priors count all labelled rows); tasks count their rows, Spark
adds the counts up.  The matrix of log probabilities, languages times 65,536 buckets, goes to the executors
as a broadcast.  A batch is scored as a sparse product: the n-grams of a text are the column numbers of
its row, each with entry one, and their matrix rows are summed text by text, in windows of bounded size.

Characters are lower-cased one by one, everything but letters counts as a blank, and n-grams of blanks
alone count nothing.

The posterior tells learned languages from each other only.  So `keep_known` takes a text to be in its language only if
the mean log probability of its n-grams is not too far below that of the language's training rows (each row judged
without its own counts): `DEVIATIONS` standard deviations, of texts and of the mean of so many n-grams.  `predict` names
the likeliest learned language of every text with a letter.

Defined results: a text that is null or has no letter gets `und` with score 0, and so does every text when
there is nothing to learn from; equal scores give the language that sorts first; a null id counts as the
empty text for the held-out rule; repeated rows give repeated rows (and count twice in training); empty
input gives empty output; other columns are ignored by `predict` and passed through by `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.common import fold, free_name
from framesift.llm.text import buffers, code_points, mix64, slices

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SAMPLE_DOCS = 20_000
UNKNOWN = "und"
#: Code points that are looked at together.
WINDOW = 1 << 18
MIN_SCORE = 0.5
#: Standard deviations that a text's mean log probability of an n-gram may be below that of its language, n-grams
#: that tell as much as one independent one, and the least variance of one.
DEVIATIONS = 6.0
DEPENDENT = 6.0
LEAST_VARIANCE = 1.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (BUCKETS + 1, languages); the last row, of n-grams that count nothing, is 0
    usual: np.ndarray | None = None  # (3, languages): mean log probability of an n-gram, variance between texts and within


@cache
def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or 0 if it is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _buckets(points: np.ndarray, begin: int, end: int, limits: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each of the places begin..end.

    `limits` holds, for each of these places, where its text ends; n-grams do not reach beyond.
    """
    ahead = np.zeros(end - begin + ORDERS[-1] - 1, np.uint32)
    there = points[begin:end + ORDERS[-1] - 1]
    ahead[:len(there)] = there
    n = end - begin
    place = np.arange(begin, end)
    value = np.zeros(n, np.uint64)
    solid = np.zeros(n, bool)
    for order in range(1, ORDERS[-1] + 1):
        part = ahead[order - 1:order - 1 + n]
        value = value * np.uint64(0x100000001B3) + part + np.uint64(1)
        solid |= part > 0
        bucket = (mix64(value + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int64)
        bucket[~solid | (place + order > limits)] = BUCKETS
        yield bucket


def _windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first row, places of row starts, rows, has letters, buckets by order) over windows of a column's texts."""
    data, offsets = buffers(column)
    table = _letters()
    for lo, hi in slices(offsets):
        body = data[offsets[lo]:offsets[hi]]
        points, where = code_points(body, offsets[lo:hi + 1] - offsets[lo])
        points = table[points]
        for a in range(0, len(points), WINDOW):
            b = min(a + WINDOW, len(points))
            first = int(np.searchsorted(where, a, "right")) - 1
            last = int(np.searchsorted(where, b, "left"))
            rows = np.arange(first, last)
            rows = rows[where[rows + 1] > where[rows]]
            starts = np.maximum(where[rows], a) - a
            limits = np.repeat(where[rows + 1], np.diff(np.append(starts, b - a)))
            yield lo, starts, rows + lo, points[a:b], list(_buckets(points, a, b, limits))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows; bucket -1 holds the number of texts."""
    totals: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        known = sorted(set(langs))
        code = np.searchsorted(known, langs)
        for lang, n in zip(known, np.bincount(code, minlength=len(known))):
            texts[lang] = texts.get(lang, 0) + int(n)
            totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
        for _, starts, rows, points, buckets in _windows(batch.column(0)):
            lang = np.repeat(code[rows], np.diff(np.append(starts, len(points))))
            for bucket in buckets:
                found = np.bincount(lang * (BUCKETS + 1) + bucket, minlength=len(known) * (BUCKETS + 1))
                for k, name in enumerate(known):
                    totals[name] += found[k * (BUCKETS + 1):(k + 1) * (BUCKETS + 1)]
    for lang, counts in totals.items():
        at = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)),
             pa.array(np.append(counts[at], texts[lang]))], ["lang", "bucket", "n"])


def _limits(rows: dict[str, int], sample_docs: int):
    """Below which hash a row is learned from: languages have equal parts of the sample, or all of their rows."""
    part, left, rest = 0.0, float(sample_docs), len(rows)
    for n in sorted(rows.values()):
        part = max(part, left / rest)
        left, rest = left - min(n, left / rest), rest - 1
    pairs = [F.lit(x) for lang, n in rows.items() for x in (lang, int((1 << 30) * min(1.0, part / n)))]
    return F.element_at(F.create_map(*pairs), F.col("lang"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from about `sample_docs` of the rows of (doc_id, text, lang) whose lang and text are not null."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if sum(rows.values()) > sample_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < _limits(rows, sample_docs))
    counts = (labelled.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # languages x buckets at most
    lang = np.array(counts.column("lang").to_pylist(), dtype=object)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy().astype(float)
    languages = sorted(set(lang))
    matrix = np.zeros((BUCKETS + 1, len(languages)))
    prior, totals = np.zeros(len(languages)), np.zeros(len(languages))
    for k, name in enumerate(languages):
        own = lang == name
        prior[k] = rows[name]
        own &= bucket >= 0
        full = np.full(BUCKETS, SMOOTHING)
        full[bucket[own]] += n[own]
        totals[k] = full.sum()
        matrix[:-1, k] = np.log(full) - np.log(totals[k])
    model = Model(languages, np.log(prior / prior.sum()) if len(prior) else prior, matrix)
    return replace(model, usual=_usual(labelled, model, totals)) if languages else model


def _usual(labelled: DataFrame, model: Model, total: np.ndarray) -> np.ndarray:
    """How probable the n-grams of the training rows are in their languages, each row's own counts taken out."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = {lang: k for k, lang in enumerate(model.languages)}
        out = np.zeros((4, len(number)))
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            sums = np.zeros((3, batch.num_rows))
            for _, starts, rows, points, buckets in _windows(batch.column(0)):
                row = np.repeat(rows, np.diff(np.append(starts, len(points))))
                key = np.concatenate([(row * (BUCKETS + 1) + b)[b < BUCKETS] for b in buckets])
                key, n = np.unique(key, return_counts=True)
                row, bucket = key // (BUCKETS + 1), key % (BUCKETS + 1)
                k = lang[row]
                left = np.maximum(np.exp(model.log_prob[bucket, k]) * total[k] - n, SMOOTHING)
                value = np.log(left / total[k])
                for i, x in enumerate((n, n * value, n * value * value)):
                    sums[i] += np.bincount(row, x, minlength=batch.num_rows)
            some = sums[0] > 0
            mean = sums[1, some] / sums[0, some]
            for i, x in enumerate((np.ones(len(mean)), mean, mean * mean, sums[2, some] / sums[0, some] - mean * mean)):
                out[i] += np.bincount(lang[some], x, minlength=len(number))
        yield pa.RecordBatch.from_arrays([pa.array(model.languages), *map(pa.array, out)], ["lang", "n", "m", "mm", "v"])
    found = (labelled.select("text", "lang").mapInArrow(run, "lang string, n double, m double, mm double, v double")
             .groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "m", "mm", "v")]).collect())  # a row a language
    usual = np.full((3, len(model.languages)), 0.0)
    for r in found:
        if r["n"]:
            mean = r["m"] / r["n"]
            usual[:, model.languages.index(r["lang"])] = mean, max(r["mm"] / r["n"] - mean * mean, 0), max(r["v"] / r["n"], LEAST_VARIANCE)
    return usual


def classify(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text of a column, among the learned languages."""
    languages, posterior, _ = _judged(column, model)
    return languages, posterior


def decide(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """As `classify`, but a text whose n-grams are too improbable in its language is in none."""
    languages, posterior, usual = _judged(column, model)
    return [lang if ok else UNKNOWN for lang, ok in zip(languages, usual)], np.where(usual, posterior, 0.0)


def _judged(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior of each text, and whether its n-grams are as probable as that language's are."""
    n, k = len(column), len(model.languages)
    score = np.zeros((n, k))
    grams = np.zeros(n)
    letters = np.zeros(n, bool)
    if k:
        for _, starts, rows, points, buckets in _windows(column):
            letters[rows] |= np.logical_or.reduceat(points > 0, starts)
            part = np.zeros((len(rows), k))
            for bucket in buckets:
                part += np.add.reduceat(model.log_prob[bucket], starts, axis=0)
                grams[rows] += np.add.reduceat((bucket < BUCKETS).astype(float), starts)
            score[rows] += part
    if not k:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    mean = score / np.maximum(grams, 1)[:, None]
    score += model.log_prior
    best = score.argmax(axis=1)
    top = score[np.arange(n), best]
    posterior = 1 / np.exp(score - top[:, None]).sum(axis=1)
    middle, between, within = model.usual[:, best]
    bound = middle - DEVIATIONS * np.sqrt(between + DEPENDENT * within / np.maximum(grams, 1))
    return ([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, posterior, 0.0),
            letters & (mean[np.arange(n), best] >= bound))


def _with_prediction(docs: DataFrame, model: Model, text: str, pred: str, score: str, judge=classify) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = judge(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores)],
                                             [*batch.schema.names, pred, score])
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows to learn from, as (doc_id, text, lang): those that are not held out."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return slim.where(fold() != 0)


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document: a learned language for every text with a letter."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    slim = slim.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return _with_prediction(slim, model, "text", "lang_pred", "score").drop("text")


def keep_known(docs: DataFrame, model: Model, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a learned language, told with at least `min_score`; columns as in `docs`.

    A text too improbable in its language is in none here, though `predict` names the likeliest one.
    """
    pred, score = free_name(docs.columns, "_lang_pred"), free_name(docs.columns, "_lang_score")
    found = _with_prediction(docs, model, text, pred, score, decide)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).drop(pred, score)
