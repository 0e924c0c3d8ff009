r"""Count-only Viterbi segmentation: how many pieces a unigram tokenizer makes of a text, and at what score.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at each character; dynamic
programming carries, for each place, the best score of a segmentation up to it and its number of pieces.
No pieces or back pointers are kept.

Tie rules of the tokenizer: scores are double precision, a later candidate replaces an earlier one only if
it is strictly better, and candidates for a place come in the order of their start; so of equal ones the
one with the longest last piece stays.  A character that is no piece itself may be taken as unknown, with
the lowest score of the vocabulary less 10; it counts as one piece for each byte if the vocabulary has byte
pieces, else as one piece (several in a row: as one).  A text is written as the tokenizer sees it: blanks as
U+2581, one of them in front.

The text is cut where no piece of the vocabulary can reach across (worked out from the vocabulary), and
segments met before come from a table of bounded size; both leave every result as it is.

Defined results: a null or empty text has 0 pieces and score 0; repeated rows give repeated rows; empty input
gives empty output; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BLANK = "▁"
#: Fixed value: what an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
KEPT_SEGMENTS = 300_000
KEPT_CHARS = 64
#: Segments that are summed together.
PORTION = 1 << 16


def read_model(path: str) -> "Unigram":
    """The scored pieces of a sentencepiece model file, without its control, unknown, unused and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_too = {}, False
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            bytes_too = True
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    return Unigram(pieces, bytes_too)


class Unigram:
    def __init__(self, scores: dict[str, float], byte_pieces: bool):
        self.scores, self.byte_pieces = scores, byte_pieces

    def __getstate__(self):
        return {"scores": self.scores, "byte_pieces": self.byte_pieces}

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    @cached_property
    def _unknown(self) -> float:
        return min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def _segments(self) -> regex.Pattern:
        """Runs of text that no piece reaches out of.

        A cut before a blank is safe if no piece has a blank behind another character, one around a line
        end if no piece has a line end beside another character.  Without that the text is one segment.
        """
        blank_inside = any(a != BLANK and b == BLANK for p in self.scores for a, b in zip(p, p[1:]))
        line_inside = any(len(p) > 1 and "\n" in p for p in self.scores)
        if blank_inside or not self.byte_pieces:
            return regex.compile(r"(?s).+")
        if line_inside:
            return regex.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
        return regex.compile(rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")

    def best(self, segment: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a string that is already written with U+2581."""
        n = len(segment)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self._automaton.iter(segment)
        end, found = next(matches, (n, None))
        for at in range(n):
            top, count, alone, odd = None, 0, False, False
            while end == at:
                length, own = found
                start = at + 1 - length
                value = score[start] + own
                # They come longest first, so a tie keeps the longest.
                if top is None or value > top:
                    top, count = value, pieces[start] + 1
                alone |= length == 1
                end, found = next(matches, (n, None))
            if not alone:
                value = score[at] + self._unknown
                if top is None or value > top:
                    top, odd = value, True
                    if self.byte_pieces:
                        count = pieces[at] + len(segment[at].encode("utf-8", "replace"))
                    else:
                        count = pieces[at] + (not unknown[at])
            score[at + 1], pieces[at + 1], unknown[at + 1] = top, count, odd
        return pieces[n], score[n]

    @cached_property
    def _kept(self) -> dict[str, tuple[int, float]]:
        return _Segments(self)

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        written = BLANK + text.replace(" ", BLANK)
        lookup = self._kept.__getitem__
        if len(written) < 8 * PORTION:
            found = self._segments.findall(written)
        else:
            found = (m.group() for m in self._segments.finditer(written))
        pieces, score = 0, 0.0
        for n, s in map(lookup, found):
            pieces += n
            score += s
        return pieces, score


class _Segments(dict):
    def __init__(self, model: Unigram):
        self.model = model

    def __missing__(self, segment: str) -> tuple[int, float]:
        found = self.model.best(segment)
        if len(segment) <= KEPT_CHARS:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = found
        return found


def counts(docs: DataFrame, model: Unigram, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "score"])
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
