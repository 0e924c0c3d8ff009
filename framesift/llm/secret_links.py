r"""Secrets in texts: certain patterns alone, weak ones only where complementary parts of a credential meet.

Base findings are labelled values (`assign`), access ids (`access`) and long hex runs (`hex`).  A credential
is often spread over several places: an identifier, a secret and an endpoint, none of which says enough by
itself.  Such parts are candidates (`identifier`, `secret`, `endpoint`); the base findings take part as well,
`access` as an identifier, `assign` and `hex` as secrets.  A text is cut into scopes at blank lines.  Within a
scope, parts at most `WINDOW` code points apart are joined by their intervals:

* a weak secret is reported if an identifier or an endpoint is near,
* an identifier or an endpoint is reported if a secret is near, weak or base.

So a random-looking word in prose, a plain address or a lone user name is not reported.  The join is a sweep:
for each part the parts of another role whose interval reaches into its own widened one are counted by binary
search over sorted starts and ends.  No pairs are made, so thousands of parts in one scope cost n log n.

Every document is judged from its own row in one Arrow pass, nothing is shuffled, and a hot source or a large group
of copies costs no more than other rows.

Defined results: a null or empty text has no findings and the hash of the empty string; a null id is kept as it is;
repeated rows give repeated rows; empty input gives empty output; other columns are ignored.  Findings of one
kind never overlap; those of different kinds may, and at one start they come in the order of `KINDS`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]

#: The contract's patterns and least lengths (letters of the labels in either case).
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
                    r"""|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: Runs of hex digits are maximal, so those of the least length can be matched at once.
HEX = re.compile(rf"[0-9a-f]{{{HEX_CHARS},}}")

#: Code points between two parts that still belong together.
WINDOW = 300
#: A weak secret: so many characters, three kinds of them, and so many bits of entropy in each.
SECRET_CHARS = (16, 128)
SECRET_BITS = 3.5

_IDENTIFIER = re.compile(
    r"(?ai)(?<![a-z0-9])(?:access[_ -]?key[_ -]?id|client[_ -]?id|key[_ -]?id|account[_ -]?(?:id|name)?|user(?:[_ -]?(?:name|id))?"
    r"|login|tenant(?:[_ -]?id)?)[\"']?\x20*[:=]\x20*[\"']?(?P<value>[a-z0-9@._-]{3,64})")
_ENDPOINT = re.compile(
    r"(?ai)\b(?:https?|ftps?|s3|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+"
    r"|(?<![a-z0-9.@-])(?:[a-z0-9-]{1,63}\.){2,8}(?:com|net|org|io|cloud|internal|local)(?::[0-9]{2,5})?(?![a-z0-9-])")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,%d}(?![A-Za-z0-9+/_=-])" % SECRET_CHARS)
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
#: A text without any of these has neither base findings nor a weak secret, so nothing to report.
_HINTS = r"[:=]|AKIA|[A-Za-z0-9+/_=-]{16}"


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that do not overlap; those too short are dropped afterwards."""
    found = [Span(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [Span(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return found + [Span(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def looks_random(word: str) -> bool:
    """Three kinds of characters and the entropy of a generated value."""
    kinds = (any("a" <= c <= "z" for c in word) + any("A" <= c <= "Z" for c in word)
             + any("0" <= c <= "9" for c in word) + any(c in "+/_=-" for c in word))
    if kinds < 3 or not any("0" <= c <= "9" for c in word):
        return False
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= SECRET_BITS


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Weak parts; none overlaps a base finding, and a weak secret is no part of an endpoint or identifier."""
    taken = _Cover([(s.start, s.end) for s in base])
    found = [Span(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text) if not taken.meets(m.start(), m.end())]
    found += [Span(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text) if not taken.meets(m.start(), m.end())]
    taken = _Cover([(s.start, s.end) for s in base + found])
    found += [Span(m.start(), m.end(), "secret") for m in _WORD.finditer(text)
              if looks_random(m.group()) and not taken.meets(m.start(), m.end())]
    return found


class _Cover:
    """Intervals merged and sorted, to ask whether another one meets any."""

    def __init__(self, spans: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.starts = np.array([m[0] for m in merged], np.int64)
        self.ends = np.array([m[1] for m in merged], np.int64)

    def meets(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end))
        return k > 0 and bool(self.ends[k - 1] > start)


def _near(start: np.ndarray, end: np.ndarray, others: np.ndarray, scope: np.ndarray, other_scope: np.ndarray,
          window: int, stride: int) -> np.ndarray:
    """Which intervals have one of `others` (rows of start, end) in their scope at most `window` away.

    Scopes are laid out one after another, `stride` apart, so one pair of sorted lists serves all of them.
    """
    if not len(others):
        return np.zeros(len(start), bool)
    lift, other_lift = scope * stride, other_scope * stride
    starts = np.sort(others[:, 0] + other_lift)
    ends = np.sort(others[:, 1] + other_lift)
    # Began before the widened interval ends, less those that had ended before it begins.
    began = np.searchsorted(starts, end + window + lift, "right")
    over = np.searchsorted(ends, start - window + lift, "left")
    return began > over


def linked(text: str, base: list[Span], weak: list[Span], window: int = WINDOW) -> list[Span]:
    """The weak parts that a complementary part is near to."""
    if not weak:
        return []
    parts = base + weak
    cuts = np.array([m.start() for m in _BLANK_LINE.finditer(text)], np.int64)
    at = np.array([(s.start, s.end) for s in parts], np.int64)
    scope = np.searchsorted(cuts, at[:, 0], "right")
    kind = np.array([KINDS.index(s.kind) for s in parts])
    # A scope further on must be out of reach of every window.
    stride = len(text) + 2 * window + 2
    secret = np.isin(kind, [KINDS.index(k) for k in ("assign", "hex", "secret")])
    other = np.isin(kind, [KINDS.index(k) for k in ("access", "identifier", "endpoint")])

    def near(which: np.ndarray) -> np.ndarray:
        return _near(at[:, 0], at[:, 1], at[which], scope, scope[which], window, stride)
    kept = np.where(secret, near(other), near(secret))
    return [s for s, k in zip(weak, kept[len(base):]) if k]


def spans(text: str | None, window: int = WINDOW) -> list[Span]:
    """All findings in a text, by start and then in the order of `KINDS`."""
    if not text:
        return []
    base = base_spans(text)
    found = base + linked(text, base, candidates(text, base), window)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def written(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, findings: array of kind, start, end and value) of every document."""
    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, maybe in zip(batch.column(1), _hinted(batch.column(1))):
                body = text.as_py() if maybe else ""
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "value": body[s.start:s.end]}
                              for s in spans(body, window)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["doc_id", "findings"])
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def _hinted(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, _HINTS), False).to_pylist()


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per document: base findings by kind, their digest, and all findings as written."""
    slim = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            hashes, lines = [], []
            for text, maybe in zip(batch.column(1), _hinted(batch.column(1))):
                found = spans(text.as_py(), window) if maybe else []
                own = [s for s in found if s.kind in BASE]
                for n, kind in zip(counts, BASE):
                    n.append(sum(s.kind == kind for s in own))
                hashes.append(hashlib.sha256(written(own).encode()).hexdigest())
                lines.append(written(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(hashes, pa.string()),
                 pa.array(lines, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
