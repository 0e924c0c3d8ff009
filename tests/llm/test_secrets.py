import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from framesift.llm import secret_links as sl

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
WORD = "xK9/qP2wLm7+ZtR4vB8n"


def base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            if {"assign": lambda: len(m.group(2)) >= 6, "access": lambda: len(m.group()) >= 20, "hex": lambda: len(m.group()) >= 24}[kind]():
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def brute_links(text, found, weak, window):
    """All pairs, plainly."""
    scopes = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda s: sum(c <= s.start for c in scopes)
    secrets = {"assign", "hex", "secret"}
    return [s for s in weak if any(
        scope(s) == scope(o) and (s.kind in secrets) != (o.kind in secrets)
        and o.start <= s.end + window and o.end >= s.start - window for o in found + weak)]


PIECES = ["password=hunter22", "Token : 'abcdef", "api_key=ab", "APIKEY=\"zz.zz.zz", "AKIA" + "A1" * 9, "AKIAB", "0123456789abcdef" * 2,
          "beef", WORD, "user_id: alice7", "client-id=99x", "https://db.example.org/x?y=1", "api.eu.example.com:443", "\n\n", "\n \t\n", "\n",
          " ", " plain words ", "é日", "ſecret=abcdefgh", "toKen=abcdefgh", "token==abcdefg", "secret=AKIA" + "Z" * 20, "=", ":"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from([0, 5, 30, 300]))
def test_any_texts(pieces, window):
    text = "".join(pieces)
    found = sl.base_spans(text)
    assert sorted((s.start, s.end, s.kind) for s in found) == sorted(base(text))
    weak = sl.candidates(text, found)
    assert sl.linked(text, found, weak, window) == brute_links(text, found, weak, window)
    whole = sl.spans(text, window)
    assert [tuple(s) for s in whole if s.kind in sl.BASE] == base(text)


def kinds(text):
    return [(s.kind, text[s.start:s.end]) for s in sl.spans(text)]


def test_weak_parts_need_each_other():
    assert kinds(f"A word such as {WORD} alone says nothing.") == []
    assert kinds("user: alice at https://db.example.org/login") == []
    found = kinds(f"user_id: alice7, then {WORD}")
    assert found == [("identifier", "user_id: alice7"), ("secret", WORD)]
    assert kinds(f"user_id: alice7\n\n{WORD}") == []
    assert kinds("user_id: alice7 " + "far " * 100 + WORD) == []
    assert kinds(f"https://db.example.org/x {WORD}") == [("endpoint", "https://db.example.org/x"), ("secret", WORD)]
    key = "AKIA" + "Q2" * 8
    assert kinds(f"{key} {WORD}") == [("access", key), ("secret", WORD)]
    assert kinds("login=bob password=hunter22") == [("identifier", "login=bob"), ("assign", "password=hunter22")]


def test_many_parts_in_one_scope():
    text = " ".join([f"user={i:05d} {WORD}{i}" for i in range(20000)])
    assert len(sl.spans(text)) == 40000


def digest(text):
    own = base(text or "")
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in own).encode()).hexdigest()


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sl.digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, own = texts[r.doc_id], base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in own) for k in PATTERNS)
        assert r.base_sha256 == digest(text)
        written = [w.split(":") for w in r.spans.split(",") if w]
        assert [w for w in written if w[0] in PATTERNS] == [[k, str(a), str(b)] for a, b, k in own]
        assert [int(w[1]) for w in written] == sorted(int(w[1]) for w in written)


@pytest.mark.parametrize("rows", [[], [(None, None, "a")], [(1, "", "a"), (1, "password=abcdef", "a"), (1, "password=abcdef", "a")]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sl.digests(docs).collect()
    assert sorted((r.n_assign, r.base_sha256) for r in got) == sorted((len(base(t or "")), digest(t)) for _, t, _ in rows)
    found = sl.scan(docs).collect()
    assert sum(len(r.findings) for r in found) == sum(len(base(t or "")) for _, t, _ in rows)
    assert all(f.value == "password=abcdef" for r in found for f in r.findings)
