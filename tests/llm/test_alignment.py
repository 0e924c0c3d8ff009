import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from framesift.llm import token_alignment as ta
from framesift.llm.queries import aligned_tokenizers

SF = "/root/testdata/sf0.001"
BY = aligned_tokenizers()
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
HARD = ["a  b", "  lead", "trail  ", " ", "   ", "\n", "a\tb\n\nc \n d", "ﬁ é é", "▁x", "ok ▁x more", "a b", "a  b c", "a  b",
        "<unk> </s> <s> <|endoftext|>", "\x00a", "a\r\n b", "<0x41> x", "日本語テキスト " * 9, "👩‍👩‍👧‍👦 🏳️‍🌈", "x" * 400, " " * 70 + "x", "don't  we'll",
        "a  b　 c", "1234567 89", "=-" * 90, "the the the cat"]


def groups_of(text):
    """Plainly: whole texts, ends by running sums, groups between common ends."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(BY.bytes_a[i] for i in a) != raw or b"".join(BY.bytes_b[i] for i in b) != raw:
        return []
    def ends(ids, length):
        total, found = 0, []
        for i in ids:
            total += len(length[i])
            found.append(total)
        return found
    ends_a, ends_b = ends(a, BY.bytes_a), ends(b, BY.bytes_b)
    common = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in common]
    for side, ids, where in ((0, a, ends_a), (1, b, ends_b)):
        k = 0
        for i, end in zip(ids, where):
            while end > common[k]:
                k += 1
            groups[k][side].append(i)
    return groups


def brute(texts):
    found = [groups_of(t) for t in texts]
    docs = Counter()
    for groups in found:
        docs.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    rows = []
    for groups in found:
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                     sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links),
                     hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return rows


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab éx  　▁\n\t日語👍'.1 ")), max_size=30), min_size=1, max_size=4))
def test_any_texts(texts):
    import pyarrow as pa
    found = ta.pa.concat_tables(list(ta._documents(pa.array(texts), ta.Lexicon(BY))))
    want = brute(texts)
    assert list(zip(*(found[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")))) == [
        (*w[:4], w[6]) for w in want]


def test_hard_texts(spark):
    texts = [None, "", *HARD, *HARD[:5]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, docs int")
    want = brute([t or "" for t in texts])
    assert rows_of(ta.links(docs, BY)) == want
    assert rows_of(ta.links(docs, BY, lookup_pairs=0)) == want
    assert want[2 + HARD.index("▁x")] == (0, 0, 0, 0, 0, 0, "")


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    want = brute(texts)
    assert rows_of(ta.links(docs.repartition(5), BY)) == want
    counts = {(r.a, r.b): r.docs for r in ta.pair_counts(docs, BY).collect()}
    docs_of = Counter(p for t in texts for p in {(a, b) for g in groups_of(t) for a in g[0] for b in g[1]})
    assert counts == docs_of


def test_bounded_tables(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(30)]
    for name, value in (("SLICE", 300), ("KEPT_PARTS", 20), ("JOIN_ROWS", 50), ("COUNTED_PAIRS", 10), ("ROW_PAIRS", 7)):
        monkeypatch.setattr(ta, name, value)
    import pyarrow as pa
    lexicon = ta.Lexicon(BY)
    found = pa.concat_tables(list(ta._documents(pa.array(texts), lexicon)))
    want = brute(texts)
    assert found["groups_sha256"].to_pylist() == [w[6] for w in want]
    assert found["n_links"].to_pylist() == [w[3] for w in want]
    for pairs, times, text in zip(found["pairs"].to_pylist(), found["times"].to_pylist(), texts):
        links = Counter(a * BY.size_b + b for g in groups_of(text) for a in g[0] for b in g[1])
        assert dict(zip(pairs, times)) == links
    counts, total = ta._Counts(), Counter()
    for pairs in found["pairs"].combine_chunks():
        counts.add(pa.array(pairs.as_py()))
        if counts.full:
            own = counts.take()
            total.update(dict(zip(own["pair"].to_pylist(), own["docs"].to_pylist())))
    own = counts.take()
    if own is not None:
        total.update(dict(zip(own["pair"].to_pylist(), own["docs"].to_pylist())))
    assert total == Counter(p for pairs in found["pairs"].to_pylist() for p in pairs)


def test_vocabulary_that_crosses_blanks(monkeypatch):
    """Where pieces may reach over blanks, texts are not cut."""
    import pyarrow as pa
    whole = aligned_tokenizers()
    whole.cuts = False
    found = pa.concat_tables(list(ta._documents(pa.array(HARD), ta.Lexicon(whole))))
    assert found["groups_sha256"].to_pylist() == [w[6] for w in brute(HARD)]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a b"), (None, "a b"), (7, "")]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ta.links(docs, BY)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(r[1:] for r in found.collect()) == sorted(brute([t or "" for _, t in rows]))
