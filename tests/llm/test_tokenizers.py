import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models

from framesift.llm import bpe_transducer as bpe, unigram_counts
from framesift.llm.queries import byte_bpe

SF = "/root/testdata/sf0.01"
CODEC = byte_bpe()
WHOLE = bpe.Codec(CODEC.ranks, CODEC.pattern)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
UNIGRAM = unigram_counts.read_model(public_tokenizers.path("piece_bpe_32k.model"))
VITERBI = Tokenizer(models.Unigram([("<unk>", 0.0), *UNIGRAM.scores.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True))
HARD = ["", "a" * 3000, " " * 500, "\n" * 300 + "x", "é" * 700, "日本語テキスト" * 50, "👩‍👩‍👧‍👦 🏳️‍🌈" * 9, "ab" * 900, "=-" * 500,
        "0" * 4000, "\0\x01x", "'s 're IT'S", "<|endoftext|>", "the quick  brown\tfox\r\n"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    for portion in (1, 3, 1000):
        assert "".join(CODEC.decode_portions(ids, portion)) == text
    assert UNIGRAM.count(text)[0] == viterbi(text)


def viterbi(text):
    if not text:
        return 0
    return len(VITERBI.encode(unigram_counts.BLANK + text.replace(" ", unigram_counts.BLANK), add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    ids = CODEC.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.decode_bytes(ids).decode() == text
    if "<" not in text:
        assert UNIGRAM.count(text)[0] == viterbi(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd ", max_size=60), st.integers(0, 10 ** 6))
def test_any_vocabulary(text, seed):
    """Small random vocabularies, whose merges collide far more than those of a real one."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(rng.randint(1, 60)):
        new = rng.choice(tokens[97:101] + tokens[256:]) + rng.choice(tokens[97:101] + tokens[256:])
        if new not in tokens:
            tokens.append(new)
    machine = bpe.Transducer({t: i for i, t in enumerate(tokens)})
    want = machine.merged(text.encode())
    assert [machine.bytes_of[i] for i in machine.run(text.encode())] == want


def test_states_are_shared_and_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STATES", 50)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    codec = byte_bpe()
    text = " ".join(f"word{i}ness un{i}ly" for i in range(500))
    assert codec.encode(text).tolist() == REFERENCE.encode_ordinary(text)
    assert len(codec._pieces) <= 11 and len(codec._pieces.transducer._states) <= 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab éx\u00a0\u2003\u3000\u2581\n\t日語👍'.1sS ")), max_size=40), min_size=1, max_size=5))
def test_columns_are_encoded_like_texts(texts):
    for codec in (CODEC, WHOLE):
        got = [ids[a:b].tolist() for ids, where in codec.encode_column(pa.array(texts)) for a, b in zip(where[:-1], where[1:])]
        assert got == [REFERENCE.encode_ordinary(t) for t in texts]


def test_columns_in_small_slices_and_tables(monkeypatch):
    for name, value in (("TOGETHER", 100), ("KEPT_PARTS", 30), ("KEPT_PIECES", 10), ("KEPT_BYTES", 12)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(1)
    texts = [None, ""] + [" ".join("".join(rng.choice("abcé日 ") for _ in range(rng.randint(0, 20))) for _ in range(30)) for _ in range(40)] + HARD
    got = [ids[a:b].tolist() for ids, where in byte_bpe().encode_column(pa.array(texts)) for a, b in zip(where[:-1], where[1:])]
    assert got == [REFERENCE.encode_ordinary(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streamed_bytes_decode_like_whole_ones(raw, portion):
    stream = bpe.Utf8Stream()
    got = "".join([stream.feed(raw[i:i + portion]) for i in range(0, len(raw), portion)] + [stream.close()])
    assert got == raw.decode("utf-8", "replace")


def test_nothing_is_held_back_after_whole_characters():
    stream = bpe.Utf8Stream()
    assert stream.feed("aé日".encode()) == "aé日"
    assert stream.feed("👍".encode()[:2]) == "" and stream.feed("👍".encode()[2:]) == "👍"


def test_digests_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.digests(docs, CODEC).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    rows = [(1, t, "a") for t in HARD] + [(None, None, None), (1, "x", "a"), (1, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, CODEC)
    assert tokens.columns == ["doc_id", "ids", "ids_"]
    back = bpe.decode(tokens, CODEC, ids="ids_")
    assert sorted((r.text for r in back.collect())) == sorted((t or "") for _, t, _ in rows)
    assert bpe.encode(docs, CODEC, keep_text=True).columns == ["doc_id", "text", "ids", "ids_"]
    for df in (bpe.digests(docs.limit(0), CODEC), bpe.encode(docs.limit(0), CODEC), unigram_counts.counts(docs.limit(0), UNIGRAM)):
        assert df.count() == 0


def test_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in unigram_counts.counts(docs, UNIGRAM).collect():
        assert r.n_tokens == viterbi(texts[r.doc_id] or "")


def brute(model, segment):
    """Every segmentation, best score first, then the longest last piece, and so on towards the front."""
    best = {0: (0.0, 0)}
    low = min(model.scores.values()) - unigram_counts.UNKNOWN_PENALTY
    for end in range(1, len(segment) + 1):
        options = [(best[s][0] + model.scores[segment[s:end]], best[s][1] + 1) for s in range(end) if segment[s:end] in model.scores]
        if segment[end - 1:end] not in model.scores:
            options.append((best[end - 1][0] + low, best[end - 1][1] + len(segment[end - 1].encode())))
        top = options[0]
        for o in options[1:]:
            if o[0] > top[0]:
                top = o
        best[end] = top
    return best[len(segment)][1], best[len(segment)][0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc é", max_size=30), st.integers(0, 10 ** 6))
def test_ties_in_small_vocabularies(text, seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): float(rng.randint(-3, 0)) for _ in range(12)}
    model = unigram_counts.Unigram(pieces, True)
    written = unigram_counts.BLANK + text.replace(" ", unigram_counts.BLANK)
    assert model.best(written) == brute(model, written)
    if text:
        assert model.count(text) == brute(model, written)


def test_beyond_the_table_of_states(monkeypatch):
    """With no room for states every piece is followed depth first: the same ids, with a few steps for each byte."""
    codec = byte_bpe()
    rng = random.Random(11)
    letters = "aeinorst"
    words = [" " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    words += ["a" * 300, " " * 70, "é" * 40, "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(50)), "ab" * 100]
    want = [bpe.Transducer.merged(codec._pieces.transducer, w.encode()) for w in words]
    monkeypatch.setattr(bpe, "KEPT_STATES", 0)
    steps = []

    class Counted(dict):
        def get(self, *key):
            steps.append(key)
            return dict.get(self, *key)
    machine = bpe.Transducer(codec.ranks)
    pairs = machine._pairs
    for word, tokens in zip(words, want):
        assert [machine.bytes_of[i] for i in machine.run(word.encode())] == tokens
    # Pairs are known by now.  What is looked at is bounded by the bytes.
    machine._pairs = Counted(pairs)
    for word in words[:300]:
        machine.run(word.encode())
    assert len(steps) < sum(map(len, words[:300]))
    assert len(machine._states) == 1


def test_words_of_letters_are_one_piece():
    codec = byte_bpe()
    plain = bpe.Codec(codec.ranks, codec.pattern, parts=True)
    texts = ["Some words, and more words", " x", "  two", "don't can't we'll", "naïve café", "a1 b2", "", "x\ny z", "ends "]
    for column in (pa.array(texts), pa.array([" ".join(texts)] * 2)):
        for (a, b), (c, d) in zip(codec.encode_column(column), plain.encode_column(column), strict=True):
            assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
    assert codec.words and " words" in codec._pieces and " words" not in codec._known


def test_few_sizes_are_looked_at_beyond_the_table_of_states(monkeypatch):
    """What may be a token is known by its first bytes: invented words cost less than one look-up for each byte."""
    rng = random.Random(5)
    syllables = ["th", "an", "er", "ation", "ou", "ch", "ei", "ble", "ing", "str", "é", "ß", "ñ"]
    words = [(" " + "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 7)))).encode() for _ in range(400)]
    monkeypatch.setattr(bpe, "KEPT_STATES", 0)
    steps = []

    class Counted(dict):
        def get(self, *key):
            steps.append(key)
            return dict.get(self, *key)
    machine = bpe.Transducer(CODEC.ranks)
    want = [REFERENCE.encode_ordinary(w.decode()) for w in words]
    assert [machine.run(w) for w in words] == want
    machine.ranks = Counted(CODEC.ranks)
    assert [machine.run(w) for w in words] == want
    assert len(steps) < sum(map(len, words))


def test_words_are_told_in_the_column():
    texts = ["word", " word", "a", " ", "  x", "x y", "é", " é", "a1", "don't", " Zz", "w\n", "{", "[", "`", "@", "x" * 200]
    found = bpe._plain_words(pa.array(texts, pa.large_string())[1:])
    assert found.tolist() == [t.isascii() and t[t[0] == " ":].isalpha() for t in texts[1:]]
