import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import class_lm, language_id, quality_cnn
from framesift.llm.text import buffers, code_points, shingles, slices, words

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


# ---- text helpers -------------------------------------------------------------------------------------

def test_words_and_shingles_match_strings():
    rows = ["  A b c", "a B\tc d e f g f e a b c d e f", "", None, "x", "\n\n", " a  b c d e", "a b c d e ", "é " * 9,
            "w" * 5000 + " tail", "ab c", "a bc"]
    data, offsets = buffers(pa.array(rows))
    found, start = words(data, offsets)
    value, where = shingles(data, offsets)
    seen, sets = {}, {}
    for i, row in enumerate(rows):
        own = WORD.findall((row or "").translate(LOWER))
        assert start[i + 1] - start[i] == len(own)
        for w, h in zip(own, found[start[i]:start[i + 1]]):
            assert seen.setdefault(w, h) == h
        want = [tuple(own[k:k + 5]) for k in range(len(own) - 4)] or ([tuple(own)] if own else [])
        assert where[i + 1] - where[i] == len(want)
        for s, h in zip(want, value[where[i]:where[i + 1]]):
            assert sets.setdefault(s, h) == h
    assert len(set(map(int, seen.values()))) == len(seen) and len(set(map(int, sets.values()))) == len(sets)


def test_slices_and_code_points_cover_all():
    rows = ["é", "", "abc", "日本", "👍x"]
    data, offsets = buffers(pa.array(rows))
    points, where = code_points(data, offsets)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(where[:-1], where[1:])] == rows
    assert [x for lo, hi in slices(offsets, 4) for x in range(lo, hi)] == list(range(5))


# ---- language id --------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id) == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_und_is_for_texts_without_letters_alone(spark):
    """Texts in no learned language: the likeliest one in a prediction, gone from what is kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(language_id.training_rows(docs))
    odd = ["Мы поехали в город и купили там хлеб, молоко и немного сыра для всей семьи. " * 9,
           "今天天气很好，我们一起去公园散步，然后在湖边吃了午饭。" * 20, "zqxj wvkq xxqz jjkw qqzx " * 40, None, "", "123 -- 45"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = [r.lang_pred for r in language_id.predict(rows, model).orderBy("doc_id").collect()]
    assert all(x in model.languages for x in got[:3]) and got[3:] == ["und"] * 3
    assert language_id.keep_known(rows, model).count() == 0
    lettered = docs.where("text rlike '\\\\p{L}'").select("doc_id")
    assert language_id.predict(docs, model).join(lettered, "doc_id", "left_semi").where("lang_pred = 'und'").count() == 0


def brute_language(text, counts, texts):
    """Plain naive Bayes over the same hashed n-grams, one n-gram at a time."""
    table = language_id._letters()
    points = [int(table[ord(c)]) for c in text]
    found = []
    for order in language_id.ORDERS:
        for i in range(len(points) - order + 1):
            own = points[i:i + order]
            if any(own):
                value = 0
                for p in own:
                    value = (value * 0x100000001B3 + p + 1) & (1 << 64) - 1
                mixed = language_id.mix64(np.array([(value + order) & (1 << 64) - 1], np.uint64))[0]
                found.append(int(mixed) >> (64 - language_id.BITS))
    if counts is None:
        return found
    score = {}
    for lang, own in counts.items():
        total = sum(own.values()) + language_id.SMOOTHING * language_id.BUCKETS
        score[lang] = math.log(texts[lang] / sum(texts.values())) + sum(
            math.log((own[b] + language_id.SMOOTHING) / total) for b in found)
    return score


def test_scores_equal_plain_naive_bayes(spark):
    learn = [(1, "Der Hund läuft schnell", "de"), (2, "le chien court vite", "fr"), (3, "Le chat et la souris", "fr"),
             (4, "die Katze", "de"), (7, None, "fr"), (8, "no label", None)]
    docs = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    counts, texts = {}, Counter()
    for _, t, lang in learn:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(brute_language(t, None, None))
            texts[lang] += 1
    for text in ("la Katze", "DER CHIEN!", "x", "ß" * 30, "chat " * 70000):
        want = brute_language(text[:3000], counts, texts) if len(text) < 4000 else None
        lang, score = language_id.classify(pa.array([text]), model)
        if want:
            best = max(sorted(want), key=lambda k: want[k])
            assert lang == [best]
            assert score[0] == pytest.approx(1 / sum(math.exp(v - want[best]) for v in want.values()), rel=1e-6)
        else:
            assert lang == ["fr"]


def test_language_of_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 34 !?", "c"), (None, "hello there", "d"), (4, "hello", "e"),
                                  (4, "hello", "e")], "doc_id long, text string, score string")
    model = language_id.train(spark.createDataFrame([(9, "hello", "en")], "doc_id long, text string, lang string"))
    got = sorted((r.lang_pred, r.score) for r in language_id.predict(docs, model).collect())
    assert got == [("en", 1.0)] * 3 + [("und", 0.0)] * 3
    kept = language_id.keep_known(docs, model)
    assert kept.schema == docs.schema and kept.count() == 3
    nothing = language_id.train(docs.limit(0).select("doc_id", "text", F.lit("x").alias("lang")))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_training_sample_is_bounded_and_whole_when_small(spark):
    rows = [(i, "abc" if i % 2 else "xyz", "a" if i % 2 else "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_docs=200)
    assert model.languages == ["a", "x"]
    assert language_id.classify(pa.array(["cab", "zzz"]), model)[0] == ["a", "x"]


def test_documents_in_unlearned_languages_go(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(language_id.training_rows(docs))
    russian = ("в начале недели мы поехали в деревню к бабушке и долго ждали поезда на старой станции где никого не было "
               "кроме сторожа который рассказывал нам о том как раньше здесь шумела ярмарка ") * 3
    chinese = "今天天气很好我们一起去公园散步看到许多人在湖边钓鱼孩子们在草地上跑来跑去老人坐在树下聊天" * 6
    noise = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(120))
    asked = spark.createDataFrame([(1, russian), (2, chinese), (3, noise)], "doc_id long, text string")
    # A prediction names the likeliest learned language of any text with letters; what is kept is another matter.
    assert all(r.lang_pred in model.languages for r in language_id.predict(asked, model).collect())
    assert language_id.keep_known(asked, model).count() == 0
    assert language_id.keep_known(docs, model).count() >= 0.999 * docs.where("text RLIKE '[a-z]'").count()


def test_rare_languages_are_learned_from_a_sample(spark):
    rows = [(i, "abc", "a") for i in range(4000)] + [(5000 + i, "xyz", "x") for i in range(8)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=100)
    assert model.languages == ["a", "x"] and np.allclose(np.exp(model.log_prior), [4000 / 4008, 8 / 4008])
    assert language_id.classify(pa.array(["zyx" * 5]), model)[0] == ["x"]


# ---- quality ------------------------------------------------------------------------------------------

def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        row, first = quality_cnn.cut(np.array([n]))
        covered = np.zeros(n, bool)
        for f in first:
            covered[f:f + quality_cnn.CHUNK] = True
        assert covered.all() and len(row) >= 1


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(rng.standard_normal((quality_cnn.TAPS, 256, quality_cnn.FILTERS)).astype(np.float32),
                              rng.standard_normal(quality_cnn.FILTERS).astype(np.float32),
                              rng.standard_normal(quality_cnn.FILTERS), 0.3)
    texts = [None, "", "short", "é" * 700, "x y z " * 300]
    got = quality_cnn.score_texts(pa.array(texts), net)
    for text, score in zip(texts, got):
        raw = (text or "").encode()
        _, first = quality_cnn.cut(np.array([len(raw)]))
        best = []
        for f in first:
            chunk = raw[f:f + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
            values = [sum(net.taps[j][chunk[i + j]] for j in range(quality_cnn.TAPS)) + net.bias
                      for i in range(quality_cnn.CHUNK - quality_cnn.TAPS + 1)]
            best.append(np.maximum(np.max(values, axis=0), 0))
        want = 1 / (1 + math.exp(-(np.mean(best, axis=0) @ net.out + net.shift)))
        assert score == pytest.approx(want, abs=1e-5)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = quality_cnn.predict(docs, quality_cnn.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = {k: [r.predicted == r.label for r in got if r.label == k] for k in (0, 1)}
    assert all(np.mean(v) > 0.85 for v in right.values())
    assert all(r.predicted == (r.score >= quality_cnn.THRESHOLD) for r in got)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    got = quality_cnn.predict(docs, quality_cnn.train(docs, labels)).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, label int")
    assert all(r.score > 0.99 for r in quality_cnn.predict(docs, quality_cnn.train(docs, one)).collect())
    assert quality_cnn.predict(docs.limit(0), quality_cnn.train(docs, labels)).count() == 0


# ---- language model -----------------------------------------------------------------------------------

def brute_base(rows, held=1):
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + [""]) for i, t in rows]
    counts = Counter(w for i, own in tokens if remainder(i) != held for w in own)
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(own), sum(counts[w] > 0 for w in own),
                sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in own)) for i, own in tokens]


@pytest.mark.parametrize("shared", [0, 3, 100000])
def test_base_score_whatever_is_shared(spark, shared):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(i % 9))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "Only HERE é É"), (None, "w1 w2"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slim = docs.where(class_lm.fold() != 1)
    model, table = class_lm.train(slim.select("text"), clustered=4, shared=max(shared, 1))
    got = class_lm.score(docs, model, table).collect()
    n, want = brute_base(rows)
    assert len(got) == len(rows) and model.tokens == n
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], round(x[3], 6))
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)


def test_class_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(f"{'abcdefgh'[(i + k * k) % 8]}x" for k in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, table = class_lm.train(docs, clustered=6, shared=7)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    counts = {bytes(r.word): r.n for r in table.collect()}
    mass = Counter()
    for word, n in counts.items():
        if word:
            i = model.shared.index(word) if word in model.shared else -1 - class_lm.rule(word)
            mass[int(model.unit_class[model.units[i]])] += n + class_lm.ALPHA
    first_rule = len(model.transition) - class_lm.RULES - 1
    for c in range(len(model.transition) - 1):
        unseen = class_lm.ALPHA if c >= first_rule else 0
        assert (mass[c] + unseen) / 10 ** model.class_total[c] == pytest.approx(1, abs=1e-9)


def test_score_equals_plain_class_model(spark):
    rows = [(i, " ".join(f"{'abcdefgh'[(i + k * k) % 8]}x" for k in range(12))) for i in range(30)] + [(99, "zz ax nope")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, table = class_lm.train(docs.where("doc_id < 30"), clustered=5, shared=6)
    counts = {bytes(r.word): r.n for r in table.collect()}
    got = {r.doc_id: r.score for r in class_lm.score(docs, model, table).collect()}
    for i, text in rows:
        before, total = len(model.transition) - 1, 0.0
        for word in text.lower().encode().split() + [None]:
            k = len(model.transition) - 1
            if word is not None:
                at = model.shared.index(word) if word in model.shared else -1 - class_lm.rule(word)
                k = int(model.unit_class[model.units[at]])
                total += math.log10(counts.get(word, 0) + class_lm.ALPHA) - model.class_total[k]
            total += model.transition[before, k]
            before = k
        assert got[i] == pytest.approx(total, abs=1e-9)


def likelihood(pairs, own):
    hot = np.zeros((len(pairs), own.max() + 1))
    hot[np.arange(len(pairs)), own] = 1
    grid = hot.T @ pairs @ hot
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(grid) - f(grid.sum(1)) - f(grid.sum(0))


@pytest.mark.parametrize("seed", range(6))
def test_exchange_moves_each_word_to_its_best_class(seed):
    pairs = np.random.default_rng(seed).integers(0, 9, (11, 11)).astype(float)
    own = np.concatenate((np.arange(10) % 3, [3]))
    for w in range(10):
        options = []
        for c in range(3):
            own[w], old = c, own[w]
            options.append(likelihood(pairs, own))
            own[w] = old
        if max(options) > options[own[w]] + 1e-9:
            own[w] = int(np.argmax(options))
    assert (class_lm.exchange(pairs, 10, classes=3, rounds=1) == own).all()


def test_class_model_beats_the_base_on_held_out_text(spark):
    got = class_lm.train_and_score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_language_model_without_training_text(spark):
    docs = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    got = class_lm.score(docs, *class_lm.train(docs.limit(0))).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.base_score == pytest.approx(0)
    assert class_lm.train_and_score(docs.limit(0)).count() == 0


def test_words_beyond_the_most_frequent_have_classes_by_their_use(spark):
    rng = np.random.default_rng(5)
    # All end alike, so that endings tell nothing; the ones with high numbers are rare.
    pick = lambda kind: f"{kind}{int(1500 * rng.random() ** 2)}xx"
    rows = [(i, " ".join(f"the {pick('n')} will {pick('v')}" for _ in range(20))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, table = class_lm.train(docs)
    rare = [r.word.decode() for r in table.where("n BETWEEN 3 AND 8").collect()]
    nouns, verbs = ([w for w in rare if w[0] == kind][:100] for kind in "nv")
    assert len(nouns) > 50 and len(verbs) > 50 and not set(nouns + verbs) & {w.decode() for w in model.shared}
    texts = [(i, f"the {a} will {b}" if i % 2 else f"the {b} will {a}") for i, (a, b) in
             enumerate((a, b) for a, b in zip(nouns, verbs) for _ in range(2))]
    asked = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.score for r in class_lm.score(asked, model, table).collect()}
    assert np.mean([got[i + 1] > got[i] + 1 for i in range(0, len(texts), 2)]) > 0.9
    # And in however many parts the vocabulary is sent.
    again = {r.doc_id: r.score for r in class_lm.score(asked, *class_lm.train(docs, shared=1200)).collect()}
    assert again == pytest.approx(got, abs=1e-9)


def test_words_of_one_use_share_a_class_and_unseen_ones_do_not(spark):
    rows = [(i, f"a b a c once{i}") for i in range(9)]
    model, _ = class_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    units = {r.unit for r in model.vocabulary.where("n = 1").collect()}
    assert units == {len(model.unit_class) - class_lm.RULES - 2}
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    assert model.unit_class[units.pop()] == len(model.transition) - class_lm.RULES - 2
