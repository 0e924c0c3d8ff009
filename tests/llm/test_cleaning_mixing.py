import math
import re
import sys
import zlib
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from framesift.llm import line_cleaning, source_mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


PROSE = "The river ran past the old mill and turned the wheel all day long while we sat there. "
TEXTS = {
    1: None, 2: "", 3: " \t\n ", 4: PROSE * 1, 5: " ".join(f"word{i} after{i} that it{i} goes{i}." for i in range(30)),
    6: "a b c a b c a b c", 7: "\n".join(["same line here."] * 4 + [f"other line {i} is longer than that." for i in range(20)]),
    8: "\n".join(["Home | About | News | Contact"] * 9 + [f"An honest{i} line{i} with{i} five{i} new{i} words{i}." for i in range(20)]),
    9: "\n".join(["HOME | ABOUT | NEWS"] * 60), 10: "a\x0bb\x0cc\rd e f 　g",
    11: " ".join(f"tok{i}" for i in range(30000)), 12: "### " * 80, 13: "été où ça " * 40 + "fin",
}


def test_measures_follow_the_definition(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()] + [(7, TEXTS[7], "x"), (None, "lone", "y")],
                                 "doc_id long, text string, n_words string")
    got = line_cleaning.judge(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = measures(TEXTS.get(r.doc_id, "lone"))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_lines_go_first_then_documents(spark):
    docs = spark.createDataFrame([(k, t, len(t or ""), "extra") for k, t in TEXTS.items()],
                                 "doc_id long, text string, n_chars int, _w string")
    got = {r.doc_id: r for r in line_cleaning.clean(docs).collect()}
    assert got[5].text == TEXTS[5] and got[11].text == TEXTS[11]
    assert "Home" not in got[8].text and got[8].n_chars == len(got[8].text) and got[8].text.count("honest") == 20
    assert 9 not in got and 12 not in got and 1 not in got and 4 not in got
    assert line_cleaning.clean(docs).dtypes == docs.dtypes
    assert line_cleaning.clean(docs.limit(0)).collect() == []
    assert line_cleaning.judge(docs.limit(0)).collect() == []


def test_clean_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(5, TEXTS[5], 1, "a", True, 2)], "doc_id long, text string, _q int, _failed string, _KEPT boolean, _m int")
    assert line_cleaning.clean(docs).collect() == docs.collect()


@pytest.mark.parametrize("line, fails", [
    ("A plain line that ends as lines do.", False), ("ALL OF THIS IS SHOUTED", True), ("USA", False), ("", False),
    ("one### two*** three$$$ four", True), ("x | y | z", True), ("Read more", True), ("R&D is fun, they say, 5 > 4.", False),
    ("All rights reserved.", True), ("« Oui », dit-elle.", False), ("»Ja«, sagte er.", False), ("हम NASA और ESA के साथ हैं", False),
    ("नमस्ते! वाह! अरे!", False), ("東京·大阪へ行きました。とても楽しい旅行でした。", False), ("Accueil » Produits » Aide", True),
    ("Alle Rechte vorbehalten.", True), ("$$$ !!! ###", True), ("We told them that the privacy policy of the firm had been changed, "
     "and that nobody had read it before signing.", False)])
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(line_cleaning.line_fails(F.col("t"))).first()[0] is fails


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (line_cleaning.judge(docs), line_cleaning.clean(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Exchange" not in plan


def poisson_count(key, rate, seed=source_mixing.SEED):
    u = int(md5(f"{key}:{seed}:count".encode()).hexdigest()[:13], 16) / 2 ** 52
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u and k < 10000:
        k += 1
        term *= rate / k
        total += term
    return k if rate > 0 else 0


def test_copies_follow_the_inverted_distribution(spark):
    rows = [(i, "x" * (10 + i % 7), "big" if i % 3 else ("small" if i % 2 else None), i) for i in range(900)]
    rows += [(900, None, "silent", 1), (None, "null id", "big", 2), (901, "", "big", 3), (5, "x" * 15, "big", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _rate int")
    size, weight = Counter(), {}
    for _, t, s, _ in rows:
        size[s] += len(t or "")
    for s, n in size.items():
        weight[s] = n ** source_mixing.TEMPERATURE if n else 0.0
    total, all_weight = sum(size.values()), sum(weight.values())
    rate = {s: weight[s] / all_weight * total / size[s] if size[s] else 0.0 for s in size}
    want = Counter()
    for i, _, s, _ in rows:
        want[i] += poisson_count("" if i is None else i, rate[s])
    got = source_mixing.mix(docs, copy="copy")
    assert got.columns == docs.columns + ["copy"]
    found = got.collect()
    assert Counter(r.doc_id for r in found) == +want
    assert Counter(r.doc_id for r in source_mixing.mix(docs).collect()) == +want


def test_given_weights_and_odd_input(spark):
    docs = spark.createDataFrame([(i, "ab", "a" if i < 600 else "b") for i in range(1200)], "doc_id long, text string, source string")
    got = Counter(r.source for r in source_mixing.mix(docs, weights={"a": 3, "b": 1}).collect())
    assert abs(got["a"] - 900) < 100 and abs(got["b"] - 300) < 60
    assert source_mixing.mix(docs, weights={"c": 1}).count() == 0
    assert source_mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        source_mixing.mix(docs, weights={"a": -1})


def test_high_rates_are_not_capped(spark):
    docs = spark.createDataFrame([(i, "x" * (20000 if i else 10), "big" if i else "tiny") for i in range(5)],
                                 "doc_id long, text string, source string")
    rate = 0.5 * 80010 / 10
    got = source_mixing.mix(docs, weights={"tiny": 1, "big": 1}).where("source = 'tiny'").count()
    assert abs(got - rate) < 6 * math.sqrt(rate)


def test_shuffle_is_global_and_stable(spark):
    docs = spark.createDataFrame([(i, "x", "s") for i in range(2000)], "doc_id long, text string, source string").repartition(4)
    first = [r.doc_id for r in source_mixing.mix(docs).collect()]
    assert first == [r.doc_id for r in source_mixing.mix(docs).collect()]
    ascending = sum(a < b for a, b in zip(first, first[1:]))
    assert 0.4 < ascending / len(first) < 0.6
