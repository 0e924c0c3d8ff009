import itertools
import re

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from framesift.llm import language_id, line_cleaning, source_mixing
from framesift.llm.queries import ORACLES, QUERIES, byte_bpe
from tools import compare

SF = "/root/testdata/sf0.001"


def lowest(rows):
    """The smallest id of each group of documents that are linked by their shingles."""
    sets = {}
    for r in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())
        sets[r["doc_id"]] = {tuple(own[k:k + 5]) for k in range(len(own) - 4)} or {tuple(own)}
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
            old, new = sorted((up[a], up[b]), reverse=True)
            up = {i: new if c == old else c for i, c in up.items()}
    return set(up.values())


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(names)


def test_stages_equal_the_operators_on_what_came_before(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = [r.asDict() for r in docs.collect()]
        if name != "bpe_encode":
            assert out.columns == columns
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [r.asDict() for r in docs.collect()]
        ids = sorted(r["doc_id"] for r in after)
        frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in before], spark.read.parquet(f"{SF}/documents.parquet").schema)
        if name == "quality_rules":
            assert ids == sorted(r.doc_id for r in line_cleaning.judge(frame).where("kept").collect())
            texts = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                lines = iter(texts[r["doc_id"]].split("\n"))
                assert all(line in lines for line in r["text"].split("\n"))  # lines in their order, none changed
        elif name == "language_id":
            model = language_id.train(language_id.training_rows(frame))
            pred = language_id.predict(frame, model).collect()
            assert ids == sorted(r.doc_id for r in pred if r.lang_pred != "und" and r.score >= 0.5)
        elif name == "jaccard_join":
            assert ids == sorted(lowest(before))
        elif name == "source_mixing":
            assert ids == sorted(r.doc_id for r in source_mixing.mix(frame).collect())
        else:
            codec = byte_bpe()
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(r["ids"] == codec.encode(texts[r["doc_id"]]).tolist() for r in after) and len(after) == len(before)


def test_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    judged = line_cleaning.judge(docs).where("NOT base_failed AND NOT kept").collect()
    assert not good & {r.doc_id for r in judged}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    ok, note = compare.compare(spark, compare.connect(SF), SF, name)
    assert ok, note
