"""Queries over the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framesift.llm import (bpe_transducer, class_lm, embedding_dedup, jaccard_join, language_id, line_cleaning,
                           prefix_trie, quality_cnn, secret_links, source_mixing, template_extract, token_alignment, unigram_counts)
from framesift.llm.common import table
from framesift.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        @wraps(run)
        def shipped(spark: SparkSession, sf: str) -> DataFrame:
            return run(ship_package(spark), sf)
        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


@_query("op1_embedding_dedup")
def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector at a cosine of at least 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


@_query("op2_source_mixing", rf"""
WITH sized AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {source_mixing.TEMPERATURE}) ELSE 0 END AS weight
            FROM sized),
rated AS (SELECT source, CASE WHEN size > 0 THEN weight / sum(weight) OVER () * sum(size) OVER () / size ELSE 0 END AS rate
          FROM weighed),
cdf AS (
  SELECT source, rate, k, sum(exp(term)) OVER (PARTITION BY source ORDER BY k) AS p
  FROM (SELECT source, rate, k, -rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END)
                                  OVER (PARTITION BY source ORDER BY k) AS term
        FROM rated, unnest(range(0, 200)) AS r(k) WHERE rate > 0)),
drawn AS (
  SELECT doc_id, source, text, lang, n_chars,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{source_mixing.SEED}:count'), 1, 13))::BIGINT::DOUBLE
           / {1 << source_mixing.BITS}::DOUBLE AS u
  FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, count(*) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.p <= d.u
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM counted
""")
def op2_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in as many copies as its source's weight asks for."""
    return source_mixing.mix(table(spark, sf, "documents"), copy="copy")


_WORDS = "length(x) - length(replace(x, ' ', '')) + 1"
_N_MARKS = f"len(regexp_extract_all(x, '[{line_cleaning.MARKS}]'))"
_N_ALONE = "len(list_filter(string_split(x, ' '), lambda w: w IN ({})))".format(", ".join(f"'{c}'" for c in line_cleaning.SEPARATORS))
_PHRASE = f"length(regexp_extract(lower(x), '{line_cleaning.STOCK}'))"
_LINE_FAILS = rf"""(
  (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '(?s)\p{{Lu}}.*[ \t].*[ \t].*\p{{Lu}}')
      AND len(regexp_extract_all(x, '\p{{Lu}}')) * 2 > len(regexp_extract_all(x, '\p{{L}}')))
  OR ({_N_MARKS} >= 3 AND {_N_MARKS} * 4 > {_WORDS} AND {_N_MARKS} * {line_cleaning.MARK_TIMES} > length(x))
  OR ({_N_ALONE} >= 2 AND {_N_ALONE} * 5 >= {_WORDS})
  OR ({_PHRASE} > 0 AND {_PHRASE} * {line_cleaning.STOCK_TIMES} >= length(x)))"""


def _cleaning_sql(docs: str) -> str:
    """CTEs that end in `judged`: the documents of the relation `docs` with measures, verdict and cleaned text."""
    return rf"""
split AS (
  SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM {docs}),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
measured AS (
  SELECT s.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(coalesce(text, '')) AS chars,
         array_to_string(list_filter(l, lambda x: NOT {_LINE_FAILS}), chr(10)) AS clean_text
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < {line_cleaning.MIN_WORDS}
            OR 100 * n_repeat_words > {line_cleaning.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         NOT base_failed AND NOT (chars - length(clean_text)) * 100 > chars * {line_cleaning.MAX_LOST_PERCENT} AS kept
  FROM measured)"""


@_query("op3_line_cleaning", f"""
WITH {_cleaning_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
""")
def op3_line_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of the line rules for every document."""
    return line_cleaning.judge(table(spark, sf, "documents"))


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf, "documents")
    return language_id.predict(docs, language_id.train(language_id.training_rows(docs)))


@_query("op5_quality_cnn")
def op5_quality_cnn(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_cnn.predict(docs, quality_cnn.train(docs, labels))


def byte_bpe(path: str | None = None) -> bpe_transducer.Codec:
    """The codec of a rank file, by default the one the contract names."""
    ranks = bpe_transducer.read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_transducer.Codec(ranks, public_tokenizers.PATTERN, parts=True, words=True)


@_query("op6_bpe_transducer")
def op6_bpe_transducer(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    return bpe_transducer.digests(table(spark, sf, "documents"), byte_bpe())


@_query("op7_unigram_counts")
def op7_unigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces and score of every document under the scored vocabulary."""
    model = unigram_counts.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_counts.counts(table(spark, sf, "documents"), model)


@_query("op8_class_lm")
def op8_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Base and class-model score of every document."""
    return class_lm.train_and_score(table(spark, sf, "documents"))


@_query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under links of at least 0.75 Jaccard similarity of 5-word shingles."""
    return jaccard_join.links(table(spark, sf, "documents"))


@_query("op10_template_extract")
def op10_template_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return template_extract.main_text(table(spark, sf, "pages"))


_CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


@_query("op11_prefix_trie", f"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, {_CRC32} % 9 AS h FROM ordered GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, o.pos AS d, o.role, o.text
  FROM convs c JOIN ordered o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text
  FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
  LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
firsts AS (
  SELECT conv_id, d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d) AS p FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', []::STRUCT(r VARCHAR, t VARCHAR)[] FROM convs),
lengths AS (SELECT conv_id, max(d) AS length FROM firsts GROUP BY conv_id),
nodes AS (
  SELECT p, d, min(f.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS own,
         string_agg(f.conv_id::VARCHAR, ',' ORDER BY f.conv_id) FILTER (WHERE d = length) AS ends
  FROM firsts f JOIN lengths l ON f.conv_id = l.conv_id GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
marked AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p AND n.d = c.d),
below AS (
  SELECT p[1:k] AS p, k AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM marked) GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM marked m JOIN below b ON m.p = b.p AND m.d = b.d LEFT JOIN nodes u ON m.d > 0 AND u.d = m.d - 1 AND u.p = m.p[1:m.d - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf, "conversations"))


def aligned_tokenizers(path_a: str | None = None, path_b: str | None = None) -> token_alignment.Tokenizers:
    """The two tokenizers of a pair of files, by default those the contract names."""
    return token_alignment.Tokenizers(path_a or public_tokenizers.path("byte_bpe_50k.json"),
                                      path_b or public_tokenizers.path("piece_bpe_32k.model"))


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return token_alignment.links(table(spark, sf, "documents"), aligned_tokenizers())


@_query("op13_secret_links")
def op13_secret_links(spark: SparkSession, sf: str) -> DataFrame:
    """Certain secrets of every document, and weak ones whose complementary parts are near."""
    return secret_links.digests(table(spark, sf, "documents"))
