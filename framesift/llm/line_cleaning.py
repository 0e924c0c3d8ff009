r"""Line-first cleaning of documents, with column functions only.

Every line of a text is judged by three rules: punctuation (symbols and exclamation marks are more than a fifth of
the characters and crowd the words, or most letters are upper case and none is lower case), navigation (two separators
or more that stand alone between blanks, one to five words) and boilerplate (a stock phrase that is a sixth of
the line or more).  So quotation marks, scripts without blanks or case, and a long line that mentions a stock phrase are left alone.
Lines that fail are removed; a document that loses too much of its text, or that fails the base rules,
is rejected.

Nothing is shuffled: each document is judged from its own row, so a hot source or a large group of
copies costs no more than other rows.

Defined results: a null or empty text has no words, fails the base rules and is rejected; a null id is
kept as it is; repeated rows give repeated rows; empty input gives empty output; other columns are
passed through by `clean` and ignored by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framesift.llm.common import WHITE, bind, free_name

#: Separators of menus, stock phrases of page furniture in English, French, German and Spanish (lower case,
#: RE2 and Java syntax).
SEPARATORS = "|»·•›"
STOCK = ("all rights reserved|privacy policy|terms of (use|service)|cookie policy|we use cookies|accept cookies|"
         "subscribe to our|sign up for|log in to|click here|read more|enable javascript|lorem ipsum|"
         "licensed under|share this (article|page|post)|"
         "tous droits réservés|politique de confidentialité|conditions d.utilisation|accepter les cookies|abonnez-vous|cliquez ici|lire la suite|"
         "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|newsletter abonnieren|hier klicken|weiterlesen|"
         "todos los derechos reservados|política de privacidad|términos de uso|aceptar cookies|suscríbete|haga clic aquí|leer más")
MARKS = "#*$%&|<>!"

#: No stock phrase is longer, so lines beyond STOCK_TIMES of it need no look.
STOCK_CHARS = 30
#: A stock phrase counts if the line is at most so many times as long; marks count if the line is less than so many times as many.
STOCK_TIMES = 6
MARK_TIMES = 5

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line is removed.  Blanks stand for its words."""
    def crowded(words: Column) -> Column:
        marks = _count(line, MARKS)
        alone = F.size(F.filter(F.split(line, " "), lambda w: w.isin(list(SEPARATORS))))
        return (((marks >= 3) & (marks * 4 > words) & (marks * MARK_TIMES > F.length(line)))
                | ((alone >= 2) & (alone * 5 >= words)))
    marked = line.rlike(f"[{MARKS}{SEPARATORS}]") & bind(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1, crowded)
    shouting = (~line.rlike(r"\p{Ll}") & line.rlike(r"(?s)\p{Lu}.*[ \t].*[ \t].*\p{Lu}")
                & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 2 > F.regexp_count(line, F.lit(r"\p{L}"))))
    phrase = F.length(F.regexp_extract(F.lower(line), f"({STOCK})", 0))
    boilerplate = (F.length(line) <= STOCK_CHARS * STOCK_TIMES) & (phrase > 0) & (phrase * STOCK_TIMES >= F.length(line))
    return shouting | marked | boilerplate


def _covered(hashes: Column) -> Column:
    """Words in windows that occur again, from the hash of the window at each word."""
    def positions(found: Column) -> Column:
        again = F.filter(found, lambda e, k: (F.get(found, k - 1)["h"] == e["h"]) | (F.get(found, k + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(again, lambda e: e["p"]))
    found = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        bind(found, positions), start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """Adds a struct column with the measures and the cleaned text, and two with the verdicts, named by `_added`."""
    names = [f"`{c}`" for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w, l, h = (free_name(docs.columns, n) for n in ("_w", "_l", "_h"))
    staged = docs.select("*", _words(t).alias(w), F.split(t, "\n").alias(l))
    # Both arrays are read several times below, so each is computed in a step of its own.
    staged = staged.select("*", F.when(F.size(w) >= 3, bind(
        F.transform(F.col(w), lambda x: F.xxhash64(x)),
        lambda x: F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))))
        .otherwise(F.array().cast("array<bigint>")).alias(h))
    with_word = F.filter(F.col(l), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = F.filter(F.col(l), lambda x: ~line_fails(x))
    repeat = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(F.col(h))).otherwise(F.lit(0).cast("long"))
    parts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        bind(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.length(t).cast("long").alias("chars"),
        F.array_join(held, "\n").alias("clean_text"))
    m = free_name(docs.columns, "_m")
    # Through a generator, so that a filter on the verdict is not moved ahead and everything computed twice.
    staged = staged.select(*names, F.explode(F.array(parts)).alias(m))
    q = F.col(m)
    failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    lost = (q["chars"] - F.length(q["clean_text"])) * 100 > q["chars"] * MAX_LOST_PERCENT
    return staged.select(*names, *[c.alias(n) for c, n in zip((q, failed, ~failed & ~lost), _added(docs))])


def _added(docs: DataFrame) -> list[str]:
    """Names of the measures, of `base_failed` and of `kept` beside the columns of `docs`."""
    return [free_name(docs.columns, n) for n in ("_q", "_failed", "_kept")]


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its measures and whether it is kept."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    q = F.col("_q")
    return _measured(slim, "text").select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The kept documents with their failed lines removed; columns as in `docs`.

    A length column, if there is one, follows the new text.
    """
    measures, _, kept = _added(docs)
    columns = []
    for field in docs.schema.fields:
        if field.name == text:
            columns.append(F.col(measures)["clean_text"].alias(text))
        elif field.name == length:
            columns.append(F.length(F.col(measures)["clean_text"]).cast(field.dataType).alias(length))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return _measured(docs, text).where(kept).select(*columns)
