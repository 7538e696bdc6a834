"""Quality rules as a short-circuit cascade of native expressions.

Every rule's selectivity and cost are estimated on a sample, and rules run in the order of rejected
rows per unit of cost; a row that one rule rejects is not looked at by the later ones. The order
changes the time only, never the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows that the cascade's order is estimated from.
SAMPLE_ROWS = 1_000
WHITE = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null, as an array."""
    inner = F.trim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first one included; exact at any length.

    Each window is a 64-bit hash whose low bits give way to its position (as many as the text's length
    needs); sorted, equal windows are neighbours, so windows that may be repeated are found in n log n.
    Only these are written out as words, sorted, and compared, so equal hashes of different windows
    count for nothing.
    """
    n = F.size(ws)
    none = F.lit(-1).cast("long")

    def maybe(room: Column) -> Column:
        keys = F.sort_array(F.transform(F.slice(ws, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(-room).bitwiseOR(i.cast("long"))))
        same = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(-room) == 0, F.lit(False))
        return let(keys, lambda k: F.filter(F.transform(k, lambda x, j: F.when(same(x, F.get(k, j - 1)) | same(x, F.get(k, j + 1)), x.bitwiseAND(room - 1)).otherwise(none)), lambda x: x >= 0))

    def repeated(found: Column) -> Column:
        at = lambda p, k: F.get(ws, (p + k).cast("int"))
        windows = F.sort_array(F.transform(found, lambda p: F.struct(F.concat_ws(" ", at(p, 0), at(p, 1), at(p, 2)).alias("w"), p.alias("p"))))
        same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
        return let(windows, lambda k: F.sort_array(F.filter(F.transform(k, lambda x, j: F.when(same(x, F.get(k, j - 1)) | same(x, F.get(k, j + 1)), x["p"]).otherwise(none)), lambda x: x >= 0)))

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("p"), F.lit(0).cast("long").alias("s"))
        return F.aggregate(starts, start, lambda a, x: F.struct(x.alias("p"), (a["s"] + F.least(F.lit(3).cast("long"), x - a["p"])).alias("s")), lambda a: a["s"])

    zero = F.lit(0).cast("long")
    room = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")))), F.lit(2.0)).cast("long")
    return F.when(n < 3, zero).otherwise(let(room, lambda r: let(maybe(r), lambda c: F.when(F.size(c) == 0, zero).otherwise(covered(repeated(c))))))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word)."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        F.struct(own.alias("t"), words(own).alias("w"), lines.alias("l")),
        lambda x: F.struct(
            long(F.size(x["w"]), "n_words"),
            long(F.length(F.array_join(x["w"], "")), "word_chars"),
            long(F.size(F.split(x["t"], r"[#*$%&|<>]", -1)) - 1, "n_symbols"),
            long(F.size(x["l"]) - F.size(F.array_distinct(x["l"])), "n_dup_lines"),
            long(repeated_words(x["w"]), "n_repeat_words"),
            long(F.size(x["l"]), "n_lines"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """``reject``: condition on the row; ``cost``: its work for the row, in characters looked at."""

    name: str
    reject: Column
    cost: Column


def default_rules(text_col: str) -> list[Rule]:
    """Rules over the measures and the text; all in whole numbers, so any engine agrees on them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    c = F.col
    pieces = lambda pattern: F.size(F.split(text, pattern, -1)) - 1
    scan = F.length(text).cast("double")
    return [
        Rule("symbols", 16 * c("n_symbols") > c("word_chars"), F.lit(1.0)),
        Rule("word_length", (c("word_chars") > 25 * c("n_words")) | (c("word_chars") < 2 * c("n_words")), F.lit(1.0)),
        Rule("repeated_lines", (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines")), F.lit(1.0)),
        Rule("exclamations", 4 * pieces("!") > c("n_words"), scan),
        Rule("capitals", 2 * pieces("[A-Z]") > c("word_chars"), 4 * scan),
    ]


def order_rules(rows: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected rows per unit of cost, both averages over the first ``sample_rows`` rows; ties by name.

    Rules are assumed to reject independently. The sample ends the scan of the few partitions it is
    read from; which rows it holds has no influence on results.
    """
    parts = [F.coalesce(r.reject, F.lit(False)).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    parts += [r.cost.cast("double").alias(f"c{i}") for i, r in enumerate(rules)]
    got = rows.select(*parts).take(sample_rows)
    mean = lambda k: sum(x[k] or 0.0 for x in got) / max(len(got), 1)
    worth = {r.name: mean(f"r{i}") / max(mean(f"c{i}"), 1e-9) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(rows: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows`` with the column passes: false from the first rule, in the estimated order, that rejects; null conditions do not reject."""
    verdict = None
    for r in order_rules(rows, rules, sample_rows):
        hit = F.coalesce(r.reject, F.lit(False))
        verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
    return rows.withColumn("passes", F.lit(True) if verdict is None else verdict.otherwise(F.lit(True)))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the six measures, base_failed, kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. kept: false
    for those, else the cascade's verdict. A null text is an empty one; repeated rows and null ids each
    give their own row; further columns are ignored, also such as are named like the results. As the
    measures are part of the result they are taken of every row; the cascade's order saves work only
    on rules that look at the text again.
    """
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    measured = slim.withColumn("_m", measures(F.col("_text"))).select("_id", "_text", "_m.*")
    failed = measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = cascade(failed, [Rule("base", F.col("base_failed"), F.lit(0.5)), *default_rules("_text")])
    return judged.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", F.col("passes").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
       NOT (base_failed OR 16 * n_symbols > word_chars OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR 4 * (length(t) - length(replace(t, '!', ''))) > n_words OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars) AS kept
FROM f
"""
