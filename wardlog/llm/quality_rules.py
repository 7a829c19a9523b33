"""Quality rules: a table of thresholds compiled into one Spark projection (operator 4).

Counts come from array functions over the words of a text, rules from integer arithmetic on counts; no
user function, no shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.llm.common import SPACE, query, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages, lower case.
STOP_WORDS = {
    "de": ("als", "an", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine",
           "einer", "es", "für", "ich", "im", "in", "ist", "mit", "nicht", "oder", "sich", "sie", "und", "von",
           "werden", "wie", "zu"),
    "en": ("a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on",
           "or", "that", "the", "this", "to", "was", "with"),
    "es": ("a", "al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para",
           "por", "que", "se", "su", "un", "una", "y"),
    "fr": ("au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les",
           "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
}
ALL_STOP_WORDS = sorted({w for words in STOP_WORDS.values() for w in words})


class Rule(NamedTuple):
    """minimum% <= part / whole <= maximum%; None leaves a side open, a whole of 0 passes."""
    name: str
    part: str
    whole: str
    minimum: int | None
    maximum: int | None


BASE = (
    Rule("words", "n_words", "one", 5000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 15),
    Rule("stop_words", "n_stop_words", "n_words", 1, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 60),
)


def passes(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    sides = [F.lit(True)]
    if rule.minimum is not None:
        sides.append(part >= rule.minimum * whole)
    if rule.maximum is not None:
        sides.append(part <= rule.maximum * whole)
    return reduce(lambda a, b: a & b, sides)


def all_pass(rules) -> Column:
    return reduce(lambda a, b: a & b, map(passes, rules))


def _repeated_triples(words: Column) -> Column:
    """(hash, place) of each window of three words, sorted by hash."""
    window = lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    places = F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(
        F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, window))


def counts(docs: DataFrame) -> DataFrame:
    """`docs` with the counts of the rules for its column `text`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select("*", text.alias("_t"), F.filter(
        F.split(text, f"[{SPACE}]+"), lambda w: w != "").alias("_w"), F.filter(
        F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_l"))
    two = one.select("*", _repeated_triples(F.col("_w")).alias("_s"))
    same = lambda x, other: x["h"] == other["h"]
    repeated = F.filter("_s", lambda x, k: F.coalesce(same(x, F.get("_s", k + 1)), F.lit(False)) | (
        (k > 0) & same(x, F.get("_s", k - 1))))
    three = two.select("*", F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("_p"))
    # a window adds up to three words, less what the next repeated window adds itself
    added = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    many = lambda column: column.cast("bigint")
    return three.select(
        *docs.columns, F.lit(1).cast("bigint").alias("one"), many(F.size("_w")).alias("n_words"),
        many(F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        many(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        many(F.size("_l")).alias("n_lines"),
        many(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        total(added).alias("n_repeat_words"),
        many(F.size(F.filter("_w", lambda w: w.isin(ALL_STOP_WORDS)))).alias("n_stop_words"))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows of `docs` (doc_id, text) to one row each with counts, base_failed, failed (names) and kept.

    Words are runs without white space, symbols are counted in the whole text, a repeated line is one
    with a word that is equal to an earlier line; n_repeat_words counts the words that lie in a window of
    three words found twice or more. Null and empty texts have no words and fail. Each row is judged by
    itself, also with a null or repeated id. Other columns are ignored.
    """
    counted = counts(docs.select("doc_id", "text"))
    failed = F.filter(F.array(*(F.when(~passes(r), F.lit(r.name)) for r in (*BASE, *rules))), lambda n: n.isNotNull())
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_stop_words", (~all_pass(BASE)).alias("base_failed"), failed.alias("failed"),
        all_pass((*BASE, *rules)).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of `docs` that pass every rule, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    judged = counts(inner).select("row", all_pass((*BASE, *rules)).alias("kept"))
    # an array of one row or none: Catalyst would move a plain filter below the projections it depends on,
    # and so put whole array expressions into the functions that run once per element
    return judged.select(F.explode(F.filter(F.array("row"), lambda _: F.col("kept"))).alias("row")).select("row.*")


def _sql() -> str:
    def side(rule: Rule) -> str:
        parts = [f"100 * {rule.part} >= {rule.minimum} * {rule.whole}"] * (rule.minimum is not None)
        parts += [f"100 * {rule.part} <= {rule.maximum} * {rule.whole}"] * (rule.maximum is not None)
        return "(" + " AND ".join(parts) + ")"
    stop = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    failed = ", ".join(f"CASE WHEN NOT {side(r)} THEN '{r.name}' END" for r in (*BASE, *RULES))
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (
    SELECT r, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS w FROM numbered)),
triples AS (
  SELECT r, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
repeated AS (
  SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS again FROM triples),
covered AS (
  SELECT *, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside
  FROM repeated),
word_counts AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE inside) AS n_repeat_words,
    count(*) FILTER (WHERE w IN ({stop})) AS n_stop_words FROM covered GROUP BY r),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM numbered)
  WHERE regexp_matches(l, '[^{SPACE}]') GROUP BY r),
joined AS (
  SELECT doc_id, 1 AS one, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_stop_words, 0) AS n_stop_words
  FROM numbered LEFT JOIN word_counts USING (r) LEFT JOIN line_counts USING (r))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(n_stop_words AS BIGINT) AS n_stop_words,
  NOT ({' AND '.join(map(side, BASE))}) AS base_failed,
  list_filter([{failed}], lambda x: x IS NOT NULL) AS failed,
  {' AND '.join(map(side, (*BASE, *RULES)))} AS kept
FROM joined"""


@query("op4_threshold_rules", _sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
