"""Benchmark decontamination by canonical templates (operator 1), DataFrame functions only.

A text becomes a sequence of tokens in which numbers, names and units are typed placeholders - the slots -
and every other word is itself in lower case. Windows of the documents' templates meet the windows of
the benchmark's templates in a hash join, so a question whose figures and names were exchanged still
meets its original. What meets on one diagonal (a document and an item at a constant distance) is an
occurrence of the item; it counts if enough tokens in succession are covered and consistent: each value of the
item stands for one value of the document in all of them. Two values of the item may stand for the same one.

Types depend on the token and the one before it only, so that an item's template is the same wherever in a
document it stands, but for its first tokens: the items' windows are made behind nothing, behind a word and
behind a number. A first token that is a slot only because of what stands before it has to keep its value.

Items too short for a template, or of few plain words and more slots than those, would meet anything of their
shape: a second join finds them by their exact tokens and values. Items of one or two tokens are never found.

A document's windows are made and joined in one stage: nothing of a document is
shuffled but the few windows that met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlog.llm.common import checkpointed, query, table

WINDOW = 8             # tokens of a window
SHORTEST = 5           # items of fewer tokens have no template; up to WINDOW they are one window
SHORTEST_EXACT = 3     # items of fewer tokens are not looked for
COVERED = 12           # tokens of an item that must be covered (all of it, if it is shorter) ...
WORDS = 5              # ... of which so many must be plain words (all of them, if the item has fewer)
BROADCAST_WINDOWS = 2_000_000    # windows of the benchmark that may be sent to every task
ANCHORS = 5_000        # anchors of windows that are looked up in a document's tokens before windows are made
BROADCAST_DOCUMENTS = 1_000_000  # found documents that may be

BEFORE = "", "x ", "1 "          # what may stand before an item: nothing, a word, a number
#: Placeholders: private characters, which are taken out of texts beforehand.
NAME, NUMBER, UNIT = SLOTS = "\ue000", "\ue001", "\ue002"
BOUND = NAME           # in the place of an item's value: a first token that is a slot only by what stands before it
LETTER, MARKS, APOSTROPHE = r"\p{L}\p{M}", r".!?\n", "'’"
WORD = rf"[{LETTER}]+(?:[{APOSTROPHE}][{LETTER}]+)*"
DIGITS = "[0-9]+(?:[.,][0-9]+)*"
BETWEEN = rf"[^{LETTER}0-9{MARKS}{NAME}-{UNIT}]"      # characters that neither belong to a token nor end a sentence
NO_WORD_BEFORE = rf"(?<![{LETTER}])(?<![{LETTER}][{APOSTROPHE}])"
NO_WORD_AFTER = rf"(?![{APOSTROPHE}]?[{LETTER}])"
REACH = 16             # characters of BETWEEN that may lie between a token and the one its type depends on
#: Words that stand for numbers and for units after a number, lower case.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
                "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
                "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
                "thousand", "million", "billion")
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter",
         "meters", "metre", "metres", "kilometers", "kilometres", "mg", "g", "kg", "gram", "grams", "kilogram",
         "kilograms", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre",
         "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour",
         "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar",
         "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts")

def _choice(words) -> str:
    """A pattern for any of the words that tries only those of the right first letter."""
    heads: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        heads.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in sorted(heads.items())) + ")"


#: Replaced in this order, in the text as it is written.
IS_UNIT = rf"(?<={NUMBER})({BETWEEN}{{0,{REACH}}}){NO_WORD_BEFORE}(?i:{_choice(UNITS)}){NO_WORD_AFTER}"
IS_NAME = (rf"\p{{Lu}}(?<=[{LETTER}]{BETWEEN}{{1,{REACH}}}\p{{Lu}}|[{NAME}-{UNIT}]{BETWEEN}{{0,{REACH}}}\p{{Lu}})"
           rf"(?<![{LETTER}][{APOSTROPHE}]\p{{Lu}})[\p{{Ll}}\p{{M}}]+(?:[{APOSTROPHE}][\p{{Ll}}\p{{M}}]+)?{NO_WORD_AFTER}")
TEMPLATE_TOKEN = rf"[{NAME}-{UNIT}]|{WORD}"
TOKEN = rf"{DIGITS}|{WORD}"


def _longest(tokens: Column) -> Column:
    """The longest plain word, the first of equals; '' without any."""
    return F.aggregate(tokens, F.lit(""), lambda best, c: F.when(
        ~c.isin(*SLOTS) & (F.length(c) > F.length(best)), c).otherwise(best))


def _window(length: int):
    return lambda place: F.struct(
        place.alias("p"), F.lit(length).alias("w"), F.xxhash64(F.lit(length), F.slice("_c", place, length)).alias("h"),
        F.when(F.size("_v") == 0, F.lit("")).otherwise(F.array_join(F.slice("_v", place, length), "\t")).alias("s"))


def _own_window(length: int):
    return lambda place: F.struct(place.alias("p"), F.lit(length).alias("w"), F.xxhash64(
        F.lit(length), F.slice("_own", place + 1, length)).alias("h"))


def _holds_slot(text: str) -> Column:
    return F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(UNIT))


def _templates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, template tokens _c, and slot values _v ('' for plain words; empty if there is no slot at all)."""
    raw = rows.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    clean = raw.select(*keys, F.when(_holds_slot("_t"), F.translate("_t", "".join(SLOTS), "")).otherwise(F.col("_t")).alias("_t"))
    digits = clean.select(*keys, "_t", F.regexp_replace("_t", DIGITS, NUMBER).alias("_n"))
    united = F.when(F.contains("_n", F.lit(NUMBER)), F.regexp_replace("_n", IS_UNIT, "$1" + UNIT)).otherwise(F.col("_n"))
    named = digits.select(*keys, "_t", F.lower(F.regexp_replace(united, IS_NAME, NAME)).alias("_r"))
    split = named.select(*keys, "_t", F.regexp_extract_all("_r", F.lit(TEMPLATE_TOKEN), F.lit(0)).alias("_r"))
    said = lambda c, k: (F.when(~c.isin(*NUMBER_WORDS, *UNITS), c).when(c.isin(*NUMBER_WORDS), F.lit(NUMBER))
                         .when(F.get("_r", k - 1).isin(*NUMBER_WORDS), F.lit(UNIT)).otherwise(c))
    typed = split.select(*keys, "_t", F.transform("_r", said).alias("_c"))
    none = F.array().cast("array<string>")
    slots = F.exists("_c", lambda c: c.between(NAME, UNIT))
    own = typed.select(*keys, "_c", F.when(slots, F.regexp_extract_all(F.lower("_t"), F.lit(TOKEN), F.lit(0)))
                       .otherwise(none).alias("_o"))
    return own.select(*keys, "_c", F.when(F.size("_o") == 0, none).otherwise(F.zip_with(
        "_c", "_o", lambda c, o: F.when(c.between(NAME, UNIT), o).otherwise(F.lit("")))).alias("_v"))


def _windows(rows: DataFrame, lengths: list[int], keys: list[str], anchors: list[str] | None = None) -> DataFrame:
    """One row per window of each of `lengths`: keys, tokens (of the text), place p, w, hash h, slot values s (joined).

    With `anchors`, only windows that hold one of these tokens.
    """
    made = _templates(rows, keys)
    if anchors is not None:
        places = F.transform("_c", lambda c, k: F.when(c.isin(*anchors), k + 1))
        made = made.select("*", F.array_compact(places).alias("_a"))
    none = F.array().cast("array<struct<p:int,w:int,h:bigint,s:string>>")

    def starts(length: int) -> Column:
        last = F.size("_c") - (length - 1)
        if anchors is None:
            return F.sequence(F.lit(1), last)
        return F.array_distinct(F.flatten(F.transform("_a", lambda q: F.sequence(
            F.greatest(F.lit(1), q - (length - 1)), F.least(q, last)))))

    parts = [F.when(F.size("_c") >= length, F.transform(starts(length), _window(length))).otherwise(none)
             for length in lengths]
    both = parts[0] if len(parts) == 1 else F.concat(*parts)
    return made.select(*keys, F.size("_c").alias("tokens"), F.explode(both).alias("_e")).select(*keys, "tokens", "_e.*")


def _slots(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t["a"].isin("", BOUND))


def _consistent_runs(tokens: Column) -> Column:
    """The longest runs of tokens (a of the item, b of the document) in which each a has one b."""
    pairs = F.array_distinct(_slots(tokens))
    one_each = F.size(F.array_distinct(F.transform(pairs, lambda t: t["a"]))) == F.size(pairs)
    # the place behind the last earlier token of the same value that stands for another one
    placed = F.filter(F.transform(tokens, lambda t, k: F.struct(t["a"].alias("a"), t["b"].alias("b"), (k + 1).alias("k"))),
                      lambda t: ~t["a"].isin("", BOUND))
    behind = F.transform(placed, lambda t: F.struct(t["k"].alias("k"), F.coalesce(F.array_max(F.transform(F.filter(
        placed, lambda e: (e["k"] < t["k"]) & (e["a"] == t["a"]) & (e["b"] != t["b"])), lambda e: e["k"])), F.lit(0)).alias("f")))
    # each run ends before a token whose conflict lies inside it, and the next one begins behind that conflict
    ends = F.aggregate(
        behind, F.struct(F.lit(0).alias("f"), F.array().cast("array<struct<f:int,e:int>>").alias("r")),
        lambda x, t: F.when(t["f"] > x["f"], F.struct(t["f"].alias("f"), F.concat(x["r"], F.array(F.struct(
            x["f"].alias("f"), (t["k"] - 1).alias("e")))).alias("r"))).otherwise(x),
        lambda x: F.concat(x["r"], F.array(F.struct(x["f"].alias("f"), F.size(tokens).alias("e")))))
    return F.when(one_each, F.array(tokens)).otherwise(
        F.transform(ends, lambda r: F.slice(tokens, r["f"] + 1, r["e"] - r["f"])))


def _own_tokens() -> Column:
    """The tokens themselves, of a template and its values."""
    return F.when(F.size("_v") == 0, F.col("_c")).otherwise(F.zip_with("_c", "_v", lambda c, v: F.when(v == "", c).otherwise(v)))


def _item_templates(items: DataFrame) -> DataFrame:
    """item_id, tokens, template _c, values _v, first, words, exact, _own: one row per template an item can have.

    `first` is the value of a first token that is a slot because of what stands before the item, else null. `words`
    are the item's plain words, `exact` tells that it has to be found by its own tokens `_own`.
    """
    made = []
    for kind, before in enumerate(BEFORE):
        rows = items.select("item_id", F.xxhash64(F.col("text").cast("string")).alias("_i"),
                            F.concat(F.lit(before), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
        one = _templates(rows, ["item_id", "_i"]).select("item_id", "_i", "_c", F.when(
            F.size("_v") == 0, F.transform("_c", lambda c: F.lit(""))).otherwise(F.col("_v")).alias("_v"))
        skip = 2 if before else 1
        rest = lambda c: F.slice(c, F.lit(skip), F.greatest(F.size(c) - (skip - 1), F.lit(0)))
        made.append(one.select("item_id", "_i", rest("_c").alias("_c"), rest("_v").alias("_v"), F.lit(kind).alias("_kind")))
    order = Window.partitionBy("item_id", "_i", "_c").orderBy("_kind")
    each = reduce(DataFrame.unionAll, made).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    told = F.when((F.col("_kind") > 0) & (F.get("_v", F.lit(0)) != ""), F.get("_v", F.lit(0)))
    valued = each.withColumn("first", told).select(
        "item_id", "_i", F.size("_c").alias("tokens"), "_c", "first", _own_tokens().alias("_own"),
        F.when(F.col("first").isNull(), F.col("_v")).otherwise(
            F.concat(F.array(F.lit(BOUND)), F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))))).alias("_v"))
    words = F.min(F.size(F.filter("_v", lambda v: v.isin("", BOUND)))).over(Window.partitionBy("item_id", "_i"))
    exact = (F.col("tokens") < SHORTEST) | ((F.col("words") < WORDS) & (F.col("tokens") > 2 * F.col("words")))
    return valued.withColumn("words", words).withColumn("exact", exact)


def _benchmark_windows(known: DataFrame) -> DataFrame:
    """Windows of the items' templates with a plain word: those of WINDOW tokens, or the whole of a shorter item.

    The anchor of a window is the longest of its plain words.
    """
    made = known.where("not exact").select(
        "*", F.explode(F.array(*map(F.lit, range(SHORTEST, WINDOW + 1)))).alias("w"))
    made = made.where((F.col("w") <= F.col("tokens")) & ((F.col("w") == WINDOW) | (F.col("w") == F.col("tokens"))))
    each = made.select("*", F.explode(F.sequence(F.lit(1), F.col("tokens") - F.col("w") + 1)).alias("p"))
    return each.select(
        "item_id", "tokens", "words", "p", "w", F.xxhash64("w", F.slice("_c", "p", "w")).alias("h"),
        F.array_join(F.slice("_v", "p", "w"), "\t").alias("s"), F.when(F.col("p") == 1, F.col("first")).alias("first"),
        _longest(F.slice("_c", "p", "w")).alias("anchor")).where("anchor <> ''").distinct()


def _exact_occurrences(rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """Rows (doc_id, text_hash, text) that hold an `exact` item, found by all windows of its own tokens; None without items."""
    length = F.least("tokens", F.lit(WINDOW))
    each = known.where(F.col("exact") & (F.col("tokens") >= SHORTEST_EXACT)).select(
        "item_id", "tokens", "words", "_own", length.alias("w")).distinct()
    wanted = checkpointed(each.select(
        "item_id", "tokens", "words", "w", F.xxhash64("item_id", "_own").alias("which"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("tokens") - F.col("w") + 1), lambda p: F.xxhash64(
            F.col("w"), F.slice("_own", p, F.col("w"))))).alias("ip", "h")))
    lengths = sorted(r.w for r in wanted.select("w").distinct().collect())      # WINDOW - SHORTEST_EXACT + 1 at most
    if not lengths:
        return None
    own = _templates(rows, ["doc_id", "text_hash"]).select("doc_id", "text_hash", _own_tokens().alias("_own"))
    none = F.array().cast("array<struct<p:int,w:int,h:bigint>>")
    starts = F.concat(*[F.when(F.size("_own") >= w, F.transform(
        F.sequence(F.lit(0), F.size("_own") - w), _own_window(w))).otherwise(none) for w in lengths])
    made = own.select("doc_id", "text_hash", F.explode(starts).alias("_e")).select("doc_id", "text_hash", "_e.*")
    small = wanted.count() <= BROADCAST_WINDOWS
    met = made.join(F.broadcast(wanted) if small else wanted, ["w", "h"])
    whole = met.groupBy("doc_id", "text_hash", "item_id", "which", "tokens", "words", "w", (F.col("p") - F.col("ip")).alias("d")).agg(
        F.count_distinct("ip").alias("n")).where("n = tokens - w + 1")
    return whole.select("doc_id", "text_hash", "item_id", F.col("tokens").alias("covered"), "words", F.lit(0).alias("changed_slots"))


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold an item of the benchmark (item_id, text), one row per pair.

    Columns: doc_id, text_hash, item_id, covered (tokens of the item, without a bound first one where the
    others are enough), words (plain words among them), changed_slots (values that differ from the item's).
    Null and empty texts hold nothing; an item that is null, or shorter than SHORTEST_EXACT tokens, is never
    found. Repeated documents or items give the row once. Other columns are ignored; an empty table on either
    side gives an empty result.
    """
    known = checkpointed(_item_templates(items.select("item_id", "text")))
    wanted = checkpointed(_benchmark_windows(known).select(
        "item_id", F.col("tokens").alias("item_tokens"), F.col("words").alias("item_words"), F.col("p").alias("ip"),
        "w", "h", F.col("s").alias("is"), "first", "anchor"))
    anchors = [r.anchor for r in wanted.select("anchor").distinct().limit(ANCHORS + 1).collect()]
    wanted = wanted.drop("anchor")
    lengths = sorted(r.w for r in wanted.select("w").distinct().collect()) or [WINDOW]   # WINDOW - SHORTEST + 1 at most
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text")
    # few anchors tell which windows can meet one; with many, all windows go to the join
    made = _windows(rows, lengths, ["doc_id", "text_hash"], anchors if len(anchors) <= ANCHORS else None).drop("tokens")
    small = wanted.count() <= BROADCAST_WINDOWS
    kept = F.col("first").isNull() | (F.substring_index("s", "\t", 1) == F.col("first"))
    met = made.join(F.broadcast(wanted) if small else wanted, ["w", "h"]).where(kept).select(
        "doc_id", "text_hash", "item_id", "item_tokens", "item_words", (F.col("p") - F.col("ip")).alias("diagonal"), "ip", "w",
        "s", "is")
    found = (met.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(
        F.max("item_tokens").alias("item_tokens"), F.max("item_words").alias("item_words"),
        F.sort_array(F.collect_set(F.struct("ip", "w", "s", "is"))).alias("m")))
    # (a document without slots has no values: its side is one empty string)
    # tokens a window adds before the next one begins, with the slot values of item and document
    added = F.transform("m", lambda m, k: F.struct(
        F.least(m["w"], F.coalesce(F.get("m", k + 1)["ip"] - m["ip"], m["w"])).alias("n"),
        F.split(m["is"], "\t").alias("a"), F.split(m["s"], "\t").alias("b")))
    tokens = F.flatten(F.transform(added, lambda x: F.arrays_zip(
        F.slice(x["a"], F.lit(1), x["n"]).alias("a"), F.slice(x["b"], F.lit(1), x["n"]).alias("b"))))
    keys = ["doc_id", "text_hash", "item_id", "item_tokens", "item_words"]
    judged = (found.select(*keys, tokens.alias("t")).select(*keys, F.explode(_consistent_runs(F.col("t"))).alias("t"))
              .select(*keys, F.size("t").alias("covered"), F.array_distinct(_slots(F.col("t"))).alias("slots"),
                      (F.size("t") - F.size(_slots(F.col("t")))).alias("words"),
                      F.size(F.filter("t", lambda t: t["a"] == BOUND)).alias("bound")))
    # a bound first token counts where the others are not enough
    enough = lambda less: ((F.col("covered") - less >= F.least(F.lit(COVERED), F.col("item_tokens")))
                           & (F.col("words") - less >= F.least(F.lit(WORDS), F.col("item_words"))))
    less = F.when(enough(F.col("bound")), F.col("bound")).otherwise(0)
    judged = judged.where(enough(F.lit(0))).select(
        "doc_id", "text_hash", "item_id", (F.col("covered") - less).alias("covered"), (F.col("words") - less).alias("words"), "slots")
    changed = F.size(F.filter("slots", lambda t: t["a"] != t["b"]))
    judged = judged.select("doc_id", "text_hash", "item_id", "covered", "words", changed.alias("changed_slots"))
    exact = _exact_occurrences(rows, known)
    judged = judged if exact is None else judged.unionAll(exact)
    return judged.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("covered").alias("covered"), F.max("words").alias("words"), F.min("changed_slots").alias("changed_slots"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document that holds an item: doc_id, items (ids, sorted), covered, changed_slots."""
    return occurrences(docs, items).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").cast("bigint").alias("covered"),
        F.min("changed_slots").cast("bigint").alias("changed_slots"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, with their own columns, also where the id is null."""
    found = checkpointed(occurrences(docs, items).select("doc_id", "text_hash").distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_DOCUMENTS else found
    left, right = docs.alias("d"), found.alias("f")
    return left.join(right, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.xxhash64(F.col("d.text").cast("string")) == F.col("f.text_hash")), "left_anti").select("d.*")


def _sql() -> str:
    """The same by types of tokens and of the one before, with window functions."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    token = rf"[{MARKS}]|{DIGITS}|{WORD}".replace("'", "''")
    name = rf"^\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?:[{APOSTROPHE}][\p{{Ll}}\p{{M}}]+)?$".replace("'", "''")

    def typed(source: str, key: str) -> str:
        isname = f"(regexp_matches(t, '{name}') AND b NOT IN ('.', '!', '?', chr(10)))"
        return f"""
  SELECT r, {key}, p, tokens, CASE WHEN c IN ({listed(NUMBER_WORDS)}) THEN '{NUMBER}'
      WHEN c IN ({listed(UNITS)}) AND before IN ({listed(NUMBER_WORDS)}) THEN '{UNIT}' ELSE c END AS c,
    CASE WHEN c IN ('{NAME}', '{NUMBER}', '{UNIT}', {listed(NUMBER_WORDS)})
      OR c IN ({listed(UNITS)}) AND before IN ({listed(NUMBER_WORDS)}) THEN low ELSE '' END AS v
  FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS p, count(*) OVER (PARTITION BY r) AS tokens,
      lag(c, 1, '') OVER (PARTITION BY r ORDER BY i) AS before
    FROM (
      SELECT r, {key}, i, lower(t) AS low, CASE WHEN regexp_matches(t, '^[0-9]') THEN '{NUMBER}'
        WHEN lower(t) IN ({listed(UNITS)}) AND regexp_matches(b, '^[0-9]') THEN '{UNIT}'
        WHEN {isname} THEN '{NAME}' ELSE lower(t) END AS c
      FROM (SELECT r, {key}, i, t, lag(t, 1, '.') OVER (PARTITION BY r ORDER BY i) AS b FROM (
        SELECT r, {key}, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (
          SELECT {key}, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{token}') AS ts FROM {source})))
      WHERE t NOT IN ('.', '!', '?', chr(10))))"""

    def windows(source: str, key: str) -> str:
        return f"""
  SELECT r, {key}, tokens, p, w, string_agg(c, chr(1) ORDER BY k) AS h, list(v ORDER BY k) AS s, count(*) FILTER (WHERE v = '') AS plain FROM (
    SELECT a.r, a.{key}, a.tokens, a.p, w, k, x.c, x.v FROM {source} a, (VALUES {', '.join(f'({n})' for n in range(SHORTEST, WINDOW + 1))}) l(w),
      generate_series(0, w - 1) g(k) JOIN {source} x ON x.r = a.r AND x.p = a.p + k
    WHERE a.p + w - 1 <= a.tokens) GROUP BY ALL"""

    return f"""
WITH dt AS ({typed('documents', 'doc_id')}),
bt AS ({typed('benchmark', 'item_id')}),
bw AS (SELECT * FROM ({windows('bt', 'item_id')}) WHERE plain > 0 AND (w = {WINDOW} OR w = tokens)),
heads AS (SELECT DISTINCT w, string_split(h, chr(1))[1] AS head FROM bw),
dw AS (
  SELECT d.r, d.doc_id, d.p, l.w, string_agg(x.c, chr(1) ORDER BY x.p) AS h, list(x.v ORDER BY x.p) AS s
  FROM dt d JOIN heads l ON d.c = l.head JOIN dt x ON x.r = d.r AND x.p BETWEEN d.p AND d.p + l.w - 1
  WHERE d.p + l.w - 1 <= d.tokens GROUP BY d.r, d.doc_id, d.p, l.w),
met AS (
  SELECT DISTINCT dw.r, doc_id, bw.r AS br, item_id, tokens, dw.p - bw.p AS diagonal, bw.p AS ip, dw.w, dw.s AS ds, bw.s AS bs
  FROM dw JOIN bw USING (w, h)),
covered AS (
  SELECT DISTINCT r, doc_id, br, item_id, tokens, diagonal, ip + k AS at, ds[k + 1] AS b, bs[k + 1] AS a
  FROM met, generate_series(0, {WINDOW - 1}) g(k) WHERE k < w),
judged AS (
  SELECT r, doc_id, br, item_id, count(*) AS covered, count(DISTINCT CASE WHEN a <> b THEN a || chr(1) || b END) AS changed_slots
  FROM covered GROUP BY r, doc_id, br, item_id, tokens, diagonal
  HAVING count(*) >= least({COVERED}, tokens) AND count(*) FILTER (WHERE a = '') >= least({WORDS}, tokens)
    AND count(DISTINCT CASE WHEN a <> '' THEN a END) = count(DISTINCT CASE WHEN a <> '' THEN a || chr(1) || b END)
    AND count(DISTINCT CASE WHEN a <> '' THEN b END) = count(DISTINCT CASE WHEN a <> '' THEN a || chr(1) || b END))
SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, CAST(max(covered) AS BIGINT) AS covered,
  CAST(min(changed_slots) AS BIGINT) AS changed_slots
FROM judged GROUP BY doc_id"""


@query("op1_template_decontamination", _sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
