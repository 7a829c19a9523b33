"""Attack signatures: one class, the first class, all classes, custom patterns, coverage audit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import SIGNATURE_LABELS, SIGNATURE_PARTS, SIGNATURES
from wardlog.functions.text import decode_once, label_of, once


# Blanks, word characters and word ends of patterns are Unicode ones.
UNICODE = "(?U)"

def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def _any_part(name: str, text: Column, matches: Callable[[str, Column], Column]) -> Column:
    """Whether the text holds what some alternative of the class needs, and matches it.

    Searching for what an alternative needs is several times cheaper than its pattern, and one alternative is
    several times cheaper than all of them at every character. Cases are compiled to methods of their own; one long
    `or` would be too long to be compiled.
    """
    sharing: dict[str, list[Column]] = {}
    for pattern, first, *more in SIGNATURE_PARTS[name]:
        test = [text.contains(n) if isinstance(n, str) else _any(text.contains(x) for x in n) for n in more]
        whole = more[-1] if more else first
        if not isinstance(whole, str) or pattern.lower() != re.escape(whole).replace(r"\-", "-"):   # not all of it
            test.append(matches(UNICODE + pattern.lower(), text))
        sharing.setdefault(first, []).append(reduce(lambda x, y: x & y, test, F.lit(True)))
    cases = F
    for first, tests in sharing.items():
        cases = cases.when(text.contains(first) & _any(tests), F.lit(True))
    return cases.otherwise(F.lit(False))


def class_test(name: str, low: Column, decoded_low: Column) -> Column:
    """Match on lower-cased text, or on its lower-cased decoded form where there is one."""
    # no substring has a blank, so those of a text without `%` are also those of its decoded form
    plain = _any_part(name, low, lambda pattern, text: text.rlike(pattern) | decoded_low.rlike(pattern))
    decoded = _any_part(name, decoded_low, lambda pattern, text: text.rlike(pattern))
    return F.coalesce(F.when(plain, F.lit(True)).when(low.contains("%"), decoded), F.lit(False))


def lowered(text: Column) -> Column:
    return F.lower(text)


def decoded_lowered(text: Column) -> Column:
    """Lower-cased decoded text; NULL where there is nothing to decode."""
    return (F.when(text.contains("%"), F.lower(decode_once(text)))
            .when(text.contains("+"), F.lower(F.replace(text, F.lit("+"), F.lit(" ")))))


def has_class(text: Column, name: str) -> Column:
    return class_test(name, lowered(text), decoded_lowered(text))


def _chosen(names: Iterable[str] | None) -> list[str]:
    return [n for n in (list(names or ()) or list(SIGNATURES)) if n in SIGNATURES]


def searchable(df: DataFrame, text: Column) -> DataFrame:
    """Add `_low` and `_declow`, the two forms of a text that signatures are searched in."""
    ready = once(df, _text=F.coalesce(text, F.lit("")))
    forms = F.struct(lowered(F.col("_text")).alias("low"),
                     decoded_lowered(F.col("_text")).alias("dec"))
    return (once(ready, _forms=forms)
            .withColumns({"_low": F.col("_forms.low"), "_declow": F.col("_forms.dec")})
            .drop("_text", "_forms"))


def _tests(names: list[str]) -> list[Column]:
    return [F.when(class_test(n, F.col("_low"), F.col("_declow")), F.lit(n)) for n in names]


def of_class(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Rows whose text matches one class."""
    return searchable(df, text).where(
        class_test(name, F.col("_low"), F.col("_declow"))).drop("_low", "_declow")


def with_first_class(df: DataFrame, text: Column, into: str,
                     names: Iterable[str] | None = None) -> DataFrame:
    """Add the first class, in the order given, that matches; '' when none does."""
    return once(searchable(df, text), **{into: F.coalesce(*_tests(_chosen(names)), F.lit(""))}
                ).drop("_low", "_declow")


def with_classes(df: DataFrame, text: Column, into: str,
                 names: Iterable[str] | None = None) -> DataFrame:
    """Add every class that matches, as an array in declaration order."""
    return once(searchable(df, text), **{into: F.array_compact(F.array(*_tests(_chosen(names))))}
                ).drop("_low", "_declow")


def explode_classes(df: DataFrame, text: Column, into: str,
                    names: Iterable[str] | None = None) -> DataFrame:
    """One row per class that matches."""
    found = F.explode_outer(F.array_compact(F.array(*_tests(_chosen(names)))))
    return (searchable(df, text).withColumn(into, found).where(F.col(into).isNotNull())
            .drop("_low", "_declow"))


def _java(pattern: str) -> str:
    return "(?iuU)" + pattern.replace("(?P<", "(?<")


def valid_pattern(pattern: str) -> bool:
    """Whether the engine that runs a pattern accepts it. Nothing but the pattern is looked at, so no job runs."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(_java(pattern))
    except (PySparkException, Py4JJavaError):
        return False
    return True


def custom_match(text: Column, pattern: str) -> Column:
    """User pattern, case-insensitive and Unicode aware; an invalid pattern never matches."""
    if not valid_pattern(pattern):
        return F.lit(False)
    escaped = text.contains("%") | text.contains("+")
    return F.coalesce(text.rlike(_java(pattern)) | (escaped & decode_once(text).rlike(_java(pattern))),
                      F.lit(False))


def class_label(name: Column) -> Column:
    return label_of(SIGNATURE_LABELS, name, "—")


def audit_requests(requests: DataFrame, cls: str = "cls", url: str = "url") -> DataFrame:
    """Labelled requests whose class has no signature, or is not matched by it."""
    known = F.col(cls).isin(*SIGNATURES)
    matched = F.array_contains("_classes", F.col(cls))
    return (with_classes(requests, F.col(url), "_classes")
            .withColumn("reason", F.when(~known, "no signature for this class")
                        .when(~matched, "not matched by its signature"))
            .where(F.col("reason").isNotNull()).drop("_classes"))
