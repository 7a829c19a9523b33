"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated a single time per row.

    A filter on a projected column is normally pushed below the projection, and the expression is
    then evaluated for the filter and again for the result. Behind a generator it is not pushed.
    """
    for name, expression in columns.items():
        df = df.select("*", F.explode_outer(F.array(expression)).alias(name))
    return df


def decode_once(text: Column) -> Column:
    """URL-decode one pass: `+` is a space, a malformed escape stays as it is, NULL becomes ''.

    The decoder would raise on a lone `%`, so those are escaped first. One pass only: a doubly
    encoded payload stays visible as an encoding.
    """
    text = F.coalesce(text, F.lit(""))
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def field_text(match_field: str | None) -> Column:
    """The text of an event that a pattern with this match field looks at."""
    columns = {
        "url": ("url", "raw"), "user_agent": ("user_agent",), "username": ("username",),
    }.get(match_field or "any", ("url", "raw", "user_agent", "username"))
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def clip(text: Column, limit: int) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(trimmed) > limit,
                  F.concat(F.substring(trimmed, 1, limit), F.lit("…"))).otherwise(trimmed)


def snippet(text: Column, needle: Column, width: int = 100) -> Column:
    """`width/2` characters either side of the first occurrence, on one line."""
    at = F.instr(text, needle)
    half = width // 2
    start = F.greatest(at - half, F.lit(1))
    length = at + F.length(needle) + half - start
    cut = F.trim(F.replace(F.substring(text, start, length), F.lit("\n"), F.lit(" ")))
    return F.when((F.length(text) > 0) & (F.length(needle) > 0) & (at > 0), cut).otherwise("")


def url_path(url: Column) -> Column:
    """Path of a URL without query, fragment, `;params` and trailing slash; '/' for the root."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    path = F.when(path == "", F.regexp_extract(url, r"^([^?]*)", 1)).otherwise(path)
    trimmed = F.rtrim(path, F.lit("/"))
    return F.when(url == "", "").when(trimmed == "", "/").otherwise(trimmed)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    authority = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)"
    return F.lower(F.regexp_extract(url, authority, 1))


def url_port(url: Column) -> Column:
    """Explicit port, or the default of the scheme (443 for https, else 80)."""
    explicit = F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^:/?#]*):(\d+)", 1)
    default = F.when(url_scheme(url) == "https", 443).otherwise(80)
    return F.coalesce(F.nullif(explicit, F.lit("")).try_cast("int"), default)


def same_origin(left: Column, right: Column) -> Column:
    return (url_host(left) == url_host(right)) & (url_port(left) == url_port(right))


def normalise_target(url: Column) -> Column:
    """Trim, add http:// where no web scheme is given, drop trailing slashes."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    return F.when(trimmed == "", "").otherwise(F.rtrim(full, F.lit("/")))


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; `%` and `_` in the needle are ordinary characters."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.coalesce(column.ilike(f"%{escaped}%"), F.lit(False))


def label_of(mapping: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))
