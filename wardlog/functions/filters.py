"""Named event filters. `register` adds one; rules refer to filters by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from wardlog.constants import COMMON_USERS, STEALTH_FLAGS

_FILTERS: dict[str, Callable[[], Column]] = {}


def register(name: str, build: Callable[[], Column]) -> None:
    """`build` returns a boolean Column over the event columns; NULL counts as false."""
    _FILTERS[name] = build


def names() -> list[str]:
    return list(_FILTERS)


def event_filter(name: str) -> Column:
    return F.coalesce(_FILTERS[name](), F.lit(False))


def detail(key: str) -> Column:
    return F.try_element_at(F.col("detail"), F.lit(key))


def _is(log_type: str) -> Column:
    return F.col("log_type") == log_type


def _ssh_failed() -> Column:
    return _is("ssh") & (detail("event") == "failed")


def _uncommon_user() -> Column:
    user = F.lower(F.coalesce(F.col("username"), F.lit("")))
    return _ssh_failed() & (user != "") & ~user.isin(*COMMON_USERS)


def _stealth_flags() -> Column:
    flags = F.upper(detail("flags"))
    return flags.rlike(STEALTH_FLAGS) & ~flags.contains("SYN")


def _short_agent_post() -> Column:
    return (F.col("method") == "POST") & (F.length(F.trim(F.coalesce("user_agent", F.lit("")))) < 5)


def is_failure() -> Column:
    """Failed login, or a web response of 400 and above."""
    return F.coalesce(F.when(_is("ssh"), detail("event") == "failed")
                      .when(_is("web"), F.col("status_code") >= 400), F.lit(False))


register("ssh_failed", _ssh_failed)
register("ssh_failed_uncommon_user", _uncommon_user)
register("ssh_success", lambda: _is("ssh") & (detail("event") == "success"))
register("scan_event", lambda: _is("scan"))
register("abnormal_tcp_flags", _stealth_flags)
register("web_error", lambda: _is("web") & (F.col("status_code") >= 400))
register("short_ua_post", _short_agent_post)
register("any_event", lambda: F.lit(True))
