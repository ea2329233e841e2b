"""Column-naming conventions that give a figure its meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix conventions results are named by.
RATE_NAME = r"(?i)(^|_)(rate|ratio|pct|percent|share)$"
PERCENT_NAME = r"(?i)(^|_)(rate|ratio|pct|percent)$"
COUNT_NAME = (
    r"(?i)(^|_)(n|count|denominator|users|sessions|rows|events|applications|payers|uploads|opens|clicks)$"
)
BASE_NAME = r"(?i)(^|_)base$"
MAGNITUDE_NAME = r"(?i)(^|_)(sum|total|amount|avg|mean|median|p\d{2})$"
MONEY_NAME = r"(?i)(amount|value|price|revenue|fee|discount|total|balance)"
IDENTIFIER_NAME = (
    r"(?i)(^|_)(id|ids|uuid|guid|token|hash|key)$"
    r"|^(user_id|application_id|app_session_id|share_id|group_id|client_ip)$"
)
SAFE_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
DENOMINATOR_SUFFIXES = ("n", "denominator", "total", "base")
GENERIC_DENOMINATORS = ("n", "denominator")


def is_rate(name: str) -> bool:
    return re.search(RATE_NAME, name) is not None


def is_count(name: str) -> bool:
    return re.search(COUNT_NAME, name) is not None


def rate_stem(name: str) -> str:
    """``otp_success_rate`` -> ``otp_success``; a bare ``rate`` has an empty stem."""
    return re.sub(r"_$", "", re.sub(RATE_NAME, "", name))


def denominator_names(rate: str) -> list[str]:
    """Names a rate's denominator may carry, best first."""
    stem = rate_stem(rate)
    return [f"{stem}_{suffix}" for suffix in DENOMINATOR_SUFFIXES] + list(GENERIC_DENOMINATORS)


def rate_stem_col(name: Column) -> Column:
    """Column form of :func:`rate_stem`."""
    return F.regexp_replace(F.regexp_replace(name, RATE_NAME, ""), "_$", "")
