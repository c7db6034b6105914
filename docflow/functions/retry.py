"""Column functions over a log of failed calls: whether to try again, and how long to wait."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages that mean a permanent or a passing failure, headers with the time of a reset, and the
# patterns of a status and of a wait in a message.
PERMANENT = (
    "invalid api key",
    "invalid_api_key",
    "token expired or incorrect",
    "provider not provided",
    "llm provider not provided",
    "insufficient balance",
    "no resource package",
    "unauthorized",
    "authentication",
    "401",
    "403",
)
PASSING = ("rate limit", "too many requests", "timeout", "timed out", "temporarily unavailable", "service unavailable", "connection reset", "try again")
RESET_HEADERS = ("x-ratelimit-reset", "x-rate-limit-reset", "ratelimit-reset", "x-ratelimit-reset-requests")
CANCELLED = "cancelled by user"
STATUS = r"\b(4\d\d|5\d\d)\b"
WAIT = r"(?:retry after|try again in)\s+(\d+(?:\.\d+)?)\s*(seconds?|secs?|s|minutes?|mins?|m)?"


def _any(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def status_code(status: Column, message: Column) -> Column:
    return F.coalesce(status, F.regexp_extract(message, STATUS, 1).try_cast("int"))


def retryable(status: Column, message: Column) -> Column:
    text, code = F.lower(F.coalesce(message, F.lit(""))), status_code(status, F.coalesce(message, F.lit("")))
    return (
        F.when(_any(text, PERMANENT) | F.contains(text, F.lit(CANCELLED)), F.lit(False))
        .when(code.isin(429, 408) | code.between(500, 599), F.lit(True))
        .when(code.isin(400, 401, 403, 404, 422), F.lit(False))
        .otherwise(_any(text, PASSING))
    )


def _header(headers: Column, name: str) -> Column:
    return F.trim(F.try_element_at(headers, F.lit(name))).try_cast("double")


def wait_hint(headers: Column, message: Column, now: Column) -> Column:
    """struct(source, seconds) or null. headers: map with lower-case names; now: seconds since the epoch."""
    given = F.trim(F.try_element_at(headers, F.lit("retry-after")))
    # a number of seconds, or a date of HTTP
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(given, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    after = F.coalesce(given.try_cast("double"), at - now)
    reset = F.coalesce(*[_header(headers, h) for h in RESET_HEADERS])
    # fixed rule: what is more than half of now is a time, anything less a number of seconds
    reset = F.when(reset > now * 0.5, reset - now).otherwise(reset)
    text = F.lower(F.coalesce(message, F.lit("")))
    said = F.regexp_extract(text, WAIT, 1).try_cast("double") * F.when(F.startswith(F.regexp_extract(text, WAIT, 2), F.lit("m")), 60.0).otherwise(1.0)

    def hint(name: str, seconds: Column) -> Column:
        return F.struct(F.lit(name).alias("source"), F.greatest(seconds, F.lit(0.0)).alias("seconds"))

    return F.when(after.isNotNull(), hint("retry-after-header", after)).when(reset.isNotNull(), hint("x-ratelimit-reset", reset)).when(said.isNotNull(), hint("provider-message", said))


def wait_seconds(hint: Column, attempt: Column, most: float, jitter: Column | None = None) -> Column:
    """The hint's seconds, else two to the power of the earlier attempts plus a jitter (0 by default, so that runs agree); capped."""
    power = F.least(F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(most))) + (F.lit(0.0) if jitter is None else jitter)
    return F.least(F.coalesce(hint["seconds"], power), F.lit(float(most)))
