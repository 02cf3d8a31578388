"""What responses and errors mean, and how long to wait, as columns over logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Errors of object stores that no retry mends.
FATAL_ERRORS = [
    "AccessDenied",
    "Access Denied",
    "InvalidAccessKeyId",
    "SignatureDoesNotMatch",
    "ExpiredToken",
    "ExpiredTokenException",
    "NoSuchBucket",
    "InvalidBucketName",
    "AccountProblem",
    "InvalidSecurity",
    "NotSignedUp",
    "InvalidIdentityToken",
    "MalformedPolicy",
    "InvalidClientTokenId",
]

FIRST_DELAY_MS = 100
MOST_RETRIES = 10


def classify_error(message: Column) -> Column:
    """``fatal`` if the message holds one of FATAL_ERRORS, else ``transient``; null and empty are transient."""
    return F.when(message.rlike("|".join(FATAL_ERRORS)), "fatal").otherwise("transient")


def classify_response(status: Column) -> Column:
    """``ok``, ``throttled``, ``fatal`` or ``retry``; null (no response) is ``retry``."""
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 429, "throttled")
        .when(status.between(400, 499), "fatal")
        .otherwise("retry")
    )


def response_class(status: int | None) -> str:
    """The same for one response, in the sink."""
    if status is not None and 200 <= status <= 299:
        return "ok"
    if status == 429:
        return "throttled"
    return "fatal" if status is not None and 400 <= status <= 499 else "retry"


def retry_delay_ms(retry: Column, retry_after: Column | None = None) -> Column:
    """Milliseconds before the n-th retry, doubling from 100; a Retry-After in seconds goes first."""
    own = F.lit(FIRST_DELAY_MS) * F.pow(F.lit(2.0), retry - 1)
    return own if retry_after is None else F.coalesce(retry_after * 1000, own)


def retries_allowed(max_retries: int) -> int:
    return min(max_retries, MOST_RETRIES)
