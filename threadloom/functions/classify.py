"""Failure classes, retry rules and state names as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of errors that are tried again, words that mark a failure as passing, database errors that are tried again, and the class of each kind.
RETRYABLE_KINDS = ("Network", "RateLimited", "UpstreamUnavailable")
TRANSIENT_WORDS = ("timeout", "temporar", "deadlock", "connection reset", "broken pipe", "connection")
RETRYABLE_DB = ("SerializationFailure", "ClosedConnection", "UnableToSendCommand", "RollbackTransaction")
DEFAULT_CLASS = {"Network": "network_transient", "RateLimited": "network_transient", "UpstreamUnavailable": "network_transient", "Unauthorized": "http_4xx", "Forbidden": "http_4xx", "MalformedResponse": "schema", "Other": "schema"}


def status_kind(status: Column) -> Column:
    """Kind of error of a response status other than 2xx; null for 2xx."""
    kind = F.when(status.between(200, 299), None).when(status == 401, "Unauthorized").when(status == 403, "Forbidden")
    return kind.when(status == 429, "RateLimited").when(status.between(500, 599), "UpstreamUnavailable").otherwise("Other")


def status_class(status: Column) -> Column:
    low = F.when(status.between(200, 299), None).when((status == 429) | status.between(500, 599), "network_transient")
    return low.when(status.between(400, 499), "http_4xx").otherwise("schema")


def is_retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE_KINDS)


def default_class(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(c)) for k, c in DEFAULT_CLASS.items()), F.lit("schema"))


def transport_kind(flags: dict[str, Column], status: Column) -> Column:
    """``flags``: timeout, connect, request, body, decode. A status decides first, then transport, then decoding."""
    moved = flags["timeout"] | flags["connect"] | flags["request"] | flags["body"]
    return F.when(status.isNotNull(), status_kind(status)).when(moved | flags["decode"], "Network").otherwise("MalformedResponse")


def transport_class(flags: dict[str, Column], status: Column) -> Column:
    moved = flags["timeout"] | flags["connect"] | flags["request"] | flags["body"]
    return F.when(status.isNotNull(), status_class(status)).when(moved, "network_transient").when(flags["decode"], "decode").otherwise("schema")


def persist_outcome(kind: Column) -> Column:
    return F.when(kind.isin(*RETRYABLE_DB), "retryable").otherwise("fatal")


def backend_outcome(message: Column) -> Column:
    low = F.lower(message)
    found = F.lit(False)
    for word in TRANSIENT_WORDS:
        found = found | F.contains(low, F.lit(word))
    return F.when(found, "transient").otherwise("permanent")


def tree_http_status(error: Column) -> Column:
    return F.when(error.isNull(), 200).when(error.isin("not_found", "not_a_story"), 404).when(error.isin("transient", "pool"), 503).otherwise(500)


def checked(name: Column, domain: tuple[str, ...], what: str) -> Column:
    """The name itself, or an error if it is outside its domain."""
    return F.when(name.isin(*domain), name).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(name, F.lit("null")))).cast("string"))
