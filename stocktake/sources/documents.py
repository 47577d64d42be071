"""Small JSON documents: manifests, settings, locks."""

from __future__ import annotations

import errno

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, kdf string, kdf_params map<string, string>, verifier string, created_at string"
REMOTE = "bucket string, prefix string, region string, mirror_path string"
LOCK = "pid long, acquiredAt string, hostname string, command string"

# What makes an error of the store worth another attempt.
RETRYABLE_STATUS = frozenset({429, 500, 502, 503, 504})
CAUSES = 5


def read(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file; ``valid`` is whether it is JSON and has all required fields."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", schema).alias("doc"))
    valid = F.col("doc").isNotNull()
    for field in required:
        valid = valid & F.col("doc").getField(field).isNotNull()
    return parsed.select("doc.*", F.coalesce(valid, F.lit(False)).alias("valid"))


def encode_list(values: Column | str) -> Column:
    return F.to_json(values)


def decode_list(text: Column | str) -> Column:
    return F.from_json(text, "array<string>")


# Names of errors, of the store's or the system's, that are worth another attempt.
RETRYABLE_NAMES = frozenset({
    "NetworkingError", "TimeoutError", "RequestTimeout", "RequestTimeoutException", "SlowDown", "ThrottlingException",
    "RequestThrottled", "RequestThrottledException", "InternalError", "ServiceUnavailable",
})
#: Python's own names for the same: resets, broken pipes, names that don't resolve.
OWN_NAMES = frozenset({"ConnectionResetError", "BrokenPipeError", "gaierror"})
#: The network or the host can't be reached at the moment, or was lost.
UNREACHABLE = frozenset({errno.ECONNRESET, errno.EPIPE, errno.ETIMEDOUT, errno.ENETUNREACH, errno.EHOSTUNREACH, errno.ENETDOWN})


def _told(error: BaseException) -> tuple[set, set]:
    """The names and status codes that an error tells: its class, attributes, and the response that clients of object stores attach."""
    response = getattr(error, "response", None)
    response = response if isinstance(response, dict) else {}
    inner, meta = response.get("Error") or {}, response.get("ResponseMetadata") or {}
    names = {type(error).__name__, getattr(error, "name", None), getattr(error, "code", None), inner.get("Code")}
    status = {getattr(error, k, None) for k in ("status", "status_code", "code")} | {meta.get("HTTPStatusCode")}
    return {n for n in names if isinstance(n, str)}, {x for x in status if isinstance(x, int)}


def is_transient(error: BaseException | None, names: frozenset[str] = RETRYABLE_NAMES | OWN_NAMES) -> bool:
    """Whether an error, or one of the first few that it wraps, is worth another attempt; a refused connection isn't."""
    for _ in range(CAUSES):
        if error is None:
            return False
        told, status = _told(error)
        if told & names or status & RETRYABLE_STATUS or getattr(error, "errno", None) in UNREACHABLE:
            return True
        error = error.__cause__ or error.__context__
    return False
