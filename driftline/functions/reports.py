"""Readable sizes, versions, platforms, error texts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit names, codes and texts of the authorization report.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
AUTH_MESSAGES = {
    307: "Authorization token is missing",
    308: "Session expired or token has been revoked",
    309: "Authorization token is invalid or incomplete",
    310: "Authorization token has expired",
    312: "Authorization token is restricted by IP",
    313: "Authorization token is restricted by user agent",
    314: "Authorization token is restricted by client",
    315: "Authorization token scope is restricted",
}
AUTH_REIMPORT_CODES = [307, 308, 309, 310]
AUTH_REIMPORT_WORDS = ["rotated", "revoked", "no longer exists", "missing"]
AUTH_DEFAULT = "Authorization failed"
AUTH_HINT = " Hint=Please re-import the API configuration from the management console."


def size_text(size: Column) -> Column:
    """``0 B``, else at most two decimals with the largest unit that fits (a long ends at EB)."""
    power = F.lit(0)
    for i in range(1, len(SIZE_UNITS)):
        power = F.when(size >= F.lit(1024**i), F.lit(i)).otherwise(power)
    hundredths = F.floor(size * F.lit(100.0) / F.pow(F.lit(1024.0), power) + F.lit(0.5)).cast("long")
    whole, part = F.floor(hundredths / 100).cast("long"), hundredths % 100
    decimals = (
        F.when(part == 0, "")
        .when(part % 10 == 0, F.concat(F.lit("."), (part / 10).cast("int").cast("string")))
        .otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 2, "0")))
    )
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), power + 1)
    text = F.concat(whole.cast("string"), decimals, F.lit(" "), unit)
    return F.when(size.isNull() | (size == 0), "0 B").otherwise(text)


def size_report(df: DataFrame, size: str = "size", out: str = "size_text") -> DataFrame:
    return df.withColumn(out, size_text(F.col(size)))


def safe_ctime(df: DataFrame, now: int, out: str = "safe_ctime") -> DataFrame:
    """ctime when positive, else mtime when set, else ``now``."""
    mtime = F.when(F.col("mtime") != 0, F.col("mtime"))
    return df.withColumn(out, F.coalesce(F.when(F.col("ctime") > 0, F.col("ctime")), mtime, F.lit(now)))


def client_platform(df: DataFrame, name: str = "client_name", out: str = "platform") -> DataFrame:
    n = F.lower(F.coalesce(F.col(name), F.lit("")))
    return df.withColumn(
        out,
        F.when(n.contains("web"), "web")
        .when(n.contains("mac"), "mac")
        .when(n.contains("win"), "windows")
        .when(n.contains("android"), "android")
        .when(n.contains("os"), "ios")
        .otherwise("unknown"),
    )


def numeric_parts(version: Column) -> Column:
    """Dotted parts as numbers; what is not a number counts as 0."""
    zero = F.lit(0.0)
    parts = F.split(version, r"\.")
    return F.transform(parts, lambda p: F.coalesce(F.nanvl(p.try_cast("double"), zero), zero))


def version_parts(version: Column) -> Column:
    """Numeric parts before the first ``-``."""
    return numeric_parts(F.substring_index(version, "-", 1))


def is_newer(current: Column, latest: Column) -> Column:
    """True when ``latest`` is above ``current``; missing parts are 0, an empty text is never newer."""
    a, b = version_parts(current), version_parts(latest)
    zero = F.lit(0.0)
    padded_a = F.zip_with(a, b, lambda x, y: F.coalesce(x, zero))
    padded_b = F.zip_with(a, b, lambda x, y: F.coalesce(y, zero))
    given = (F.coalesce(current, F.lit("")) != "") & (F.coalesce(latest, F.lit("")) != "")
    return given & F.coalesce(padded_b > padded_a, F.lit(False))


def version_report(df: DataFrame, current: str = "current", latest: str = "latest") -> DataFrame:
    return df.withColumn("is_new", is_newer(F.col(current), F.col(latest)))


def _trimmed(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    return F.when(clean == "undefined", "").otherwise(clean)


def auth_error_report(df: DataFrame, out: str = "report") -> DataFrame:
    """Text of an authorization error from ``code``, ``message`` and ``details`` (text or array of text)."""
    code = F.col("code")
    fallback = F.lit(AUTH_DEFAULT)
    for known, text in AUTH_MESSAGES.items():
        fallback = F.when(code == known, text).otherwise(fallback)
    message = F.coalesce(F.nullif(_trimmed(F.col("message")), F.lit("")), fallback)
    details = F.col("details")
    if isinstance(df.schema["details"].dataType, T.ArrayType):
        kept = F.filter(F.transform(details, _trimmed), lambda d: d != "")
        details = F.coalesce(F.array_join(kept, ", "), F.lit(""))
    else:
        details = _trimmed(details)
    spoken = F.lower(F.concat_ws(" ", message, details))
    hinted = code.isin(AUTH_REIMPORT_CODES)
    for word in AUTH_REIMPORT_WORDS:
        hinted = hinted | spoken.contains(word)
    return df.withColumn(
        out,
        F.concat(
            F.lit("Service Authorization Error: Code="), code.cast("string"), F.lit(" Msg="), message,
            F.when(details != "", F.concat(F.lit(" Details="), details)).otherwise(""),
            F.when(hinted, AUTH_HINT).otherwise(""),
        ),
    )


def to_sync_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Request records as JSON: with ``baseHash``, or ``baseHashMissing``; config rows carry neither."""
    based = F.col("kind") != "config"
    return df.withColumn(
        out,
        F.to_json(
            F.struct(
                F.col("path"),
                F.col("path_hash").alias("pathHash"),
                F.col("content_hash").alias("contentHash"),
                F.col("mtime"),
                F.col("ctime"),
                F.col("size"),
                F.when(based, F.col("base_hash")).alias("baseHash"),
                F.when(based & F.col("base_hash").isNull(), F.lit(True)).alias("baseHashMissing"),
            )
        ),
    )
