"""Media types, playback offsets and preview URLs of attachments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.fingerprint import string_fingerprint
from driftline.functions.paths import extension

# Extensions per media type; the first list that holds an extension wins.
IMAGE_EXTS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".wximage"]
VIDEO_EXTS = [".mp4", ".webm", ".ogg", ".mov", ".avi"]
AUDIO_EXTS = [".mp3", ".wav", ".ogg", ".m4a", ".flac"]
PDF_EXTS = [".pdf"]


def media_type(ext: Column) -> Column:
    e = F.lower(ext)
    return (
        F.when(e.isin(IMAGE_EXTS), "image")
        .when(e.isin(VIDEO_EXTS), "video")
        .when(e.isin(AUDIO_EXTS), "audio")
        .when(e.isin(PDF_EXTS), "pdf")
        .otherwise("other")
    )


def classify_media(df: DataFrame, path: str = "path", out: str = "media") -> DataFrame:
    return df.withColumn(out, media_type(extension(F.col(path))))


def media_offset(df: DataFrame, subpath: str = "subpath", out: str = "offset_seconds") -> DataFrame:
    """Seconds of a ``#t=`` fragment; null when there is none. Text after the number is ignored."""
    number = F.regexp_extract(F.col(subpath), r"\A#t=\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return df.withColumn(out, F.nullif(number, F.lit("")).try_cast("double"))


@dataclass(frozen=True)
class UrlRule:
    prefix: str
    exts: tuple[str, ...]
    url: str


def parse_url_rules(text: str) -> list[UrlRule]:
    """Rules from lines ``prefix@.a$.b#url``; the prefix is optional."""
    rules = []
    for line in text.split("\n"):
        left, mark, url = line.strip().partition("#")
        url = url.strip()
        if not (mark and left and url):
            continue
        prefix = ""
        if "@" in left:
            prefix, left = left.split("@")[:2]
        exts = tuple(e.strip().lower() for e in left.strip().split("$"))
        rules.append(UrlRule(prefix.strip().lower(), exts, url))
    return rules


def resolve_urls(
    df: DataFrame,
    rules_text: str,
    api: str,
    token: str,
    client: str,
    restricted: bool = False,
    out: str = "url",
) -> DataFrame:
    """URL of each attachment (``vault``, ``path``, ``subpath``): the first rule that fits, else the API.

    Null for a path without extension and, with ``restricted``, for types that have no preview.
    """
    path, subpath, vault = F.col("path"), F.coalesce(F.col("subpath"), F.lit("")), F.col("vault")
    ext = extension(path)
    kind = media_type(ext)
    bare = F.substring(F.lower(path), F.lit(1), F.length(path) - F.length(ext))

    chosen = None
    for rule in parse_url_rules(rules_text):
        fits = ext.isin(list(rule.exts))
        if rule.prefix:
            fits = fits & bare.startswith(rule.prefix)
        chosen = F.when(fits, F.lit(rule.url)) if chosen is None else chosen.when(fits, F.lit(rule.url))
    filled = F.lit(None).cast("string") if chosen is None else chosen
    for mark, value in [("path", path), ("vaultPath", path), ("subpath", subpath), ("vault", vault), ("type", kind)]:
        filled = F.replace(filled, F.lit("{" + mark + "}"), value)

    default = F.concat(
        F.lit(f"{api}/api/file?vault="), F.url_encode(vault),
        F.lit("&path="), F.url_encode(path),
        F.lit("&token="), F.url_encode(F.lit(token)),
        F.lit("&pathHash="), string_fingerprint(path),
        F.lit("&client="), F.url_encode(F.lit(client)),
    )
    shown = ext != ""
    if restricted:
        shown = shown & (kind != "other")
    return df.withColumn(out, F.when(shown, F.coalesce(filled, default)))
