"""Mime types and codec lists as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEVC = r"(?i)^\s*(?:hev1|hvc1)\b"
AUDIO = r"(?i)^\s*(?:mp4a|ac-3|ec-3|opus|flac|mp3)\b"


def codecs(mime: Column) -> Column:
    """The codecs parameter as an array; empty where there is none."""
    listed = F.regexp_extract(mime, r"(?i)codecs\s*=\s*\"?([^\";]*)\"?", 1)
    return F.when(listed.isNull() | (F.trim(listed) == ""), F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(listed, ","), F.trim))


def has_hevc(mime: Column) -> Column:
    return F.exists(codecs(mime), lambda c: c.rlike(HEVC))


def is_muxed(mime: Column) -> Column:
    """Whether it names both an HEVC and a known audio codec."""
    return has_hevc(mime) & F.exists(codecs(mime), lambda c: c.rlike(AUDIO))


def with_video_codec(mime: Column, codec: Column) -> Column:
    """The mime type with its HEVC codec exchanged and the others kept."""
    kept = F.array_join(F.transform(codecs(mime), lambda c: F.when(c.rlike(HEVC), codec).otherwise(c)), ",")
    return F.when(has_hevc(mime), F.concat(F.trim(F.substring_index(mime, ";", 1)), F.lit('; codecs="'), kept, F.lit('"'))).otherwise(mime)


def wants_transmux(mime: Column) -> Column:
    """Plain HEVC video in MP4, not muxed with audio."""
    return mime.rlike(r"(?i)^\s*video/mp4\b") & has_hevc(mime) & ~is_muxed(mime)
