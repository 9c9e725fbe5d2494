"""Variants named by HLS and DASH manifests."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

SCHEMA = "path string, position int, variant_id string, height int, width int, bandwidth long, average_bandwidth long, codecs string, uri string"
_ATTRIBUTE = re.compile(r'([A-Z0-9-]+)=("[^"]*"|[^,]*)')


def hls(text: str) -> list[tuple]:
    out, told = [], None
    for line in text.splitlines():
        if line.startswith("#EXT-X-STREAM-INF:"):
            told = {k: v.strip('"') for k, v in _ATTRIBUTE.findall(line.split(":", 1)[1])}
        elif told is not None and line.strip() and not line.startswith("#"):
            width, _, height = told.get("RESOLUTION", "").partition("x")
            out.append((line.strip(), int(height) if height else None, int(width) if width else None, int(told.get("BANDWIDTH", 0)) or None, int(told.get("AVERAGE-BANDWIDTH", 0)) or None, told.get("CODECS"), line.strip()))
            told = None
    return out


def dash(text: str) -> list[tuple]:
    out = []
    root = ElementTree.fromstring(text)
    for group in root.findall(".//{*}AdaptationSet"):
        for r in group.findall("{*}Representation"):
            get = lambda k: r.get(k, group.get(k))  # noqa: B023, E731
            number = lambda k: int(get(k)) if get(k) else None  # noqa: B023, E731
            out.append((r.get("id"), number("height"), number("width"), number("bandwidth"), None, get("codecs"), None))
    return out


def variants(files: DataFrame) -> DataFrame:
    """files: path, content.  One row per variant; what can't be parsed has none."""

    def parse(frames):
        import pandas as pd

        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                text = bytes(content or b"").decode("utf-8", "replace")
                try:
                    found = hls(text) if text.lstrip().startswith("#EXTM3U") else dash(text)
                except ElementTree.ParseError:
                    found = []
                out += [(path, i, *v) for i, v in enumerate(found)]
            got = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield got.astype({"height": "Int32", "width": "Int32", "bandwidth": "Int64", "average_bandwidth": "Int64"})

    return files.select("path", "content").mapInPandas(parse, SCHEMA)
