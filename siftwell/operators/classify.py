"""Rendering style of a page: static payload, text density, SSG / SSR / CSR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import collapse

# Where static generators leave a page's data, in order of preference.
PAYLOADS = (
    r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    r"(?s)window\.__NUXT__\s*=\s*(\{.*?\});",
    r"(?s)window\.page\s*=\s*(\{.*?\});",
)
MIN_DENSITY = 0.02
FALSY = r"^\s*(\{\s*\}|\[\s*\]|-?0+(\.0*)?([eE][+-]?\d+)?|\"\"|false|null)\s*$"


def ssg_payload(html: Column) -> Column:
    """The JSON text of the first payload that parses; null if there is none."""
    found = [F.regexp_extract(html, p, 1) for p in PAYLOADS]
    return F.coalesce(*[F.when(F.call_function("try_parse_json", f).isNotNull() & (f != ""), f) for f in found])


def is_static(payload: Column) -> Column:
    """Whether a payload holds anything: empty, zero and false values do not count."""
    return F.coalesce(payload.isNotNull() & ~payload.rlike(FALSY), F.lit(False))


def text_density(html: Column) -> Column:
    """Share of the page that is text once tags are blanked and white space collapsed."""
    text = collapse(F.regexp_replace(html, "<[^>]+>", " "))
    return F.length(text) / F.greatest(F.length(html), F.lit(1))


def render_type(html: Column, payload: Column) -> Column:
    """SSG with a payload, else SSR from a density of 0.02 on, else CSR."""
    return F.when(is_static(payload), "SSG").when(text_density(html) >= MIN_DENSITY, "SSR").otherwise("CSR")
