"""Page metadata: for each field the first candidate that is not empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import strip

# Fields and the places they are taken from, in order.
FIELDS = {
    "title": ("title", "property:og:title"),
    "lang": ("lang",),
    "canonical_url": ("canonical",),
    "description": ("name:description", "property:og:description"),
    "author": ("name:author", "property:article:author"),
    "published_time": ("property:article:published_time",),
    "modified_time": ("property:article:modified_time",),
    "site_name": ("property:og:site_name",),
}
#: Fields that stay, blank, when their attribute holds only white space.
KEPT_BLANK = ("lang", "canonical_url")


def meta(found: Column) -> Column:
    """map(field -> value) from the ``meta`` candidates of a parsed page; empty fields are left out."""
    entries = []
    for field, places in FIELDS.items():
        values = [F.nullif(found[p], F.lit("")) for p in places]
        value = F.coalesce(*values)
        value = strip(value) if field == "canonical_url" else value
        if field == "lang":
            value = found["lang"]
        entries.append(F.struct(F.lit(field).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
