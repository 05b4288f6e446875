"""Text primitives as Column expressions.  Lengths are code points; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every code point that Python's str.isspace and \s agree on, as a class that Java and RE2 both read.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


#: The same class, for Java alone: two ranges tell letters first, and it tests the rest one by one.
_SPACE = rf"[[\t- \x{{7f}}-\x{{3000}}]&&{SPACE}]"
#: Runs of white space other than one plain space.
_RUN = rf"{_SPACE}(?:(?<! ){_SPACE}*|{_SPACE}+)"


def strip(text: Column) -> Column:
    """Without white space at both ends; only texts that have some are searched for it.  ``text`` is
    used several times: a column or field, not a computation."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(_SPACE), F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")).otherwise(text)


def single_spaces(text: Column) -> Column:
    """White-space runs as single spaces."""
    return F.regexp_replace(text, _RUN, " ")


def collapse(text: Column) -> Column:
    """White-space runs as single spaces, both ends stripped."""
    return F.trim(single_spaces(text))


def tokenize(text: Column) -> Column:
    """Lower-cased words of at least two characters; letters, digits and ``_`` make up words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def reduction(original: Column, refined: Column) -> Column:
    """The share of tokens saved; negative if the result is longer."""
    return 1 - refined / F.greatest(original, F.lit(1))


def where_after(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` that fulfil a condition on computed columns.  The partition number is not
    deterministic, so the filter stays above what computes them; pushed below, it would compute
    (and parse) everything it needs once more."""
    fence = "fence"
    while fence in rows.columns:
        fence += "_"
    return rows.withColumn(fence, F.spark_partition_id()).where(condition & (F.col(fence) >= 0)).drop(fence)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)
