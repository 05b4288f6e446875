"""Sections of a page: a heading and the nodes up to the next one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let, tokenize
from siftwell.operators.extract import HEADINGS, NODE

NO_DEPTH, NO_LEVEL = 999, 99
EMPTY = f"array<struct<sec:int,level:int,head:array<string>,body:array<string>,token_count:int,depth:int,nodes:array<{NODE}>>>"


def sections(nodes: Column) -> Column:
    """array of struct(sec, level, head tokens, body tokens, token_count, depth, nodes), in order.

    ``level`` is the heading's (99 without one); ``depth`` the smallest of the heading's level and
    its nodes' depths (999 for neither)."""

    def cut(n: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(n) - 1), lambda i: (i == 0) | F.get(n, i)["tag"].isin(*HEADINGS))

        def every(starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                own = F.slice(n, s + 1, F.coalesce(F.get(starts, k + 1), F.size(n)) - s)
                return let(own, lambda c: _section(c, k))

            return F.transform(starts, one)

        return let(heads, every)

    return F.when(F.size(nodes) > 0, let(nodes, cut)).otherwise(F.array().cast(EMPTY))


def _section(own: Column, k: Column) -> Column:
    first = F.get(own, F.lit(0))
    headed = first["tag"].isin(*HEADINGS)
    rest = F.when(headed, F.slice(own, 2, F.size(own) - 1)).otherwise(own)
    level = F.when(headed, F.substr(first["tag"], F.lit(2), F.lit(1)).cast("int")).otherwise(NO_LEVEL)
    start = F.when(headed, level).otherwise(NO_DEPTH)
    head = F.when(headed, tokenize(first["text"])).otherwise(F.array().cast("array<string>"))
    body = F.flatten(F.transform(rest, lambda x: tokenize(x["text"])))
    return let(
        F.struct(head.alias("h"), body.alias("b")),
        lambda t: F.struct(
            k.alias("sec"), level.alias("level"), t["h"].alias("head"), t["b"].alias("body"), (F.size(t["h"]) + F.size(t["b"])).alias("token_count"),
            F.aggregate(rest, start, lambda a, x: F.least(a, x["depth"])).alias("depth"), own.alias("nodes"),
        ),
    )
