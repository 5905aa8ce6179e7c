"""Where an edge is written: lines of the model's text, checked against what they must hold."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.dialect import blanked, depths, locate
from tributary.plans.lineage import ModelLineage

#: Clauses that a type of indirect edge is written in.
CLAUSE = {"JOIN": ("join",), "FILTER": ("where", "having", "qualify"), "GROUP_BY": ("group",), "SORT": ("order",), "WINDOW": ("over", "window"), "CONDITIONAL": ("filter",)}
_ENDS = re.compile(r"\b(from|join|left|right|full|inner|cross|where|group|having|qualify|order|limit|union|except|intersect)\b", re.I)


class Place(NamedTuple):
    first: int
    last: int
    level: str  # line, star or model
    reason: str | None = None


def holds(text: str, word: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text, re.I) is not None


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest list of pairs that rises on both sides, of pairs in order of the first."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(ends, j)
        back.append(at[place - 1] if place else -1)
        ends[place : place + 1] = [j]
        at[place : place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def source_lines(written: str, compiled: str) -> list[tuple[int, int] | None]:
    """For each line of a compiled text the lines (first, last) of the written text that it comes from, None where there are none.

    Lines that stand once in either text, and in the same order, are fixed points.
    From them on equal neighbours go together, up and down; what is left between
    two fixed points goes line by line where both sides have as many lines, or
    else each compiled line comes from all written ones there.
    """
    left, right = ([x.strip() for x in t.splitlines()] for t in (written, compiled))
    once = [{x: i for i, x in enumerate(side) if n[x] == 1} for side in (left, right) for n in [Counter(side)]]
    fixed = _chain(sorted((i, once[1][x]) for x, i in once[0].items() if x in once[1]))
    found: list[tuple[int, int] | None] = [None] * len(right)
    for (i, j), (i_end, j_end) in zip([(-1, -1), *fixed], [*fixed, (len(left), len(right))], strict=True):
        if j >= 0:
            found[j] = (i + 1, i + 1)
        i, j = i + 1, j + 1
        while i < i_end and j < j_end and left[i] == right[j]:
            found[j] = (i + 1, i + 1)
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and left[i_end - 1] == right[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found[j_end] = (i_end + 1, i_end + 1)
        for k in range(j, j_end if i < i_end else j):
            found[k] = (i + 1 + k - j,) * 2 if i_end - i == j_end - j else (i + 1, i_end)
    return found


def clause_lines(sql: str, kind: str, key: str) -> Place:
    """Lines of the first clause of a type that holds the key; the whole text, with a reason, where there is none."""
    plain = blanked(sql)
    level = depths(plain)
    for m in re.finditer(rf"\b({'|'.join(CLAUSE[kind])})\b", plain, re.I):
        here = level[m.start()]
        if m[1].lower() in ("over", "filter"):
            begin = plain.find("(", m.end())
            stop = next((i for i in range(begin + 1, len(plain)) if plain[i] == ")" and level[i] <= here), len(plain))
        else:
            after = [n.start() for n in _ENDS.finditer(plain, m.end()) if level[n.start()] <= here]
            close = next((i for i in range(m.end(), len(plain)) if level[i] < here), len(plain))
            stop = min([*after, close, len(plain)])
        written = kind == "GROUP_BY" and re.search(r"\bby\s+(all|\d)", plain[m.start() : stop], re.I)  # by position, or all
        if written or holds(sql[m.start() : stop], key):
            return Place(sql.count("\n", 0, m.start()) + 1, sql.count("\n", 0, len(sql[:stop].rstrip())) + 1, "line")
    return Place(1, sql.count("\n") + 1, "model", f"no {kind} clause holds {key}")


def cite(sql: str, output: str, source_column: str, kind: str | None = None) -> Place:
    """The place of a direct edge (``kind`` None) or of an indirect edge of a type, checked line by line."""
    if kind:
        return clause_lines(sql, kind, source_column)
    first, last, level = locate(sql, output)
    text = "\n".join(sql.splitlines()[first - 1 : last])
    if level == "line" and not (holds(text, source_column) or holds(text, output)):
        return Place(1, sql.count("\n") + 1, "model", f"{output} is not on its lines")
    return Place(first, last, level)


def cited_edges(spark: SparkSession, found: list[ModelLineage], models: dict[str, str]) -> DataFrame:
    """(from, to, kind, first_line, last_line, level, reason) of every edge, direct and indirect."""
    rows = []
    for m in found:
        sql = models[m.model].strip("\n")
        for ((rel, col), out), kind in sorted(m.direct.items()):
            rows.append((f"{rel}.{col}", f"{m.model}.{out}", kind, *cite(sql, out, col)))
        for (rel, col), out, t in sorted(m.indirect):
            rows.append((f"{rel}.{col}", f"{m.model}.{out}", t, *cite(sql, out, col, t)))
    return spark.createDataFrame(rows, "`from` string, `to` string, kind string, first_line int, last_line int, level string, reason string")


def citation_coverage(cited: DataFrame) -> DataFrame:
    """(level, reason, n, share) of the edges."""
    n = cited.groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = cited.agg(F.count(F.lit(1)).alias("total"))  # one row
    return n.crossJoin(total).select("level", "reason", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def excerpt(sql: str, lines: list[tuple[int, int]], around: int = 3) -> list[tuple[int, int, str]]:
    """Numbered parts of a text around some lines; parts that touch are one."""
    rows, parts = sql.splitlines(), []
    for a, b in sorted((max(1, a - around), min(len(rows), b + around)) for a, b in lines):
        if parts and a <= parts[-1][1] + 1:
            parts[-1] = (parts[-1][0], max(parts[-1][1], b))
        else:
            parts.append((a, b))
    return [(a, b, "\n".join(f"{n:>4} {rows[n - 1]}" for n in range(a, b + 1))) for a, b in parts]


def merged_intervals(df: DataFrame, by: str) -> DataFrame:
    """(by, first, last): intervals that touch or overlap as one, per key, as a window over a table of them."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("first", "last")
    reached = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("opens", F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1)))
    island = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("island", island).groupBy(by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")
