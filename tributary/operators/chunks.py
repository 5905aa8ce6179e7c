"""Search chunks of SQL models and documents: named segments, bounded sizes, packing under a cap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.dialect import blanked, cte_names, depths

LIMIT = 300  # estimated tokens of a chunk
LINES = 40


def fits(text: str, limit: int = LIMIT) -> bool:
    return -(-len(text) // 3) <= limit


def segments(sql: str) -> list[tuple[int, int, str]]:
    """(first line, last line, label) of each CTE of the outer WITH and of the final select; what stands before belongs to the first.

    A text without CTEs gives windows of forty lines.
    """
    rows = sql.count("\n") + 1
    plain, names = blanked(sql), cte_names(sql)
    if not names:
        return [(a, min(rows, a + LINES - 1), f"lines {a}") for a in range(1, rows + 1, LINES)]
    level = depths(plain)
    begins = []
    for n in names:
        m = next(m for m in re.finditer(rf"\b{re.escape(n)}\s+as\s*(?:materialized\s*)?\(", plain, re.I) if level[m.start()] == 0)
        begins.append(sql.count("\n", 0, m.start()) + 1)
    last = [m for m in re.finditer(r"\bselect\b", plain, re.I) if level[m.start()] == 0]
    final = sql.count("\n", 0, last[0].start()) + 1 if last else rows + 1
    edges = [1, *begins[1:], final]
    out = [(a, b - 1, f"cte {n}") for a, b, n in zip(edges, edges[1:], names, strict=False) if b > a]
    return [*out, (final, rows, "final select")] if last else out


def bounded(text: str, first: int = 1, limit: int = LIMIT) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): consecutive lines in parts that each fit, in order and without loss; a line that doesn't fit alone is cut between words."""
    held: list[str] = []
    begin = first
    for n, line in enumerate(text.split("\n"), first):
        if held and not fits("\n".join([*held, line]), limit):
            yield begin, n - 1, "\n".join(held)
            held = []
        if not held:
            begin = n
        if fits(line, limit):
            held.append(line)
            continue
        part = ""
        for word in re.findall(r"\s*\S+|\s+\Z", line):
            if part and not fits(part + word, limit):
                yield n, n, part
                part = ""
            while not fits(part + word, limit):  # one word beyond the limit
                cut = 3 * limit - len(part)
                yield n, n, part + word[:cut]
                part, word = "", word[cut:]
            part += word
        if part:
            yield n, n, part
    if held:
        yield begin, first + text.count("\n"), "\n".join(held)


def bounded_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, part, first_line, last_line, chunk) of (id, text): every text whole, in parts of bounded size."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, *part) for i, t in zip(f["id"], f["text"], strict=True) for k, part in enumerate(bounded(t or "", 1, limit))]
            yield pd.DataFrame(rows, columns=["id", "part", "first_line", "last_line", "chunk"])

    return docs.select("id", "text").mapInPandas(run, f"id {kind}, part int, first_line int, last_line int, chunk string")


def prefix_under_cap(df: DataFrame, size: Column, cap: int, order: list[Column], by: list[str]) -> DataFrame:
    """Of each group the longest prefix in an order whose sizes add up to the cap at most."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).filter(F.col("__sum") <= cap).drop("__sum")


def skip_and_pack(df: DataFrame, size: str, cap: int, order: list[str], by: str) -> DataFrame:
    """Of each group the rows that fit one after the other, in an order; one that doesn't fit is skipped. Groups are ranked lists of a query, bounded by their depth."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        keep, used = [], 0
        g = g.sort_values(order, kind="stable")
        for n in g[size]:
            keep.append(used + n <= cap)
            used += n if keep[-1] else 0
        return g[pd.Series(keep, index=g.index, dtype=bool)]

    return df.groupBy(by).applyInPandas(run, df.schema)
