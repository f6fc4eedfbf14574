"""Pages to lines, headers and snippets. Pages: source_url, page_title, body_text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def is_header(line: Column) -> Column:
    lowered = F.lower(line)  # a line with a colon at its end is a header whatever else it says
    short = T.any_of(lowered, V.HEADER_WORDS) & ~line.contains(":") & ~line.rlike("[.!?]") & (T.words(line) <= 6) & ~T.has_date(line) & ~T.has_currency(line)
    return line.endswith(":") | lowered.isin(V.HEADER_LABELS) | short


def page_text() -> Column:
    """All that the lines of a page are made of."""
    return F.concat(F.coalesce("page_title", F.lit("")), F.lit("\n"), F.coalesce("body_text", F.lit("")))


def with_lines(pages: DataFrame, key: str = "source_url", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, lines): the normalised lines of a page that are not empty, in an array; the title is the first.

    Pages, not lines, are dealt out, so that a few large files do not leave machines idle; lines stay with their page, so nothing is sorted.
    """
    return _split(pages.select(key, *keep, page_text().alias("__text")).repartition(key), key, keep)


def _split(dealt: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    lines = F.filter(F.transform(F.split("__text", T.LINE_SEPARATORS, -1), T.normalize), lambda line: line != "")
    return dealt.select(key, *keep, lines.alias("lines"))


def text_rows(texts: DataFrame, key: str) -> DataFrame:
    """texts (key, __text) -> (key, rows): for each line of a text a struct of idx, line, is_header, snippet (a header with up to three lines under it), lowline
    and low (line and snippet in lower case) and the lines around: before2, before1, after1. Texts stay where they are dealt out."""
    flagged = _split(texts, key, ()).withColumn("headers", F.transform("lines", is_header))
    line, header = lambda i: F.get("lines", i), lambda i: F.get("headers", i)

    def row(own: Column, i: Column) -> Column:
        second = F.when(~header(i + 2), line(i + 2))
        third = F.when(~header(i + 2) & ~header(i + 3), line(i + 3))
        joined = T.collapse(F.concat_ws(" ", own, line(i + 1), second, third))
        under = header(i) & line(i + 1).isNotNull() & ~header(i + 1)
        return F.struct(
            i.alias("idx"), own.alias("line"), header(i).alias("is_header"), F.when(under, joined).otherwise(own).alias("snippet"),
            line(i - 2).alias("before2"), line(i - 1).alias("before1"), line(i + 1).alias("after1"),
        )

    shown = flagged.select(key, F.transform("lines", row).alias("rows"))
    lowered = F.transform("rows", lambda r: r.withField("lowline", F.lower(r["line"])).withField("low", F.lower(r["snippet"])))
    return shown.select(key, lowered.alias("rows"))


def page_lines(pages: DataFrame, key: str = "source_url") -> DataFrame:
    """(key, idx, line): normalised lines that are not empty; the title is the first. A page without lines has none."""
    # outer, as explode would make the array a second time, to ask whether it is empty
    return with_lines(pages, key).select(key, F.posexplode_outer("lines").alias("idx", "line")).where("line is not null")


def snippets(pages: DataFrame, key: str = "source_url") -> DataFrame:
    """page_lines with is_header, snippet (a header with up to three lines under it) and the lines around:
    before2, before1, after1. A page's lines stand beside themselves, moved by some places, so that nothing is sorted and a task holds one page at a time."""
    flagged = with_lines(pages, key).withColumn("headers", F.transform("lines", is_header))
    below = lambda c, i: F.slice(c, F.lit(i + 1), F.greatest(F.size(c) - i, F.lit(0)))
    above = lambda i: F.concat(F.array_repeat(F.lit(None).cast("string"), i), "lines")
    moved = {"line": F.col("lines"), "is_header": F.col("headers"), "before1": above(1), "before2": above(2)}
    moved |= {f"{name}{i}": below(c, i) for name, c in (("line", "lines"), ("is_header", "headers")) for i in (1, 2, 3)}
    zipped = flagged.select(key, F.arrays_zip(*[c.alias(n) for n, c in moved.items()]).alias("rows"))
    lines = zipped.select(key, F.posexplode_outer("rows").alias("idx", "r")).select(key, "idx", "r.*").where("line is not null")
    second = F.when(~F.col("is_header2"), F.col("line2"))
    third = F.when(~F.col("is_header2") & ~F.col("is_header3"), F.col("line3"))
    joined = T.collapse(F.concat_ws(" ", "line", "line1", second, third))
    under = F.col("is_header") & F.col("line1").isNotNull() & ~F.col("is_header1")
    return lines.select(key, "idx", "line", "is_header", F.when(under, joined).otherwise(F.col("line")).alias("snippet"), "before1", "before2", F.col("line1").alias("after1"))
