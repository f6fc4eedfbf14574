"""Column builders for text rules. Each takes and gives Columns; null stays null unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

LINE_SEPARATORS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACES = "[\\s\x0b\x1c-\x1f\x85   -     　]+"


def staged(df, *steps: dict):
    """Adds columns step by step, so that a later step refers to a column and not to its expression again."""
    for step in steps:
        df = df.withColumns(step)
    return df


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text holds one of the words as a substring. Words that hold another of them add nothing."""
    least = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(Column.__or__, [text.contains(w) for w in least])


def matches(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize(text: Column) -> Column:
    """Typographic characters and broken encodings replaced, white space collapsed."""
    for old, new in (V.REPLACED | V.REPLACED_MORE).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return collapse(text)


def clean(text: Column) -> Column:
    """A normalised value without leading punctuation, an orphan plural s, and spaces before punctuation."""
    text = F.regexp_replace(collapse(text), r"^[\s\-:;,.()]+", "")
    text = F.regexp_replace(text, r"^[sS]\s+(?=[A-Z])", "")
    return F.trim(F.regexp_replace(text, r"\s+([,.;:])", "$1"))


def first_match(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.when(text.rlike("(?i)" + pattern), F.regexp_extract(text, "(?i)" + pattern, 0))


def filled(text: Column) -> Column:
    """Null if empty."""
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    bare = collapse(text)
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def has_date(text: Column) -> Column:
    return text.rlike("[0-9]") & matches(text, V.DATES, True)


def extract_date(text: Column) -> Column:
    """By order of the patterns, not of the places."""
    return F.coalesce(*[collapse(first_match(text, p)) for p in V.DATES])


def has_currency(text: Column) -> Column:
    return text.rlike("[0-9]") & text.rlike("(?i)" + V.CURRENCY)


def amounts(text: Column) -> Column:
    """array<bigint> of the currency amounts in text, cents cut off."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + V.CURRENCY), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.regexp_extract(x, V.AMOUNT, 0), F.lit(","), F.lit("")).cast("double").cast("bigint"))


def has_token(text: Column, tokens: list[str]) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(tokens) + r")\b")


def strip_label(text: Column, labels: list[str]) -> Column:
    """The part after a label, with a colon or at the start; the whole text if nothing would be left."""
    prefix = F.substring_index(text, ":", 1)
    suffix = F.substring(text, F.length(prefix) + 2, F.length(text))
    colon = text.contains(":") & (F.length(prefix) <= 80) & ~F.lower(prefix).contains("http") & any_of(F.lower(prefix), labels)
    # the labels in their order; one that would leave nothing gives way to the next
    start = r"(?is)^(?:" + "|".join(labels) + r")[ \-:]*+(?:(?:on|is)\s+)?(\S.*)$"
    return F.coalesce(F.when(colon, filled(collapse(suffix))), filled(collapse(F.regexp_extract(text, start, 1))), collapse(text))


def sentence(text: Column, fits) -> Column:
    """The first sentence of a cleaned text that fits, else the whole text if it does, else null. fits: Column -> Column."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+", -1), clean)
    found = F.filter(parts, lambda s: (s != "") & fits(F.lower(s)))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when((text != "") & fits(F.lower(text)), text))


def plain_words(text: Column) -> Column:
    """Lower case with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def needles(pattern: str) -> list[str]:
    """For each alternative of a pattern the longest run of letters that no match can lack; none where a pattern holds more than letters,
    word bounds, spaces, optional letters and groups."""
    bare = re.sub(r"\(\?:[^()]*\)\??|\\b|\\s\+|[a-z]\?", "_", pattern)
    if not re.fullmatch(r"[a-z _|]+", bare):
        return []
    runs = [max(part.split("_"), key=len) for part in bare.split("|")]
    return runs if all(runs) else []


def says(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found in text of plain_words. Its letters are looked for first, as that is far cheaper than the pattern."""
    words = [needles(p) for p in patterns]
    found = matches(text, patterns)
    return any_of(text, [w for ws in words for w in ws]) & found if all(words) else found


def weighted(text: Column, patterns: list[tuple[str, int]], times: int = 1) -> Column:
    """Sum of the weights of the patterns found in text of plain_words, each counted once."""
    total = F.lit(0)
    for pattern, weight in patterns:
        total = total + F.when(says(text, [pattern]), weight * times).otherwise(0)
    return total


# ---- URLs ----
def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def host(url: Column) -> Column:
    """Lower-cased host without user, port and a leading www."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def scope_key(url: Column) -> Column:
    """The site a URL belongs to: its last two labels, or three under a country's second level."""
    name = host(url)
    long = name.rlike(r"\.(?:" + "|".join(V.SECOND_LEVEL) + r")\.[^.]{2}$")
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def is_http(url: Column) -> Column:
    return url.rlike("^(?i:https?):")


def text_urls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"https?://[^\s)>\]}]+"), F.lit(0))


def resolve(base: Column, href: Column) -> Column:
    """Resolves href against base by RFC 3986."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.when(no_query == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(no_query, r"(?s)^(.*/)", 1))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(folder, href))
    )
    # dot segments of the path
    head = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(joined, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(joined, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    open_end = path.rlike(r"/\.{1,2}$")
    fixed = F.concat(head, F.lit("/"), F.array_join(kept, "/"), F.when(open_end & (F.size(kept) > 0), "/").otherwise(""), tail)
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), fixed).otherwise(joined)
