"""Field extraction: candidates by line, the best of a page by one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .lines import is_header, page_text, text_rows

FIELDS = ["program_name", "department", "duration", "deadline", "tuition", "english_requirement", "academic_requirement"]


def _candidate(score: Column, text: Column, ok: Column | None = None) -> Column:
    """Smaller is better: higher score, then longer, then first in the alphabet."""
    made = F.struct((-score).alias("s"), (-F.length(text)).alias("l"), text.alias("text"))
    keep = text.isNotNull() if ok is None else ok & text.isNotNull()
    return F.when(keep, made)


def _plus(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


# ---- predicates on lower-cased lines ----
def is_deadline_noise(t: Column) -> Column:
    return T.any_of(t, V.DEADLINE_REJECTED) | (T.any_of(t, V.DEADLINE_EVENTS) & T.has_date(t))


def is_tuition_line(t: Column) -> Column:
    return ~T.any_of(t, V.TUITION_REJECTED) & (T.any_of(t, V.TUITION_LABELS) | (T.has_currency(t) & T.any_of(t, V.TUITION_CONTEXT)))


def is_english_line(t: Column) -> Column:
    context = T.any_of(t, ["english", "language", "proficiency"]) & T.any_of(t, ["requirement", "medium of instruction", "taught in english", "exempt"])
    medium = ~t.contains("medium of instruction") | T.any_of(t, ["requirement", "exempt", "waiv", "proof", "satisfy", "accepted"])
    return ~T.any_of(t, V.OPENING) & (T.any_of(t, V.ENGLISH_LABELS) | T.has_token(t, V.ENGLISH_TESTS) | (context & medium))


def has_academic_content(t: Column) -> Column:
    return T.any_of(t, V.ACADEMIC_CONTENT)


def looks_english(t: Column) -> Column:
    instruction = T.any_of(t, V.INSTRUCTION) & T.any_of(t, ["english", "language", "requirement", "satisfy", "exempt", "waiv"])
    return T.has_token(t, V.ENGLISH_TESTS) | T.any_of(t, V.ENGLISH_SIGNALS) | instruction


def is_academic_line(t: Column) -> Column:
    academic = has_academic_content(t)
    return ~(looks_english(t) & ~academic) & (T.any_of(t, V.ACADEMIC_LABELS) | (academic & T.any_of(t, V.ACADEMIC_CONTEXT)))


def is_question_only(t: Column) -> Column:
    answered = t.rlike(r"\b(?:ielts|toefl|pte|duolingo)\b\s*\d") | T.any_of(t, ["expected to satisfy", "must satisfy", "required to satisfy", "shall satisfy", "exempt", "waiv"])
    prompt = t.rlike("^(?:" + "|".join(V.QUESTIONS) + ")") | t.endswith("?")
    return t.contains("?") & ~answered & prompt


# ---- values ----
def clean_program_name(value: Column) -> Column:
    head = F.get(F.split(T.collapse(value), r"(?i)\b(?:admissions?|overview|programme|program)\b", 2), F.lit(0))
    return F.regexp_replace(head, r"[ \-|:]+$", "")


def without_duration_label(text: Column) -> Column:
    return F.regexp_replace(T.clean(text), r"(?i)^(?:normative\s+study\s+)?duration[:\-\s]*", "")


def duration_value(bare: Column) -> Column:
    """bare: a column of without_duration_label."""
    found = T.first_match(bare, V.UNITS + r"(?:\s*\([^)]{1,40}\))?")
    return F.when(bare.contains("/") & T.any_of(F.lower(bare), ["full", "part"]), bare).otherwise(F.coalesce(T.clean(found), bare))


def tuition_value(text: Column) -> Column:
    pair = r"(local students?:[^.]{0,220}?hk\$\s*\d[\d,]*(?:\.\d{2})?[^.]{0,220}?non[- ]local students?:[^.]{0,220}?hk\$\s*\d[\d,]*(?:\.\d{2})?)"
    first = T.clean(T.first_match(text, V.CURRENCY))
    modes = T.any_of(F.lower(text), ["full time", "part-time", "part time", "full-time"])
    return F.when(text.rlike("(?i)" + pair), T.clean(T.first_match(text, pair))).when(T.has_currency(text), F.when(modes, first).otherwise(text))


def tuition_score(text: Column, context: Column, most: Column) -> Column:
    low, both = F.lower(text), F.concat_ws(" ", F.lower(text), F.lower(context))
    none = T.any_of(low, V.TUITION_REJECTED) | is_header(text) | low.contains("announced every year") | most.isNull() | (most < 50_000) | ~T.any_of(both, V.TUITION_SCORED)
    points = (
        F.lit(10) + _plus(low.contains("tuition fee"), 5) + _plus(T.any_of(low, ["programme fee", "program fee"]), 5)
        + _plus(T.any_of(low, ["local students", "non-local students", "non local students"]), 5)
        + _plus(T.any_of(low, ["students admitted", "payable", "instalment", "installment"]), 2)
        + _plus(most >= 100_000, 8) + _plus(most >= 300_000, 6) + F.length(text)
    )
    return F.when(F.coalesce(none, F.lit(True)), 0).otherwise(points)


def trim_mixed_tail(text: Column) -> Column:
    options = []
    for pattern in V.MIXED_TAILS:
        head = T.clean(F.get(F.split(text, "(?i)" + pattern, 2), F.lit(0)))
        options.append(F.when(text.rlike("(?i)" + pattern) & (head != "") & is_english_line(F.lower(head)), head))
    return F.when(T.any_of(F.lower(text), ["english", "language", "ielts", "toefl"]), F.coalesce(*options, text)).otherwise(text)


def english_score(text: Column) -> Column:
    low = F.lower(text)
    medium = low.contains("medium of instruction") & ~T.any_of(low, ["exempt", "waiv", "proof", "satisfy", "accepted", "requirement"])
    points = _plus(T.has_token(low, V.ENGLISH_TESTS), 10) + _plus(T.any_of(low, V.ENGLISH_SIGNALS), 8) + _plus(T.any_of(low, V.INSTRUCTION), 2)
    none = is_question_only(low) | is_header(text) | ~is_english_line(low) | medium | ((T.words(text) < 5) & (points < 10))
    return F.when(F.coalesce(none, F.lit(True)), 0).otherwise(points + F.length(text))


def trim_lead_in(text: Column) -> Column:
    return F.coalesce(F.trim(T.first_match(text, r"\b(?:Applicants?|Candidates?)\b(?s:.*)")), text)


def academic_score(text: Column) -> Column:
    low = F.lower(text)
    points = (
        _plus(T.any_of(low, ["bachelor", "degree"]), 8) + _plus(T.any_of(low, V.ACADEMIC_COURSES), 10) + _plus(low.contains("equivalent qualification"), 4)
        + _plus(T.any_of(low, V.ACADEMIC_PEOPLE), 4) + F.length(text)
    )
    none = looks_english(low) | ~has_academic_content(low)
    return F.when(F.coalesce(none, F.lit(True)), 0).otherwise(points)


# ---- the best candidate of a page ----
# rows: the array of text_rows. Each step is one array, so that a later step refers to a value and not to its expression again.
def _step(rows: Column, **more) -> Column:
    """The fields of each row that are named (a string) or made (a function of the row)."""
    return F.transform(rows, lambda r: F.struct(*[(r[f] if isinstance(f, str) else f(r)).alias(name) for name, f in more.items()]))


def _cut(labels: list[str]):
    return lambda r: T.clean(T.strip_label(r["snippet"], labels))


def _best(candidates: Column) -> Column:
    return F.array_min(candidates).getField("text")


def best_program_name(rows: Column) -> Column:
    """The first name in the first ten lines."""
    holds = [["master", "doctor", "bachelor"], ["ms", "ma", "mphil", "phd", "mba", "llm"]]  # no match without one of them
    names = lambda r: F.coalesce(*[F.when(T.any_of(r["lowline"], words), clean_program_name(T.first_match(r["line"], p))) for words, p in zip(holds, V.PROGRAM_NAMES)])
    return F.get(F.filter(F.transform(F.slice(rows, 1, 10), names), lambda v: v.isNotNull()), F.lit(0))


def department_value(found: Column) -> Column:
    head = F.get(F.split(found, r"(?i)\b(?:is|are|was|were)\b", 2), F.lit(0))
    return F.regexp_replace(F.regexp_replace(head, r"^[ \-|:;,.]+", ""), r"[ \-|:;,.]+$", "")


def best_department(rows: Column) -> Column:
    """The first of three to fourteen words in the first 120 lines."""
    kept = F.filter(F.slice(rows, 1, 120), lambda r: T.any_of(r["lowline"], ["department", "school", "faculty", "college", "institute"]))
    found = _step(kept, **{f"v{i}": lambda r, p=p: department_value(T.clean(T.first_match(r["line"], p))) for i, p in enumerate(V.DEPARTMENTS)})
    fits = lambda v: F.when((T.words(v) >= 3) & (T.words(v) <= 14), v)
    values = F.transform(found, lambda r: F.coalesce(*[fits(r[f"v{i}"]) for i in range(len(V.DEPARTMENTS))]))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def best_duration(rows: Column) -> Column:
    windows = _step(rows, low="low", snippet="snippet", window=lambda r: T.collapse(F.concat_ws(" ", r["before1"], r["line"], r["after1"])))
    wide = _step(windows, low="low", snippet="snippet", window="window", wide=lambda r: F.concat_ws("\n", r["low"], F.lower(r["window"])))
    modes = lambda t: T.any_of(t, ["full-time", "part-time", "full time", "part time"])
    marked = _step(wide, low="low", snippet="snippet", window="window", d_label=lambda r: T.any_of(r["wide"], V.DURATION_LABELS), d_mode=lambda r: modes(r["wide"]), wide="wide")
    kept = F.filter(marked, lambda r: (r["d_label"] | (r["d_mode"] & r["wide"].rlike(V.UNITS))) & ~(T.any_of(r["low"], V.DURATION_NOISE) & ~r["d_label"]))
    own = {"low": "low", "d_label": "d_label", "d_mode": "d_mode"}
    matched = {f"d{i}": lambda r, p=p: without_duration_label(T.clean(T.first_match(r["snippet"], p))) for i, p in enumerate(V.DURATIONS, 2)}
    bare = _step(kept, **own, d0=lambda r: without_duration_label(_cut(V.DURATION_LABELS)(r)), d1=lambda r: without_duration_label(r["window"]), **matched)
    n = 2 + len(V.DURATIONS)
    values = _step(bare, **own, **{f"e{i}": lambda r, i=i: duration_value(r[f"d{i}"]) for i in range(n)})
    units = lambda v: v.rlike("(?i)" + V.UNITS)

    def candidates(r: Column) -> Column:
        e = [r[f"e{i}"] for i in range(n)]
        both = F.lower(e[0]).contains("full-time") & F.lower(e[0]).contains("part-time")
        first = F.lit(18) + F.length(e[0]) + _plus(e[0].contains("/"), 4) + _plus(both, 4)
        second = F.lit(14) + F.length(e[1]) + _plus(r["d_label"], 4) + _plus(r["d_mode"], 3)
        others = [F.lit(5) + F.length(v) + _plus(v.rlike(r"^\d"), 3) + _plus(r["low"].contains("duration"), 8) + _plus(T.any_of(r["low"], ["full-time", "part-time"]), 4) for v in e[2:]]
        return F.array_min(F.array(_candidate(first, e[0], units(e[0])), _candidate(second, e[1], units(e[1])), *[_candidate(s, v) for s, v in zip(others, e[2:])]))

    return _best(F.transform(values, candidates))


def best_deadline(rows: Column) -> Column:
    def gate(r: Column) -> Column:
        line, low = r["lowline"], r["low"]
        above = F.lower(F.concat_ws(" ", r["before2"], r["before1"], r["line"]))
        said = T.any_of(line, V.DEADLINE_LABELS) | (line.contains("round") & T.has_date(line)) | (T.any_of(above, V.DEADLINE_CONTEXT) & T.has_date(low))
        return said & ~T.any_of(low, V.OPENING) & ~is_deadline_noise(low)

    dated = _step(F.filter(rows, gate), low="low", snippet="snippet", date=lambda r: T.extract_date(r["snippet"]))
    texts = _step(dated, low="low", date="date", text=lambda r: F.when(r["date"].isNull(), _cut(V.DEADLINE_LABELS)(r)))
    values = _step(texts, low="low", date="date", text="text", v=lambda r: F.lower(r["text"]))

    def candidate(r: Column) -> Column:
        v, label = r["v"], T.any_of(r["low"], V.DEADLINE_LABELS)
        fits = (v != "") & ~T.any_of(v, V.OPENING) & ~is_deadline_noise(v) & ~v.contains("?") & ~v.rlike("^(?:how do i apply|when are the application deadlines)") & ~v.contains("http")
        return F.coalesce(_candidate(F.lit(10) + _plus(label, 4) + _plus(r["low"].contains("round"), 2), r["date"]), _candidate(F.lit(4) + _plus(label, 2), r["text"], fits))

    return _best(F.transform(values, candidate))


def _scored(values: Column, score) -> Column:
    """values: array of structs with text. score: function of the row."""
    scores = _step(values, text="text", score=score)
    return _best(F.transform(scores, lambda r: _candidate(r["score"], r["text"], r["score"] > 0)))


def best_tuition(rows: Column) -> Column:
    cut = _step(F.filter(rows, lambda r: is_tuition_line(r["low"])), snippet="snippet", text=_cut(V.TUITION_LABELS))
    values = _step(cut, snippet="snippet", text=lambda r: tuition_value(r["text"]))
    most = _step(values, snippet="snippet", text="text", most=lambda r: F.array_max(T.amounts(r["text"])))
    return _scored(most, lambda r: tuition_score(r["text"], r["snippet"], r["most"]))


def best_english_requirement(rows: Column) -> Column:
    cut = _step(F.filter(rows, lambda r: is_english_line(r["low"])), text=_cut(V.ENGLISH_LABELS))
    said = _step(cut, text=lambda r: T.sentence(r["text"], is_english_line))
    return _scored(_step(said, text=lambda r: trim_mixed_tail(r["text"])), lambda r: english_score(r["text"]))


def best_academic_requirement(rows: Column) -> Column:
    cut = _step(F.filter(rows, lambda r: is_academic_line(r["low"])), text=_cut(V.ACADEMIC_LABELS))
    said = _step(_step(cut, text=lambda r: trim_lead_in(r["text"])), text=lambda r: T.sentence(r["text"], is_academic_line))
    return _scored(said, lambda r: academic_score(r["text"]))


BEST = {
    "program_name": best_program_name, "department": best_department, "duration": best_duration, "deadline": best_deadline,
    "tuition": best_tuition, "english_requirement": best_english_requirement, "academic_requirement": best_academic_requirement,
}
# Parts of words without which no foundation is mentioned.
FOUNDATION_PARTS = {"statistics": ["statistic", "probabilit"], "programming": ["programming", "python", "coding"], "mathematics": ["math", "calculus", "algebra"]}


def extract_pages(pages: DataFrame, key: str = "source_url", keep: Sequence[str] = (), more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each page: the extracted fields, prerequisite_keywords (in list order), foundation flags, and the columns of keep.

    Pages without lines have nulls, an empty list and false flags. The page key must be unique; a null key is a page too.
    What a page says is the same for all pages with its title and text, so each different text is read once, all of it on its own row, and
    pages meet their text by its SHA-256. Pages stream past the texts; they are not sorted. more: adds columns to the extracted texts.
    """
    told = F.unhex(F.sha2("__text", 256)).alias("__id")
    shown = pages.select(key, "page_title", *keep, page_text().alias("__text")).select(key, "page_title", *keep, told)
    texts = pages.select(page_text().alias("__text")).distinct().select(told, "__text")
    # by number, as texts that are few bytes would be put together in a few tasks
    dealt = texts.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__id")
    out = extract_texts(dealt, "__id")
    return shown.join((more(out) if more else out).hint("shuffle_hash"), "__id").drop("__id")


def extract_texts(texts: DataFrame, key: str) -> DataFrame:
    """texts (key, __text) -> key and the extracted fields."""
    rows = F.col("rows")
    first = lambda k: F.get(F.filter(rows, lambda r: r["lowline"].contains(k)), F.lit(0))["snippet"]
    context = F.concat_ws(" ", *[first(k) for k in V.PREREQUISITE_CONTEXT])
    mentions = lambda k: F.exists(rows, lambda r: T.any_of(r["lowline"], FOUNDATION_PARTS[k]) & r["line"].rlike("(?i)" + V.FOUNDATIONS[k]))
    mentioned = {f"f_{k}": mentions(k) for k in V.FOUNDATIONS}
    out = text_rows(texts, key).select(key, *[best(rows).alias(f) for f, best in BEST.items()], context.alias("context"), *[c.alias(n) for n, c in mentioned.items()])
    out = out.withColumn("context", F.concat_ws(" ", T.filled(F.col("context")), "academic_requirement"))
    found = F.array_compact(F.array(*[F.when(F.col("context").rlike("(?i)" + p), k) for k, p in V.PREREQUISITES]))
    out = out.withColumn("prerequisite_keywords", found)
    flags = {f"foundation_{k}": F.col(f"f_{k}") | F.array_join("prerequisite_keywords", " ").rlike("(?i)" + p) for k, p in V.FOUNDATIONS.items()}
    return out.withColumns(flags).select(key, *FIELDS, "prerequisite_keywords", *flags)
