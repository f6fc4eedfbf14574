"""Exports, comparison over the latest exports, and answers to simple questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

EXPORT_COLUMNS = ["university", "program_code", "program_name", "department", "duration", "tuition", "deadline", "language_requirement", "background_requirement", "mentions_statistics_foundation", "mentions_programming_foundation", "mentions_math_foundation", "prerequisite_keywords", "source_url", "page_title"]
DATE_FORMATS = ["yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "MMMM d yyyy", "MMM d yyyy"]
HELP = "Supported questions currently include: statistics foundation, programming/CS foundation, mathematics foundation, and earliest deadline."


def export_rows(targets: DataFrame, records: DataFrame) -> DataFrame:
    """15 string columns for each record; the name falls back to the target's, null becomes empty."""
    t = targets.select("program_code", "university", F.col("program_name").alias("target_name"))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.initcap(F.coalesce(F.col(c), F.lit(False)).cast("string"))
    return records.join(t, "program_code").select(
        plain("university").alias("university"), "program_code", F.coalesce(T.filled(F.col("program_name")), "target_name", F.lit("")).alias("program_name"),
        plain("department").alias("department"), plain("duration").alias("duration"), plain("tuition").alias("tuition"), plain("deadline").alias("deadline"),
        plain("english_requirement").alias("language_requirement"), plain("academic_requirement").alias("background_requirement"),
        flag("foundation_statistics").alias("mentions_statistics_foundation"), flag("foundation_programming").alias("mentions_programming_foundation"), flag("foundation_mathematics").alias("mentions_math_foundation"),
        F.array_join("prerequisite_keywords", "; ").alias("prerequisite_keywords"), plain("source_url").alias("source_url"), plain("page_title").alias("page_title"),
    )


def markdown_row(columns: list[str]) -> Column:
    """A record as a three-line pipe table."""
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |\n| "
    values = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")) for c in columns]
    return F.concat(F.lit(head), F.concat_ws(" | ", *values), F.lit(" |\n"))


def latest_exports(exports: DataFrame) -> DataFrame:
    """exports with a column stem -> comparison rows: the largest stem of each program_code; blank codes go."""
    code = F.coalesce("program_code", F.lit(""))
    rows = exports.where(F.trim(code) != "").withColumn("rn", F.row_number().over(W.partitionBy("program_code").orderBy(F.desc("stem")))).where("rn = 1")
    truth = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin("true", "1", "yes")
    text = ["university", "program_code", "program_name", "deadline", "tuition", "language_requirement", "background_requirement"]
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text], *[truth(f"mentions_{k}_foundation").alias(f"mentions_{k}_foundation") for k in ("statistics", "programming", "math")])


def parse_deadline(text: Column) -> Column:
    """Date in one of five forms, or null."""
    bare = T.collapse(F.replace(text, F.lit(","), F.lit(" ")))
    return F.coalesce(*[F.try_to_date(bare, f) for f in DATE_FORMATS])


def derived_signals(rows: DataFrame) -> DataFrame:
    """One row: earliest deadline as 'date (code)', and program lists in code order (null where there is none)."""
    at = parse_deadline(F.col("deadline"))
    codes = lambda c: T.filled(F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("program_code")))), ", "))
    stats, programming, math = (F.col(f"mentions_{k}_foundation") for k in ("statistics", "programming", "math"))
    first = F.min(F.when(at.isNotNull(), F.struct(at.alias("d"), "program_code")))
    return rows.agg(first.alias("first"), codes(stats).alias("statistics"), codes(programming).alias("programming"), codes(programming & ~math).alias("cs_leaning"), codes(math).alias("mathematics")).select(
        F.concat(F.col("first.d").cast("string"), F.lit(" ("), F.col("first.program_code"), F.lit(")")).alias("earliest_deadline"), "statistics", "programming", "cs_leaning", "mathematics"
    )


# The lines of the report.
COMPARED = ["program_code", "program_name", "deadline", "tuition", "stats_foundation", "programming_foundation", "math_foundation"]
SIGNALS = [("statistics", "- Programs mentioning statistics foundation: "), ("cs_leaning", "- Programs leaning CS/programming (heuristic): "), ("mathematics", "- Programs mentioning mathematics foundation: ")]


def signal_programs(rows: DataFrame) -> DataFrame:
    """(signal, program_code), a row for each programme that a signal names."""
    stats, programming, math = (F.col(f"mentions_{k}_foundation") for k in ("statistics", "programming", "math"))
    named = {"statistics": stats, "programming": programming, "cs_leaning": programming & ~math, "mathematics": math}
    return rows.select("program_code", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))).alias("signal")).select("signal", "program_code")


def comparison_lines(rows: DataFrame) -> DataFrame:
    """(section, code, line): the report as ordered lines, a header of two, one for each programme, and the derived ones."""
    flag = lambda k: F.initcap(F.col(f"mentions_{k}_foundation").cast("string"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "program_code", "program_name", "deadline", "tuition", flag("statistics"), flag("programming"), flag("math")), F.lit(" |"))
    body = rows.select(F.lit(2).alias("section"), F.col("program_code").alias("code"), cells.alias("line"))
    fixed = {0: "| " + " | ".join(COMPARED) + " |", 1: "| " + " | ".join(["---"] * len(COMPARED)) + " |", 3: "", 4: "## Derived Signals"}
    one = rows.sparkSession.range(1)
    head = one.select(F.explode(F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])).alias("section", "line")).select("section", F.lit("").alias("code"), "line")
    at = parse_deadline(F.col("deadline"))
    first = rows.agg(F.min(F.when(at.isNotNull(), F.struct(at.alias("d"), "program_code"))).alias("x"))
    said = F.coalesce(F.concat(F.col("x.d").cast("string"), F.lit(" ("), F.col("x.program_code"), F.lit(")")), F.lit("not available"))
    earliest = first.select(F.lit(5).alias("section"), F.lit("").alias("code"), F.concat(F.lit("- Earliest parsed deadline: "), said).alias("line"))
    listed = signal_programs(rows).groupBy("signal").agg(F.array_join(F.array_sort(F.collect_list("program_code")), ", ").alias("codes"))  # a line of the report holds them all
    names = one.select(F.explode(F.array(*[F.struct(F.lit(6 + i).alias("section"), F.lit(k).alias("signal"), F.lit(text).alias("text")) for i, (k, text) in enumerate(SIGNALS)])).alias("n")).select("n.*")
    derived = names.join(listed, "signal", "left").select("section", F.lit("").alias("code"), F.concat("text", F.coalesce("codes", F.lit("none"))).alias("line"))
    return head.unionByName(body).unionByName(earliest).unionByName(derived)


def comparison_report(rows: DataFrame) -> DataFrame:
    """The report's lines (value) as one sorted table; written as text, its part files in the order of their names are the report."""
    return comparison_lines(rows).orderBy("section", "code").select(F.col("line").alias("value"))


def answers(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (question) -> (question, answer). Routed by substring: statistics, programming, mathematics, deadline, else help."""
    q = F.lower(T.collapse(F.coalesce("question", F.lit(""))))
    say = lambda head, c: F.concat(F.lit(head), F.coalesce(F.col(c), F.lit("none")))
    answer = (
        F.when(q == "", "Question is empty.")
        .when(T.any_of(q, ["statistics", "统计"]), say("Programs mentioning statistics foundation: ", "statistics"))
        .when(T.any_of(q, ["programming", "cs", "计算机", "编程"]), say("Programs mentioning programming/CS foundation: ", "programming"))
        .when(T.any_of(q, ["math", "mathematics", "数学"]), say("Programs mentioning mathematics foundation: ", "mathematics"))
        .when(T.any_of(q, ["earliest", "deadline", "截止", "最早"]), F.concat(F.lit("Earliest parsed deadline: "), F.coalesce("earliest_deadline", F.lit("not available"))))
        .otherwise(HELP)
    )
    signals = derived_signals(rows).withColumn("one", F.lit(1))  # one row
    return questions.withColumn("one", F.lit(1)).join(F.broadcast(signals), "one").select("question", answer.alias("answer"))
