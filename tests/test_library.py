"""Golden cases of the rules, on small inputs."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import evaluation, fields, lines, links, programs, reports, targets
from quadrille.sources import pages as P
from quadrille.sources import sinks


def extract(spark, title, body):
    page = spark.createDataFrame([("https://x.edu/p", title, body)], "source_url string, page_title string, body_text string")
    return fields.extract_pages(page).first()


def test_extracts_a_full_page(spark):
    body = "\n".join(
        [
            "Application deadline: December 1, 2026",
            "Tuition fee: HK$390,000 for the whole course",
            "English requirements",
            "Applicants must satisfy the University English language requirements with IELTS 6.5.",
            "Academic requirements",
            "Applicants should hold a bachelor degree with courses in calculus, linear algebra and programming.",
            "Department of Computer Science is located downtown",
            "Duration: 1.5 years (maximum 3 years)",
        ]
    )
    r = extract(spark, "Master of Science in Data Science Admissions", body)
    assert r["program_name"] == "Master of Science in Data Science"
    assert r["deadline"] == "December 1, 2026"
    assert r["tuition"] == "HK$390,000 for the whole course"
    assert "IELTS 6.5" in r["english_requirement"]
    assert r["academic_requirement"].startswith("Applicants should hold a bachelor degree")
    assert r["department"] == "Department of Computer Science"
    assert r["duration"] == "1.5 years (maximum 3 years)"
    assert r["prerequisite_keywords"] == ["linear algebra", "calculus", "programming"]
    assert r["foundation_programming"] and r["foundation_mathematics"] and not r["foundation_statistics"]


@pytest.mark.parametrize(
    "body,field,value",
    [
        ("Welcome to our pages", "deadline", None),
        ("Application opens on September 22, 2025", "deadline", None),
        ("Application fee: HK$300", "tuition", None),
        ("Tuition fee: HK$49,999", "tuition", None),
        ("Tuition fee: HK$300,000 full-time, HK$400,000 part-time", "tuition", "HK$300,000"),
        ("Do I need to take IELTS?", "english_requirement", None),
        ("Deadlines: please visit our site", "deadline", None),
        ("Admission schedule\nMain round\nRound 1: December 1, 2025\nRound 2: March 1, 2026", "deadline", "December 1, 2025"),
        ("", "tuition", None),
    ],
)
def test_field_rules(spark, body, field, value):
    assert extract(spark, "", body)[field] == value


def test_lines_normalise_and_number(spark):
    page = spark.createDataFrame([("u", "Title ", "a  b\n\n‘c’\x0bd")], "source_url string, page_title string, body_text string")
    assert [(r["idx"], r["line"]) for r in lines.page_lines(page).orderBy("idx").collect()] == [(0, "Title"), (1, "a b"), (2, "'c'"), (3, "d")]


def test_links_of_the_same_site(spark):
    rows = [("/apply", "Apply", True), ("https://www.a.hku.hk/fees#x", "Fees", True), ("https://hkust.edu.hk/", "Other", True), ("#top", "Top", True), ("mailto:x@y", "Mail", True), ("/hidden", "Hidden", False), ("../apply", "Again", True)]
    raw = spark.createDataFrame([("https://hku.hk/a/", i, h, t, v) for i, (h, t, v) in enumerate(rows)], "from_url string, pos int, href string, text string, visible boolean")
    assert [r["url"] for r in links.same_site_links(raw).orderBy("pos").collect()] == ["https://hku.hk/apply", "https://www.a.hku.hk/fees"]


def test_scope_keys(spark):
    urls = ["https://www.cs.cuhk.edu.hk/a", "https://hku.hk", "http://a.b.example.com:80/x", "nothing"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(T.scope_key(F.col("u")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["cuhk.edu.hk", "hku.hk", "example.com", ""]


def test_link_scores_and_ties(spark):
    rows = [("Tuition and Fees", "https://x.edu/b"), ("Tuition and Fees", "https://x.edu/a"), ("News", "https://x.edu/n"), ("Contact", "https://x.edu/c")]
    df = spark.createDataFrame([("s", i, a, u) for i, (a, u) in enumerate(rows)], "from_url string, pos int, anchor_text string, url string")
    got = links.rank_links(df).orderBy("rank").collect()
    assert [(r["url"][-1], r["score"], r["selected"]) for r in got][:2] == [("a", 19, True), ("b", 19, True)]
    assert [r["selected"] for r in got[2:]] == [False, False] and got[3]["score"] == -12


def program_pages(spark):
    empty = {"department": None, "duration": None, "english_requirement": None, "academic_requirement": None}
    rows = [
        {"program_code": "P", "source_url": "https://x/a", "page_title": "Overview", "program_name": "MSc in AI", "deadline": "Please visit us for details", "tuition": None, "prerequisite_keywords": ["statistics"], **empty},
        {"program_code": "P", "source_url": "https://x/b", "page_title": "Admissions", "program_name": None, "deadline": "1 December 2025", "tuition": "HK$10", "prerequisite_keywords": ["python", "statistics"], **empty},
    ]
    schema = "program_code string, source_url string, page_title string, program_name string, department string, duration string, deadline string, tuition string, english_requirement string, academic_requirement string, prerequisite_keywords array<string>, foundation_statistics boolean, foundation_programming boolean, foundation_mathematics boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    flags = [(True, False, False), (False, True, False)]
    return spark.createDataFrame([tuple(r.get(n) for n in names[:-3]) + f for r, f in zip(rows, flags)], schema)


def test_aggregation_skips_low_quality_values_and_keeps_sources(spark):
    r = programs.aggregate_programs(program_pages(spark)).first()
    assert (r["deadline"], r["deadline_source"], r["tuition"]) == ("1 December 2025", "https://x/b", None)
    assert r["program_name_source"] == "https://x/a"
    assert sorted(r["prerequisite_keywords"]) == ["python", "statistics"] and r["foundation_statistics"] and r["foundation_programming"]


def test_normal_forms_and_status(spark):
    gold = spark.createDataFrame(
        [("P", "completed", {"deadline": True}, "Master of AI (MAI)", "01 Dec 2025", "HKD 300,000", None, None, ["Python", "statistics", "algebra"])],
        "program_code string, label_status string, coverage map<string,boolean>, program_name string, deadline string, tuition string, english_requirement string, academic_requirement string, prerequisite_keywords array<string>",
    )
    rec = spark.createDataFrame([("P", "master of ai", None, "local HK$300,000 / other HK$400,000", None, "x", ["python", "statistics", "calculus"])], "program_code string, program_name string, deadline string, tuition string, english_requirement string, academic_requirement string, prerequisite_keywords array<string>")
    status = {r["field"]: r["status"] for r in evaluation.compare_scalars(rec, gold).collect()}
    assert status == {"program_name": "matched", "deadline": "field_left_null", "tuition": "matched", "english_requirement": "expected_null", "academic_requirement": "extraction_error"}
    k = evaluation.compare_keywords(rec, gold).first()
    assert round(k["precision"], 6) == round(k["recall"], 6) == round(k["f1"], 6) == round(2 / 3, 6)
    s = evaluation.summarize(evaluation.field_results(rec, gold), gold).first()
    assert (s["benchmark_status"], s["required"], s["matched"], s["missing_fields"]) == ("completed", 4, 2, ["deadline"])


def test_reports(spark):
    rows = [("U", "A", "a", "6 OCT 2025", "", "true", "false", "True", "2025-01"), ("U", "A", "a", "1 Jan 2020", "", "true", "false", "True", "2024-01"), ("U", "B", "b", "December 1, 2025", "", "yes", "1", "", "x"), ("U", " ", "b", "", "", "", "", "", "x")]
    e = spark.createDataFrame(rows, "university string, program_code string, program_name string, deadline string, tuition string, mentions_statistics_foundation string, mentions_programming_foundation string, mentions_math_foundation string, stem string")
    e = e.withColumns({"language_requirement": F.lit(""), "background_requirement": F.lit("")})
    latest = reports.latest_exports(e)
    assert latest.count() == 2
    asked = spark.createDataFrame([("statistics?",), ("earliest",), ("economics",), ("",)], "question string")
    got = {r["question"]: r["answer"] for r in reports.answers(latest, asked).collect()}
    assert got["statistics?"] == "Programs mentioning statistics foundation: A, B"
    assert got["earliest"] == "Earliest parsed deadline: 2025-10-06 (A)"
    assert got["economics"] == "Programs mentioning programming/CS foundation: B" and got[""] == "Question is empty."
    assert any(r["value"].startswith("| A | a | 6 OCT 2025 |") for r in reports.comparison_report(latest).collect())


def test_query_resolution(spark):
    t = spark.createDataFrame([("HKU", "HKU_MSC_AI", "Master of Science in Artificial Intelligence"), ("HKU", "HKU_MSC_CS", "Master of Science in Computer Science")], "university string, program_code string, program_name string")
    q = spark.createDataFrame([("HKU AI",), ("HKU",), ("zzz",)], "query string")
    got = {r["query"]: (r["program_code"], r["outcome"]) for r in targets.resolve_queries(q, t).collect()}
    assert got == {"HKU AI": ("HKU_MSC_AI", "resolved"), "HKU": ("HKU_MSC_AI, HKU_MSC_CS", "ambiguous"), "zzz": (None, "no match")}


def test_html_and_exports(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title><script>x</script></head><body><p>One<p>Two<br>Three<a href='/x' hidden>H</a><a href=\"/y\">Y</a></body>"
    page = spark.createDataFrame([("https://x.edu/", html), ("https://y.edu/", None)], "url string, html string")
    r = {x["source_url"]: x for x in P.captures_from_html(page).collect()}
    assert r["https://x.edu/"]["page_title"] == "A & B" and r["https://x.edu/"]["body_text"].split() == ["One", "Two", "ThreeHY"]
    assert r["https://y.edu/"]["body_text"] == ""
    assert [(x["href"], x["visible"]) for x in P.raw_links(page).orderBy("pos").collect()] == [("/x", False), ("/y", True)]
    with pytest.raises(ValueError):
        sinks.parse_formats("pdf")
    assert sinks.parse_formats("csv, JSON,csv") == ["csv", "json"]


@pytest.mark.parametrize("base,href,want", [("https://a.b/c/d?x#y", "e", "https://a.b/c/e"), ("https://a.b/c/d", "../e", "https://a.b/e"), ("https://a.b", "?q", "https://a.b?q"), ("https://a.b/c", "//d.e/f", "https://d.e/f"), ("https://a.b/c/", "./..//x/.", "https://a.b//x/")])
def test_resolve(spark, base, href, want):
    assert spark.createDataFrame([(base, href)], "b string, h string").select(T.resolve(F.col("b"), F.col("h")).alias("u")).first()["u"] == want


def test_empty_tables(spark):
    page = spark.createDataFrame([], "source_url string, page_title string, body_text string")
    assert fields.extract_pages(page).count() == 0
    assert programs.aggregate_programs(program_pages(spark).limit(0)).count() == 0


def test_extraction_sorts_no_lines_and_keeps_columns(spark):
    page = spark.createDataFrame([("P1", "u", "Fees", "Tuition fee: HK$90,000"), ("P2", None, "Fees", "Tuition fee: HK$80,000")], "program_code string, source_url string, page_title string, body_text string")
    out = fields.extract_pages(page, keep=["program_code"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Window", "Join"))  # the memory of a task would grow with its pages
    assert {r["program_code"]: r["tuition"] for r in out.collect()} == {"P1": "HK$90,000", "P2": "HK$80,000"}


def test_lines_of_pages_are_not_sorted(spark):
    pages = spark.createDataFrame([("a", "Fees:", "HK$1\n\n two\nDates:\nMay"), ("b", None, None), ("c", "", " \n"), ("d", "One", None)], "source_url string, page_title string, body_text string")
    got = lines.snippets(pages)
    for df in (got, lines.page_lines(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
    rows = [tuple(r) for r in got.orderBy("source_url", "idx").collect()]
    assert rows == [
        ("a", 0, "Fees:", True, "Fees: HK$1 two", None, None, "HK$1"), ("a", 1, "HK$1", False, "HK$1", "Fees:", None, "two"), ("a", 2, "two", False, "two", "HK$1", "Fees:", "Dates:"),
        ("a", 3, "Dates:", True, "Dates: May", "two", "HK$1", "May"), ("a", 4, "May", False, "May", "Dates:", "two", None), ("d", 0, "One", False, "One", None, None, None),
    ]
    assert [(r["source_url"], r["idx"], r["line"]) for r in lines.page_lines(pages).orderBy("source_url", "idx").collect()] == [r[:3] for r in rows]


def test_pages_with_equal_texts_are_read_once(spark):
    """Each page keeps its row, a null key as well; null and empty parts are one text."""
    faq = ("English FAQ", "English requirement: IELTS 6.5 or TOEFL 80 is accepted.")
    rows = [("a", *faq), ("b", *faq), (None, *faq), ("c", None, None), ("d", "", ""), ("e", "Fees", "Tuition fee: HK$300,000")]
    pages = spark.createDataFrame(rows, "source_url string, page_title string, body_text string")
    seen = []
    got = fields.extract_pages(pages, more=lambda texts: seen.append(texts.count()) or texts.withColumn("n", F.length("tuition"))).collect()
    assert seen == [3]
    assert sorted((r["source_url"] or "", r["page_title"], r["english_requirement"], r["tuition"], r["n"]) for r in got) == [
        ("", faq[0], faq[1].split(": ")[1], None, None), ("a", faq[0], faq[1].split(": ")[1], None, None), ("b", faq[0], faq[1].split(": ")[1], None, None), ("c", None, None, None, None), ("d", "", None, None, None),
        ("e", "Fees", None, "HK$300,000", len("HK$300,000")),
    ]


def test_records_are_made_with_one_shuffle_and_equal_the_single_rules(spark):
    import random

    r = random.Random(4)
    pick = lambda *values: r.choice([None, "", *values])
    words = ["python", "calculus", "statistics"]
    rows = [
        (f"P{r.randrange(9)}", f"https://x.edu/{r.choice(['overview', 'admissions', 'fees'])}/{n}", r.choice(["Programme fee", "Admission requirements", None]), pick("MSc in Art", "Master of Science in Art"), pick("School", "School of Fine Arts"), pick("2 years", "soon"),
         pick("May 1, 2026", "round 1"), pick("HK$100,000", "HK$200,000", "HK$10"), pick("IELTS 6.5"), pick("A degree."), r.sample(words, r.randrange(4)), r.random() < 0.3, r.random() < 0.3, False)
        for n in range(90)
    ]
    flags = ", ".join(f"{f} boolean" for f in programs.FLAGS)
    names = "program_name, department, duration, deadline, tuition, english_requirement, academic_requirement".split(", ")
    pages = spark.createDataFrame(rows, "program_code string, source_url string, page_title string, " + ", ".join(f"{n} string" for n in names) + f", prerequisite_keywords array<string>, {flags}")
    got = programs.aggregate_programs(pages)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in line for line in plan.splitlines()) == 1 and "Join" not in plan
    hinted = programs.with_hints(pages)
    best = {(x["program_code"], x["field"]): (x["value"], x["source_url"]) for x in programs.field_candidates(hinted).where("selected").collect()}
    first = {x["program_code"]: (x["source_url"], x["page_title"], x["completeness"]) for x in programs.best_pages(pages).collect()}
    merged = {x["program_code"]: (x["prerequisite_keywords"], x["keyword_sources"]) for x in programs.merged_keywords(hinted).collect()}
    on = {x["program_code"]: tuple(x)[1:] for x in programs.merged_foundations(hinted).collect()}
    found = got.collect()
    assert len(found) == len(first) == 9
    for x in found:
        code = x["program_code"]
        assert (x["source_url"], x["page_title"], x["completeness"]) == first[code]
        assert all((x[n], x[f"{n}_source"]) == best.get((code, n), (None, None)) for n in names)
        assert (x["prerequisite_keywords"], x["keyword_sources"]) == merged.get(code, ([], []))
        assert (*(x[f] for f in programs.FLAGS), x["foundation_sources"]) == on[code]
