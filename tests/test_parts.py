"""Page links, audits, validated readers, writers, query resolution, the report and the stream of exports."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.functions import values as V
from quadrille.operators import audit, links, reports, targets
from quadrille.sources import sinks, validated
from quadrille.streaming import captures, exports
from test_runs import DEADLINE, ENGLISH, TUITION, X, explore, extracts, links_of, store_of


def test_text_urls_follow_the_anchors_and_the_first_of_equal_urls_stays(spark):
    raw = spark.createDataFrame([("https://x.edu/a/", i, h, t, True) for i, (h, t) in enumerate([("/news", "News"), ("b", "B"), ("https://other.org/", "O")])], "from_url string, pos int, href string, text string, visible boolean")
    body = "See https://x.edu/news and https://x.edu/c#top, or (https://www.x.edu/d) https://else.org/ https://x.edu/c"
    pages = spark.createDataFrame([("https://x.edu/a/", body), ("https://x.edu/none", None), ("https://x.edu/text", "https://x.edu/a/b")], "source_url string, body_text string")
    got = [tuple(r) for r in links.page_links(raw, pages).orderBy("from_url", "pos").select("from_url", "pos", "anchor_text", "url").collect()]
    here = "https://x.edu/a/"
    assert got == [
        (here, 0, "News", "https://x.edu/news"), (here, 1, "B", "https://x.edu/a/b"), (here, 2, "https://x.edu/c#top,", "https://x.edu/c"), (here, 3, "https://www.x.edu/d", "https://www.x.edu/d"),
        ("https://x.edu/text", 0, "https://x.edu/a/b", "https://x.edu/a/b"),
    ]


def test_decisions_are_nested_and_ordered(spark):
    pages = extracts(spark, 24)
    flat = audit.decision_candidates(pages)
    rows = audit.decisions(flat).collect()
    assert {r["field"] for r in rows} == set(audit.STRATEGIES) and len(rows) == 4 * 9
    for r in rows:
        shown = [(-c["selected"], -c["eligible"], -c["hint_score"], c["source_url"]) for c in r["candidates"]]
        assert shown == sorted(shown) and r["strategy"] == audit.STRATEGIES[r["field"]]
        chosen = [c for c in r["candidates"] if c["selected"]]
        assert r["source_urls"] == list(dict.fromkeys(c["source_url"] for c in chosen))
        if r["field"] in V.AGGREGATED_FIELDS:
            assert len(chosen) <= 1 and r["selected_value"] == (chosen[0]["value"] if chosen else None)
    assert audit.decisions(audit.decision_candidates(pages.limit(0))).isEmpty()


def test_a_run_is_written_and_written_again(spark, tmp_path):
    pages = {X: ("Seed", {"program_name": "MSc in AI"}), X + "admissions": ("Admissions", {"deadline": DEADLINE, "english_requirement": ENGLISH}), X + "fees": ("Fees", {"tuition": TUITION})}
    found = {X: [("Admissions", X + "admissions"), ("Tuition fees", X + "fees")]}
    run = explore(spark, pages, found, [("r", X), ("lost", "https://gone.edu/")])
    store = store_of(spark, pages)
    where = sinks.write_run(run, store, str(tmp_path), "generic", "b1")
    read = lambda kind: sorted((json.loads(r) for r in spark.read.json(where[kind]).drop("artifact_name").toJSON().collect()), key=str)
    first = {kind: read(kind) for kind in where}
    names = {r["artifact_name"] for r in spark.read.json(where["raw"]).collect()}
    assert len(names) == 3 and all(n.endswith(".json") and n.startswith("r-") for n in names)
    assert first["processed"][0]["tuition"] == TUITION and first["rejects"][0]["reason"] == "seed_page_not_fetched"
    report = first["debug"][0]
    assert [p["stage"] for p in report["inspected_pages"]] == ["seed", "primary_candidate", "primary_candidate"]
    assert {d["field"] for d in report["aggregation_decisions"]} == set(audit.STRATEGIES) and report["reason"] == "no_missing_high_value_fields"
    assert [c["url"] for c in report["candidate_links"]] and report["run_mode"] == "generic" and {f["field"] for f in report["final_result"]} == set(audit.STRATEGIES)
    sinks.write_run(run, store, str(tmp_path), "generic", "b1")
    assert {kind: read(kind) for kind in where} == first
    sinks.write_batch(run.rejects, where["rejects"], "generic", "b2")
    assert len(read("rejects")) == 2 and {r["batch"] for r in read("rejects")} == {"b1", "b2"}


SEED = {"page_type": "overview", "url": "https://x.edu/", "priority": 1}
TARGET = {"university": "U", "program_code": "A", "program_name": "Master of A", "tier": "core", "seed_pages": [SEED]}


def test_targets_are_read_with_their_rejects(spark, tmp_path):
    bad = [
        {**TARGET, "program_code": "B", "seed_pages": []},
        {**TARGET, "program_code": "C", "seed_pages": [{**SEED, "priority": "first"}]},
        {k: v for k, v in TARGET.items() if k != "tier"},
        7,
        {**TARGET, "program_code": "D", "seed_pages": [{**SEED, "intended_fields": "tuition"}]},
        {**TARGET, "program_code": "E", "seed_pages": "none"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"targets": [TARGET, *bad, {**TARGET, "program_code": "F", "seed_pages": [{**SEED, "priority": "2", "intended_fields": ["tuition", "medium_of_instruction"]}]}]}))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text('{"targets": {}}')
    good, rejects = validated.read_targets(spark, str(tmp_path))
    got = {r["program_code"]: r["seed_pages"] for r in good.collect()}
    assert set(got) == {"A", "F"} and got["A"][0]["intended_fields"] == [] and got["F"][0]["priority"] == 2 and got["F"][0]["intended_fields"] == ["tuition", "medium_of_instruction"]
    assert {(r["file"], r["item"], r["reason"]) for r in rejects.collect()} == {
        ("a.json", "B", "no seed pages"), ("a.json", "C", "a seed page without page_type, url or a whole priority"), ("a.json", "A", "no tier"), ("a.json", "#4", "a target is no object"),
        ("a.json", "D", "intended_fields is no list"), ("a.json", "E", "no seed pages"), ("b.json", None, "no JSON"), ("c.json", None, "no list of targets"),
    }


def test_labels_are_read_with_their_rejects(spark, tmp_path):
    label = {"program_code": "A", "university": "U", "fields": {"deadline": "1 May 2026", "tuition": None, "prerequisite_keywords": ["python"]}, "coverage_expectations": {"deadline": True, "tuition": False, "unheard_of": True}, "notes": "n"}
    cases = {
        "good": label,
        "bare": {"program_code": "B", "university": "U", "fields": {"prerequisite_keywords": None}, "label_status": "completed"},
        "number": {**label, "fields": {"tuition": 390000}},
        "words": {**label, "fields": {"prerequisite_keywords": "python"}},
        "fields": {**label, "fields": ["deadline"]},
        "cover": {**label, "coverage_expectations": [1]},
        "code": {k: v for k, v in label.items() if k != "program_code"},
    }
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("nope")
    good, rejects = validated.read_gold(spark, str(tmp_path))
    got = {r["program_code"]: r for r in good.collect()}
    assert set(got) == {"A", "B"} and got["A"]["coverage"] == {"deadline": True, "tuition": False} and got["A"]["deadline"] == "1 May 2026" and got["A"]["tuition"] is None and got["A"]["notes"] == "n"
    assert (got["A"]["mode"], got["A"]["label_status"], got["B"]["label_status"], got["B"]["prerequisite_keywords"], got["B"]["coverage"]) == ("official_seed", "manual", "completed", [], {})
    assert {(r["file"], r["reason"]) for r in rejects.collect()} == {
        ("number.json", "tuition is neither a text nor null"), ("words.json", "prerequisite_keywords is no list"), ("fields.json", "fields is no object"),
        ("cover.json", "coverage_expectations is no object"), ("code.json", "no program_code"), ("broken.json", "no JSON"),
    }


def test_queries_meet_targets_by_tokens_only(spark):
    t = spark.createDataFrame([("HKU", "HKU_MSC_AI", "Master of Science in Artificial Intelligence"), ("HKU", "HKU_MSC_CS", "Master of Science in Computer Science"), ("Big U", "###", "!!")], "university string, program_code string, program_name string")
    asked = ["HKU AI", "hku  ai", "HKU", "zzz", "", None, "HKU_MSC_CS", "HKU Master of Science in Computer Science", "###", "computer zzz", "gone"]
    q = spark.createDataFrame([(a,) for a in asked], "query string")
    scores = targets.matches(q.where("query is not null"), t)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    whole = {(r["query"], r["program_code"]): r["score"] for r in targets.query_scores(q.where("query is not null"), t).where("score > 0").collect()}
    assert {(r["query"], r["program_code"]): r["score"] for r in scores.where("query <> ''").collect()} == whole
    got = {}
    for r in targets.resolved_targets(q, t, {"gone": "NOT_THERE", "zzz": "HKU_MSC_AI"}).collect():
        got.setdefault((r["query"], r["outcome"]), []).append(r["program_code"])
    assert got == {
        ("HKU AI", "resolved"): ["HKU_MSC_AI"], ("hku  ai", "resolved"): ["HKU_MSC_AI"], ("HKU", "ambiguous"): got["HKU", "ambiguous"], ("zzz", "resolved"): ["HKU_MSC_AI"], ("", "empty"): [None], (None, "empty"): [None],
        ("HKU_MSC_CS", "resolved"): ["HKU_MSC_CS"], ("HKU Master of Science in Computer Science", "resolved"): ["HKU_MSC_CS"], ("###", "resolved"): ["###"], ("computer zzz", "resolved"): ["HKU_MSC_CS"], ("gone", "no match"): [None],
    }
    assert sorted(got["HKU", "ambiguous"]) == ["HKU_MSC_AI", "HKU_MSC_CS"]


def test_the_report_is_ordered_text(spark, tmp_path):
    rows = [("U", c, f"Name {c}", d, "HK$1", "", "", s, p, m) for c, d, s, p, m in [("B", "December 1, 2025", True, True, False), ("A", "6 OCT 2025", True, False, False), ("C", "soon", False, True, True)]]
    schema = "university string, program_code string, program_name string, deadline string, tuition string, language_requirement string, background_requirement string, mentions_statistics_foundation boolean, mentions_programming_foundation boolean, mentions_math_foundation boolean"
    table = spark.createDataFrame(rows, schema).repartition(3)
    reports.comparison_report(table).write.text(str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text == (
        "| program_code | program_name | deadline | tuition | stats_foundation | programming_foundation | math_foundation |\n| --- | --- | --- | --- | --- | --- | --- |\n"
        "| A | Name A | 6 OCT 2025 | HK$1 | True | False | False |\n| B | Name B | December 1, 2025 | HK$1 | True | True | False |\n| C | Name C | soon | HK$1 | False | True | True |\n"
        "\n## Derived Signals\n- Earliest parsed deadline: 2025-10-06 (A)\n- Programs mentioning statistics foundation: A, B\n- Programs leaning CS/programming (heuristic): B\n- Programs mentioning mathematics foundation: C\n"
    )
    none = [r["value"] for r in reports.comparison_report(table.limit(0)).collect()]
    assert none[2:] == ["", "## Derived Signals", "- Earliest parsed deadline: not available", "- Programs mentioning statistics foundation: none", "- Programs leaning CS/programming (heuristic): none", "- Programs mentioning mathematics foundation: none"]
    assert {tuple(r) for r in reports.signal_programs(table).collect()} == {("statistics", "A"), ("statistics", "B"), ("programming", "B"), ("programming", "C"), ("cs_leaning", "B"), ("mathematics", "C")}


def test_the_newest_export_of_a_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = exports.stream_latest(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "state"))

    def arrive(**files):
        for name, (code, deadline) in files.items():
            (folder / f"{name}.json").write_text(json.dumps({"program_code": code, "deadline": deadline, "unknown": 1}))
        q = stream.start()  # goes on from its state each time
        q.processAllAvailable()
        q.stop()
        return {r["program_code"]: (r["stem"], r["deadline"]) for r in spark.sql("select * from newest").collect()}

    assert arrive(s2025_03=("A", "new"), s2025_01=("B", "b")) == {"A": ("s2025_03", "new"), "B": ("s2025_01", "b")}
    assert arrive(s2024_12=("A", "old"), s2025_02=("B", "b2"), s2026=(" ", "blank")) == {"A": ("s2025_03", "new"), "B": ("s2025_02", "b2")}
    assert arrive(s2025_04=("A", "newer")) == {"A": ("s2025_04", "newer"), "B": ("s2025_02", "b2")}


def test_deadlines_of_a_stream_of_captures(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"source_url": u, "page_title": t, "body_text": b, "captured_at": "2025-01-01T00:00:00"}) for u, t, b in [("a", "Apply", "Application deadline: 1 May 2026"), ("b", "News", "on 1 May 2026"), ("c", "Apply", "Application deadline soon")]))
    q = captures.stream_deadlines(spark, str(tmp_path)).writeStream.format("memory").queryName("deadlines").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from deadlines").collect()] == [("a", "1 May 2026")]


@pytest.mark.parametrize("anchor,url,score", [("Admissions", "https://x.edu/news", 10), ("News", "https://x.edu/n", -12)])
def test_link_scores_by_hand(spark, anchor, url, score):
    got = links.rank_links(links_of(spark, {X: [(anchor, url)]})).first()["score"]
    assert isinstance(got, int) and (got == score or anchor == "Admissions")


def test_links_are_dealt_out_before_they_are_scored(spark):
    one = links_of(spark, {X: [("Admissions", "https://x.edu/news")]}).coalesce(1)
    for scored in (links.rank_links(one), links.rank_follow_up(one, F.array(F.lit("tuition")))):
        assert "Exchange hashpartitioning(from_url" in scored.select("from_url", "score")._jdf.queryExecution().executedPlan().toString()


def test_letters_looked_for_first_change_no_match(spark):
    tables = [V.LINK_POSITIVE, V.LINK_NEGATIVE, V.FOLLOW_UP_SHARED, *V.FOLLOW_UP.values()]
    patterns = list(dict.fromkeys(p for t in tables for p, _ in t))
    assert all(T.needles(p) for p in patterns) and T.needles(r"\b(?:program|programme)\s+fees?\b") == ["fee"] and T.needles(r"\d+ fees") == [] and T.needles(r"a?|fee") == []
    said = [" ".join(w) for p in patterns for n in T.needles(p) for w in ([n], [n + "s"], ["x" + n], ["program", n + "s"], [n + "r"], ["the", n, "now"])] + ["", "frequently asked questions", "waivers and programme fees", None]
    df = spark.createDataFrame([(t,) for t in said], "t string").repartition(1)
    both = df.select(*[F.struct(T.says(F.col("t"), [p]).alias("a"), T.matches(F.col("t"), [p]).alias("b")).alias(f"c{i}") for i, p in enumerate(patterns)], F.struct(T.says(F.col("t"), patterns).alias("a"), T.matches(F.col("t"), patterns).alias("b")).alias("all"))
    assert all(x["a"] == x["b"] for row in both.collect() for x in row)
