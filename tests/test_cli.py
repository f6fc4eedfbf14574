"""The command line from a registry, a page store and labels to artifacts, exports and a report."""

import json

import pytest

from quadrille import cli
from test_runs import links_of

U = "https://uni.edu/"
OVERVIEW = "Master of Science in Data Science\nDepartment of Computer Science is here\nDuration: 1.5 years"
FEES = "Tuition fee: HK$390,000 for the whole course"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A store of three pages, links, a registry of three targets (one with a page that is gone, one that cannot be read) and one label."""
    top = tmp_path_factory.mktemp("cli")
    pages = [(U, U, "Master of Science in Data Science - Overview", OVERVIEW), (U + "admissions", U + "admissions", "Admissions", "Application deadline: December 1, 2026"), (U + "programme-fees", U + "programme-fees", "Fees", FEES)]
    spark.createDataFrame(pages, "requested_url string, source_url string, page_title string, body_text string").write.parquet(str(top / "pages"))
    links_of(spark, {U: [("Admissions", U + "admissions"), ("Programme tuition fees", U + "programme-fees")]}).write.parquet(str(top / "links"))
    seed = lambda url: {"page_type": "overview", "url": url, "priority": 1, "intended_fields": ["deadline", "tuition"]}
    listed = [{"university": "UNI", "program_code": code, "program_name": name, "tier": "core", "seed_pages": seeds} for code, name, seeds in [("UNI_DS", "Master of Science in Data Science", [seed(U)]), ("UNI_AI", "Master of Science in Robots", [seed(U + "gone")]), ("BAD", "x", [])]]
    (top / "targets.json").write_text(json.dumps({"targets": listed}))
    (top / "gold").mkdir()
    (top / "gold" / "UNI_DS.json").write_text(json.dumps({"program_code": "UNI_DS", "university": "UNI", "label_status": "completed", "fields": {"deadline": "December 1, 2026", "tuition": "HKD 390,000"}}))
    return top


def run(spark, world, out, *more):
    inputs = ["--pages", str(world / "pages"), "--links", str(world / "links"), "--output", str(out), "--registry-path", str(world / "targets.json")]
    return cli.main([*more, *inputs], spark)


def rows(spark, path):
    return [json.loads(r) for r in spark.read.json(str(path)).toJSON().collect()]


def test_curated_run_with_benchmark_and_draft(spark, world, tmp_path, capsys):
    assert run(spark, world, tmp_path, "--mode", "official-seed", "--all-programs", "--benchmark", "--gold-dir", str(world / "gold"), "--propose-gold-draft") == 0
    said = capsys.readouterr()
    record = rows(spark, tmp_path / "processed")
    assert [(r["program_code"], r["deadline"], r["tuition"]) for r in record] == [("UNI_DS", "December 1, 2026", "HK$390,000 for the whole course")]
    assert [(r["program_code"], r["reason"]) for r in rows(spark, tmp_path / "rejects")] == [("UNI_AI", "seed_page_not_fetched")]
    assert "target not read: targets.json BAD no seed pages" in said.err and f"rejected: UNI_AI {U}gone seed_page_not_fetched" in said.err
    got = {r["program_code"]: r for r in rows(spark, tmp_path / "eval")}
    assert got["UNI_DS"]["benchmark_status"] == "completed" and got["UNI_DS"]["required"] == 2 and got["UNI_AI"]["benchmark_status"] == "skipped_missing_gold_label"
    told = said.out.splitlines()
    assert "follow_up_update_reason: fields_supplemented" in told
    assert "field_coverage_rate: score_not_meaningful" in told
    assert "overall_field_score: 1.000" in told
    draft = rows(spark, tmp_path / "gold-drafts")
    assert [(d["program_code"], d["label_status"], d["run_mode"]) for d in draft] == [("UNI_DS", "manual_template_pending", "official-seed")]
    report = rows(spark, tmp_path / "debug")[0]
    assert [p["stage"] for p in report["inspected_pages"]] == ["official_seed_page"] + ["official_seed_auto_candidate"] * 2


def test_short_query_then_comparison(spark, world, tmp_path, capsys):
    assert run(spark, world, tmp_path, "--mode", "mvp", "--query", "uni data", "--export-formats", "json,csv,markdown") == 0
    said = capsys.readouterr().out
    assert "resolved_program_code: UNI_DS" in said and "export_csv_path: " in said
    assert cli.main(["--mode", "compare", "--compare-export-dir", str(tmp_path / "mvp/json"), "--compare-output-dir", str(tmp_path / "reports"), "--ask", "earliest deadline?"], spark) == 0
    assert "answer: Earliest parsed deadline: 2026-12-01 (UNI_DS)" in capsys.readouterr().out
    text = "".join(p.read_text() for p in sorted((tmp_path / "reports/mvp-comparison").glob("part-*")))
    assert text.splitlines()[2].startswith("| UNI_DS |") and text.endswith("mathematics foundation: none\n")


def test_generic_run(spark, world, tmp_path, capsys):
    assert run(spark, world, tmp_path, "--mode", "generic", "--university", "UNI", "--seed-url", U) == 0
    assert "candidate_pages_inspected: 2" in capsys.readouterr().out and rows(spark, tmp_path / "processed")[0]["tuition"].startswith("HK$390,000")


@pytest.mark.parametrize(
    "argv,code",
    [
        (["--mode", "compare", "--benchmark", "--compare-export-dir", "x"], 2),
        (["--mode", "mvp"], 2),
        (["--mode", "generic", "--seed-url", U], 2),
        (["--mode", "official-seed"], 2),
        (["--mode", "official-seed", "--all-programs", "--program-code", "A"], 2),
        (["--mode", "official-seed", "--all-programs", "--benchmark"], 2),
        (["--mode", "official-seed", "--program-code", "NOT_THERE"], 1),
        (["--mode", "official-seed", "--program-code", "UNI_AI", "--benchmark", "--gold-dir", "gold"], 1),
        (["--mode", "mvp", "--query", "nothing like it"], 1),
        (["--mode", "mvp", "--query", "UNI"], 1),
        (["--mode", "mvp", "--query", "uni data", "--export-formats", "pdf"], 1),
        (["--mode", "compare", "--compare-export-dir", "/nowhere/at/all"], 1),
    ],
)
def test_exit_codes(spark, world, tmp_path, argv, code):
    argv = [str(world / "gold") if a == "gold" else a for a in argv]
    own = argv if argv[1] == "compare" or argv in (["--mode", "generic", "--seed-url", U], ["--mode", "mvp"]) else None
    try:
        got = cli.main(own, spark) if own else run(spark, world, tmp_path, *argv)
    except SystemExit as e:
        got = e.code
    assert got == code
