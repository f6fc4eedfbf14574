"""Command line over a page store.

python -m quadrille.cli --mode generic --university U --seed-url URL --pages PAGES --links LINKS --output OUT
python -m quadrille.cli --mode official-seed --registry-path T.json --pages PAGES --links LINKS --output OUT (--program-code CODE | --all-programs)
    [--benchmark --gold-dir DIR] [--propose-gold-draft [--gold-draft-dir DIR]]
python -m quadrille.cli --mode mvp --query "UNI name" --registry-path T.json --pages PAGES --links LINKS --output OUT [--export-dir DIR] [--export-formats json,csv,markdown]
python -m quadrille.cli --mode compare --compare-export-dir DIR [--compare-output-dir DIR] [--ask QUESTION]

PAGES and LINKS are Parquet: requested_url, source_url, page_title, body_text; from_url, pos, anchor_text, url. Artifacts go below OUT in
folders by kind, run mode and batch; a batch that is run again replaces itself. Programmes that cannot be run are
rejected with a reason and do not stop the others. Exit codes: 2 for wrong use, 1 for a failed run, 0 otherwise.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, reports, runs, summaries, targets
from .sources import pages as P
from .sources import sinks, validated

SHOWN = 20
NOT_WITH = {"compare": ["benchmark", "propose_gold_draft"], "mvp": ["benchmark", "propose_gold_draft"], "generic": ["benchmark", "propose_gold_draft"], "homepage": ["benchmark", "propose_gold_draft"]}
NEEDED = {"generic": ["university", "seed_url", "pages", "links", "output"], "mvp": ["query", "registry_path", "pages", "links", "output"], "official-seed": ["registry_path", "pages", "links", "output"], "compare": ["compare_export_dir"]}
NEEDED["homepage"] = NEEDED["generic"]


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille")
    p.add_argument("--mode", choices=["generic", "homepage", "official-seed", "mvp", "compare"], default="generic")
    for names in (
        ["--university"], ["--seed-url"], ["--pages"], ["--links"], ["--output"], ["--registry-path", "--targets"], ["--program-code"], ["--query"], ["--gold-dir", "--gold"], ["--gold-draft-dir"],
        ["--export-dir"], ["--compare-export-dir", "--exports"], ["--compare-output-dir"], ["--ask"],
    ):
        p.add_argument(*names)
    p.add_argument("--export-formats", "--formats", default="json")
    p.add_argument("--batch", default="run", help="name of the batch that the artifacts belong to")
    for name in ("--benchmark", "--propose-gold-draft", "--all-programs"):
        p.add_argument(name, action="store_true")
    return p


def checked(parser: argparse.ArgumentParser, argv: list[str] | None) -> argparse.Namespace:
    """The arguments; wrong use ends the program with 2."""
    args = parser.parse_args(argv)
    flag = lambda name: "--" + name.replace("_", "-")
    for name in NOT_WITH.get(args.mode, []):
        if getattr(args, name):
            parser.error(f"{flag(name)} is not supported in {args.mode} mode")
    if missing := [flag(n) for n in NEEDED[args.mode] if not getattr(args, n)]:
        parser.error(f"needed in {args.mode} mode: " + ", ".join(missing))
    if args.mode == "official-seed":
        if bool(args.program_code) == args.all_programs:
            parser.error("give either --program-code or --all-programs")
        if args.benchmark and not args.gold_dir:
            parser.error("--benchmark needs --gold-dir")
    return args


def show(lines: DataFrame, key: str, path: str, mode: str, batch: str) -> None:
    """Writes the summary lines and prints those of the first keys."""
    sinks.write_batch(lines, path, mode, batch)
    for row in lines.join(F.broadcast(lines.select(key).distinct().orderBy(key).limit(SHOWN)), key).orderBy(key, "position").collect():  # SHOWN keys of a few lines
        print(row["line"])
    print(f"summary_path: {path}")


def finish(run: runs.Run, store: DataFrame, args: argparse.Namespace, mode: str) -> runs.Run:
    """Writes the artifacts of a run and reports its rejects; a run of nothing but rejects fails."""
    paths = sinks.write_run(run, store, args.output, mode, args.batch)
    for kind, path in paths.items():
        print(f"{kind}_output_path: {path}")
    rejects = run.rejects.orderBy(run.key, "url").limit(SHOWN).collect()
    for r in rejects:
        print(f"rejected: {r[run.key]} {r['url']} {r['reason']}", file=sys.stderr)
    if rejects and run.records.isEmpty():
        raise RuntimeError("no run succeeded")
    return run


def generic(spark: SparkSession, args: argparse.Namespace) -> None:
    request = spark.createDataFrame([(args.university, args.seed_url)], "run_id string, seed_url string")
    store = spark.read.parquet(args.pages)
    run = finish(runs.explore(request, store, spark.read.parquet(args.links)), store, args, "generic")
    show(summaries.run_summary(run, "generic"), run.key, f"{args.output}/summary", "generic", args.batch)


def registry(spark: SparkSession, path: str) -> DataFrame:
    known, rejects = validated.read_targets(spark, path)
    bad = rejects.orderBy("file", "item").limit(SHOWN).collect()
    for r in bad:
        print(f"target not read: {r['file']} {r['item'] or ''} {r['reason']}", file=sys.stderr)
    if bad and known.isEmpty():
        raise ValueError("no target could be read")
    return known


def curated(spark: SparkSession, args: argparse.Namespace) -> None:
    known = registry(spark, args.registry_path)
    chosen = known if args.all_programs else known.where(F.col("program_code") == args.program_code)
    if chosen.isEmpty():
        raise ValueError(f"Program code not found in official seed-page registry: {args.program_code}")
    labels = None
    if args.benchmark:
        labels, rejects = validated.read_gold(spark, args.gold_dir)
        for r in rejects.orderBy("file").limit(SHOWN).collect():
            print(f"label not read: {r['file']} {r['reason']}", file=sys.stderr)
        if not args.all_programs and labels.where(F.col("program_code") == args.program_code).isEmpty():
            raise ValueError(f"Gold label not found for program code {args.program_code}: {args.gold_dir}")
    store = spark.read.parquet(args.pages)
    run = finish(runs.curated_run(chosen, store, spark.read.parquet(args.links)), store, args, "official-seed")
    show(summaries.run_summary(run, "official-seed"), run.key, f"{args.output}/summary", "official-seed", args.batch)
    if args.propose_gold_draft:
        drafts = evaluation.gold_draft(chosen.join(run.records.select("program_code"), "program_code", "left_semi"), run.records)
        path = sinks.write_batch(sinks.named(drafts, "program_code"), args.gold_draft_dir or f"{args.output}/gold-drafts", "official-seed", args.batch)
        print(f"gold_draft_output_path: {path}")
    if labels is not None:
        results = summaries.benchmark(run, chosen, labels)
        print(f"evaluation_output_path: {sinks.write_batch(sinks.named(results, 'program_code'), f'{args.output}/eval', 'official-seed', args.batch)}")
        show(summaries.benchmark_summary(results), "program_code", f"{args.output}/benchmark-summary", "official-seed", args.batch)


def short_query(spark: SparkSession, args: argparse.Namespace) -> None:
    formats = sinks.parse_formats(args.export_formats)
    known = registry(spark, args.registry_path)
    hit = targets.resolve_queries(spark.createDataFrame([(args.query,)], "query string"), known, targets.ALIASES).first()
    if hit["outcome"] != "resolved":
        raise ValueError(f"query '{args.query}': {hit['outcome']}" + (f" ({hit['program_code']}); give a more specific query" if hit["program_code"] else ""))
    chosen = known.where(F.col("program_code") == hit["program_code"])
    store = spark.read.parquet(args.pages)
    run = finish(runs.curated_run(chosen, store, spark.read.parquet(args.links)), store, args, "mvp")
    print(f"query: {args.query}\nresolved_program_code: {hit['program_code']}")
    show(summaries.run_summary(run, "mvp"), run.key, f"{args.output}/summary", "mvp", args.batch)
    for kind, path in zip(formats, sinks.write_exports(reports.export_rows(chosen, run.records), args.export_dir or f"{args.output}/mvp", formats)):
        print(f"export_{kind}_path: {path}")


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = reports.latest_exports(P.read_exports(spark, args.compare_export_dir))
    if rows.isEmpty():
        raise ValueError(f"no exports in {args.compare_export_dir}")
    path = f"{args.compare_output_dir or args.compare_export_dir.rstrip('/') + '-report'}/mvp-comparison"
    reports.comparison_report(rows).write.mode("overwrite").text(path)
    print(f"run_mode: compare\ncompare_input_dir: {args.compare_export_dir}\ncompare_report_path: {path}")
    if args.ask:
        answer = reports.answers(rows, spark.createDataFrame([(args.ask,)], "question string")).first()["answer"]
        print(f"question: {args.ask}\nanswer: {answer}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = checked(build_parser(), argv)
    spark = spark or SparkSession.builder.getOrCreate()
    step = {"generic": generic, "homepage": generic, "official-seed": curated, "mvp": short_query, "compare": compare}[args.mode]
    try:
        step(spark, args)
    except (RuntimeError, ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # what Spark says of inputs that are not there
        if type(e).__name__ not in ("AnalysisException", "ParseException"):
            raise
        print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
