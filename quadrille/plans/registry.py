"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import crawl, evaluation, fields, frontier, lines, links, programs, reports, targets
from ..sources import pages as P
from ..sources import synthetic as S
from ..sources.staging import stage
from . import duck as D
from . import run_queries as R

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures -> lines -> fields -> one record for each programme with the source of every field."""
    return _program_records(spark, sf_dir)


def _pages_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")


def _extracted(name: str) -> Query:
    return lambda spark, sf_dir: fields.extract_pages(S.captures(spark, sf_dir)).select("source_url", name)


def _program_records(spark, sf_dir):
    pages = S.captures(spark, sf_dir)
    extracted = fields.extract_pages(pages, keep=["program_code"], more=lambda texts: stage(programs.judged(texts), "texts"))
    out = programs.aggregate_programs(extracted)
    return out.select("program_code", "source_url", "page_title", "completeness", *V.AGGREGATED_FIELDS, *[f"{f}_source" for f in V.AGGREGATED_FIELDS], F.array_join("prerequisite_keywords", ",").alias("keywords"), *programs.FLAGS)


def _hinted(spark, sf_dir):
    return programs.with_hints(S.extracts(spark, sf_dir))


def _records(spark, sf_dir):
    return programs.aggregate_programs(S.extracts(spark, sf_dir))


def _gold(spark, sf_dir):
    coverage = F.create_map(*[x for f in V.EVALUATED_FIELDS for x in (F.lit(f), F.lit(f in ("deadline", "tuition")))])
    return S.gold(spark, sf_dir).withColumns({"coverage": coverage, "prerequisite_keywords": F.array(F.lit("Statistics "), F.lit("python"), F.lit("linear algebra"))})


def _targets(spark, sf_dir):
    return _targets_of(S.extracts(spark, sf_dir))


def _targets_of(e):
    """Curated targets made of programmes: three seed pages each."""
    page = F.struct(
        F.regexp_extract("source_url", r"edu/([a-z\-]+)/", 1).alias("page_type"), F.col("source_url").alias("url"), (F.length("source_url") % 3).alias("priority"),
        F.when(F.col("source_url").contains("/fees/"), F.array(F.lit("tuition"))).when(F.col("source_url").contains("/admissions/"), F.array(F.lit("deadline"), F.lit("academic_requirement"))).otherwise(F.array(F.lit("tuition"), F.lit("deadline"))).alias("intended_fields"),
    )
    out = e.groupBy("program_code").agg(F.slice(F.array_sort(F.collect_list(page)), 1, 3).alias("seed_pages"))
    return out.select(F.lit("UNI").alias("university"), "program_code", F.concat(F.lit("Master of Science in Data Analytics "), "program_code").alias("program_name"), F.lit("core").alias("tier"), "seed_pages")


def _exports(spark, sf_dir):
    t = S.extracts(spark, sf_dir).select("program_code").distinct().withColumns({"university": F.lit("UNI"), "program_name": F.lit("Unnamed")})
    return reports.export_rows(t, _records(spark, sf_dir))


def _export_table(spark, sf_dir):
    """Exports of several runs: one for each page, the file stem from its URL."""
    e = S.extracts(spark, sf_dir)
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    return e.select(
        F.lit("UNI").alias("university"), "program_code", "program_name", "deadline", "tuition", F.col("english_requirement").alias("language_requirement"), F.col("academic_requirement").alias("background_requirement"),
        flag("foundation_statistics").alias("mentions_statistics_foundation"), flag("foundation_programming").alias("mentions_programming_foundation"), flag("foundation_mathematics").alias("mentions_math_foundation"), F.col("source_url").alias("stem"),
    )


def _ask(spark, sf_dir):
    asked = ["Which mention statistics?", "best for CS people", "math heavy", "earliest deadline?", "what is the weather", ""]
    rows = reports.latest_exports(_export_table(spark, sf_dir))
    return reports.answers(rows, spark.createDataFrame([(a,) for a in asked], "question string"))


def _summary(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    out = evaluation.summarize(evaluation.field_results(_records(spark, sf_dir), gold), gold)
    rates = {c: F.round(c, 6) for c in ("overall_field_score", "field_coverage_rate", "exact_match_rate")}
    return out.withColumns(rates | {c: F.array_join(c, ",") for c in ("scored_fields", "missing_fields", "skipped_fields")})


def _field_matrix(spark, sf_dir):
    return programs.field_candidates(_hinted(spark, sf_dir)).select("program_code", "source_url", "field", "value", "hint_score", "eligible", "specificity", "selected")


def _crawl_inputs(spark, sf_dir):
    """Runs over the extracts: the first page of a programme is its seed; its other pages are only reachable by links."""
    e = R.site(spark, sf_dir)
    made = e.drop("place", "next")
    store = e.where("place % 5 != 4").drop("place", "next", "program_code").withColumn("url", F.col("source_url")).dropDuplicates(["url"])
    return made, e.where("place = 1").drop("place", "next"), stage(R.edges(e).distinct(), "web-links"), store


def _supplement(spark, sf_dir):
    made, seeds, edges, store = _crawl_inputs(spark, sf_dir)
    _, done = frontier.supplement_crawl(stage(_targets_of(made), "targets"), seeds, edges, store)
    return done.picks.select("program_code", "round", "depth", "from_url", "url", "score", "priority", "fetched")


def _follow_up(spark, sf_dir):
    _, seeds, edges, store = _crawl_inputs(spark, sf_dir)
    pages = seeds.withColumnRenamed("program_code", "run_id").withColumns({"anchor_text": F.lit(""), "stage": F.lit("seed")})
    records = programs.aggregate_programs(pages, by="run_id").withColumn("missing", crawl.follow_up_missing())
    return crawl.follow_up_candidates(pages, records, edges, pages.select("run_id", F.col("source_url").alias("seed_url")), store.select("url"))


def _urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def _money(spark, sf_dir):
    return S.captures(spark, sf_dir).select("source_url", F.array_max(T.amounts(F.col("body_text"))).alias("max_amount"), F.size(T.amounts(F.col("body_text"))).alias("n_amounts"))


_ASKED = ["UNI", "UNI P1", "p7", "data analytics p10", "nothing here"]


def _resolve(spark, sf_dir):
    return targets.query_scores(spark.createDataFrame([(a,) for a in _ASKED], "query string"), _targets(spark, sf_dir))


_CAPTURE_COLUMNS = "program_code, source_url, page_title, body_text"
_LATEST = f"""with t as (select program_code, program_name, deadline, tuition, english_requirement, academic_requirement, foundation_statistics as s, foundation_programming as p, foundation_mathematics as m,
   row_number() over (partition by program_code order by source_url desc) as rn from ({D.EXTRACTS}) e), latest as (select * from t where rn = 1)"""
_DAY = """coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d %b %Y'), try_strptime(d, '%d %B %Y'), try_strptime(d, '%B %d %Y'), try_strptime(d, '%b %d %Y'))"""
_SIGNALS = f"""{_LATEST}, dated as (select *, cast({_DAY} as date) as day from (select *, {D.squash("replace(deadline, ',', ' ')")} as d from latest) x)"""
_ANSWERS = f"""{_SIGNALS}, said as (select coalesce(string_agg(program_code, ', ' order by program_code) filter (s), 'none') as stats, coalesce(string_agg(program_code, ', ' order by program_code) filter (p), 'none') as programming,
   coalesce(string_agg(program_code, ', ' order by program_code) filter (m), 'none') as maths, coalesce(arg_min(concat(cast(day as varchar), ' (', program_code, ')'), (day, program_code)) filter (day is not null), 'not available') as earliest from dated)
   select question, case kind when 's' then concat('Programs mentioning statistics foundation: ', stats) when 'p' then concat('Programs mentioning programming/CS foundation: ', programming)
     when 'm' then concat('Programs mentioning mathematics foundation: ', maths) when 'd' then concat('Earliest parsed deadline: ', earliest) when 'e' then 'Question is empty.'
     else 'Supported questions currently include: statistics foundation, programming/CS foundation, mathematics foundation, and earliest deadline.' end as answer
   from (values ('Which mention statistics?', 's'), ('best for CS people', 'p'), ('math heavy', 'm'), ('earliest deadline?', 'd'), ('what is the weather', 'h'), ('', 'e')) a(question, kind), said"""
_TARGET_PAGES = f"""select program_code, regexp_extract(source_url, 'edu/([a-z\\-]+)/', 1) as page_type, source_url as url, cast(length(source_url) % 3 as int) as priority,
   row_number() over (partition by program_code order by regexp_extract(source_url, 'edu/([a-z\\-]+)/', 1), source_url) as rn from ({D.EXTRACTS}) e"""

_DISPLAY = f"""with p as (select * from ({_TARGET_PAGES}) t where rn <= 3), f as (select program_code, arg_min(url, (priority, url)) filter (page_type = 'overview') as a, arg_min(url, (priority, url)) as b from p group by program_code),
   r as (select program_code, coalesce(program_name_source, a, b) as display_url from ({D.RECORDS}) x left join f using (program_code)), t as (select source_url as display_url, min(page_title) as display_title from ({D.EXTRACTS}) e group by 1)
   select program_code, display_url, display_title from r left join t using (display_url)"""

#: name -> (query, DuckDB SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {
    # sources and lines
    "captures": (lambda s, d: S.captures(s, d), f"select {_CAPTURE_COLUMNS} from ({D.CAPTURES}) c"),
    "capture_from_html": (lambda s, d: P.captures_from_html(_pages_table(s, d)).select("source_url", "page_title", F.length(T.collapse("body_text")).alias("n_chars")), R.CAPTURE_FROM_HTML),
    "raw_links": (lambda s, d: P.raw_links(_pages_table(s, d)), R.RAW_LINKS),
    "page_links": (R.page_links, R.PAGE_LINKS),
    "page_lines": (lambda s, d: lines.page_lines(S.captures(s, d)), f"with {D.LINES} select * from lines"),
    "header_flags": (lambda s, d: lines.snippets(S.captures(s, d)).select("source_url", "idx", "is_header"), f"with {D.HEADS} select source_url, idx, is_header from heads"),
    "header_snippets": (lambda s, d: lines.snippets(S.captures(s, d)).select("source_url", "idx", "snippet"), f"with {D.SNIPS} select source_url, idx, snippet from snips"),
    # links
    "links_resolved_same_scope": (lambda s, d: links.same_site_links(P.raw_links(_pages_table(s, d))), R.SAME_SITE),
    "domain_scope_key": (
        lambda s, d: _urls(s, d).select("page_id", T.scope_key(F.col("url")).alias("scope")),
        "select page_id, array_to_string(list_slice(p, greatest(len(p) - 1, 1), len(p)), '.') as scope from (select page_id, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', ''), '.') as p from pages) x",
    ),
    "strip_fragment": (lambda s, d: _urls(s, d).select("page_id", T.strip_fragment(F.col("url")).alias("url")), "select page_id, regexp_replace(url, '#.*$', '') as url from pages"),
    "text_urls": (lambda s, d: S.captures(s, d).select("source_url", F.array_join(T.text_urls(F.col("body_text")), ",").alias("urls")), f"select source_url, array_to_string(regexp_extract_all(body_text, 'https?://[^\\s)>\\]}}]+'), ',') as urls from ({D.CAPTURES}) c"),
    "link_scores": (lambda s, d: links.rank_links(S.links(s, d)).select("from_url", "pos", "anchor_text", "url", "score"), D.LINK_SCORES),
    "link_topk": (lambda s, d: links.rank_links(S.links(s, d)).select("from_url", "pos", "url", "score", "rank", "selected"), D.ranked(D.LINK_SCORES, 5)),
    "follow_up_link_scores": (
        lambda s, d: links.rank_follow_up(S.links(s, d), F.array(F.lit("tuition"), F.lit("english_requirement"))).select("from_url", "pos", "anchor_text", "url", "score"),
        D.follow_up_scores(["tuition", "english_requirement"]),
    ),
    "follow_up_select": (
        lambda s, d: links.rank_follow_up(S.links(s, d), F.array(F.lit("deadline"))).select("from_url", "pos", "url", "score", "rank", "selected"),
        D.ranked(D.follow_up_scores(["deadline"]), 2),
    ),
    # field extraction
    "extract_deadline": (_extracted("deadline"), D.deadline()),
    "extract_tuition": (_extracted("tuition"), D.tuition()),
    "extract_english_requirement": (_extracted("english_requirement"), D.english()),
    "extract_academic_requirement": (_extracted("academic_requirement"), D.academic()),
    "extract_program_name": (_extracted("program_name"), D.program_name()),
    "extract_department": (_extracted("department"), D.department()),
    "extract_duration": (_extracted("duration"), D.duration()),
    "extract_prerequisite_keywords": (lambda s, d: fields.extract_pages(S.captures(s, d)).select("source_url", F.array_join("prerequisite_keywords", ",").alias("keywords")), D.keywords()),
    "foundation_mentions": (lambda s, d: fields.extract_pages(S.captures(s, d)).select("source_url", *programs.FLAGS), D.foundations()),
    "program_records": (_program_records, R.PROGRAM_RECORDS),
    # programmes
    "completeness_score": (lambda s, d: S.extracts(s, d).select("program_code", "source_url", programs.completeness().alias("completeness")), f"select program_code, source_url, completeness from ({D.HINTED}) h"),
    "best_page_per_program": (lambda s, d: programs.best_pages(S.extracts(s, d)), D.BEST_PAGE),
    "field_hint_scores": (lambda s, d: _field_matrix(s, d).select("program_code", "source_url", "field", "hint_score"), f"select program_code, source_url, field, hint_score from ({D.candidates()}) c"),
    "field_eligibility": (lambda s, d: _field_matrix(s, d).select("program_code", "source_url", "field", "eligible"), f"select program_code, source_url, field, eligible from ({D.candidates()}) c"),
    "field_specificity": (lambda s, d: _field_matrix(s, d).select("program_code", "source_url", "field", "specificity"), f"select program_code, source_url, field, cast(specificity as int) as specificity from ({D.candidates()}) c"),
    "aggregate_scalar_fields": (lambda s, d: _field_matrix(s, d).where("selected").select("program_code", "field", "value"), f"select program_code, field, value from ({D.candidates()}) c where selected"),
    "field_provenance": (lambda s, d: _field_matrix(s, d).where("selected").select("program_code", "field", "source_url"), f"select program_code, field, source_url from ({D.candidates()}) c where selected"),
    "decision_audit": (R.decision_audit, R.DECISION_AUDIT),
    "merge_prerequisite_keywords": (
        lambda s, d: programs.merged_keywords(_hinted(s, d)).select("program_code", F.array_join("prerequisite_keywords", ",").alias("keywords"), F.size("keyword_sources").cast("long").alias("n_sources")),
        D.keyword_merge(),
    ),
    "merge_foundation_flags": (lambda s, d: programs.merged_foundations(_hinted(s, d)).select("program_code", *programs.FLAGS, F.size("foundation_sources").alias("n_sources")), D.foundation_merge()),
    "missing_fields": (
        lambda s, d: _records(s, d).select("program_code", F.array_join(programs.missing_fields(["tuition", "english_requirement"]), ",").alias("missing")),
        f"select program_code, concat_ws(',', case when tuition is null then 'tuition' end, case when english_requirement is null then 'english_requirement' end) as missing from ({D.CHOSEN}) c",
    ),
    # targets
    "seed_page_order": (
        lambda s, d: targets.seed_pages(_targets(s, d)).select("program_code", "url", "priority", "position"),
        f"select program_code, url, priority, cast(row_number() over (partition by program_code order by priority, url) as int) as position from ({_TARGET_PAGES}) t where rn <= 3",
    ),
    "coverage_defaults": (
        lambda s, d: evaluation.coverage_defaults(_targets(s, d)).select("program_code", F.explode("coverage").alias("field", "covered")).where("covered").select("program_code", "field"),
        f"""with p as (select program_code, url from ({_TARGET_PAGES}) t where rn <= 3) select distinct program_code, field from (
            select program_code, unnest(case when contains(url, '/fees/') then ['tuition'] when contains(url, '/admissions/') then ['deadline', 'academic_requirement'] else ['tuition', 'deadline'] end) as field from p) x""",
    ),
    "resolve_query": (_resolve, D.query_scores(_ASKED)),
    "resolved_targets": (R.resolved_targets, R.RESOLVED_TARGETS),
    # exploration
    "follow_up_candidates": (_follow_up, R.FOLLOW_UP_CANDIDATES),
    "rejection_reasons": (lambda s, d: _follow_up(s, d).groupBy("rejection_reason").agg(F.count("*").alias("n")), R.REJECTION_REASONS),
    "source_outcomes": (lambda s, d: crawl.follow_up_source_audit(_follow_up(s, d)), R.SOURCE_OUTCOMES),
    "supplement_crawl": (_supplement, R.SUPPLEMENT_CRAWL),
    "curated_records": (lambda s, d: R._flat(R.curated(s, d, _targets_of).records, "program_code"), R.CURATED_RECORDS),
    "curated_rejects": (lambda s, d: R.curated_rejects(s, d, _targets_of), R.CURATED_REJECTS),
    "curated_outcomes": (lambda s, d: R.curated(s, d, _targets_of).outcomes.withColumns({c: F.array_join(c, ",") for c in ("missing", "updated")}), R.CURATED_OUTCOMES),
    "follow_up_records": (R.follow_up_records, R.FOLLOW_UP_RECORDS),
    "follow_up_changes": (R.follow_up_changes, R.FOLLOW_UP_CHANGES),
    "follow_up_outcomes": (R.follow_up_outcomes, R.FOLLOW_UP_OUTCOMES),
    "run_candidates": (R.run_candidates, R.RUN_CANDIDATES),
    "state_records": (R.state_records, R.STATE_RECORDS),
    "display_page_alignment": (lambda s, d: crawl.display_pages(_records(s, d), _targets(s, d), S.extracts(s, d)), _DISPLAY),
    # evaluation
    "normalize_field_value": (
        lambda s, d: evaluation.with_normalized(evaluation.long_fields(_gold(s, d), "gold"), F.col("field"), normal="value_gold").select("program_code", "field", "normal"),
        " union all ".join(f"select program_code, '{f}' as field, {D.norm_field(f, f)} as normal from ({D.GOLD}) g" for f in V.SCALAR_FIELDS),
    ),
    "compare_scalar_fields": (lambda s, d: evaluation.compare_scalars(_records(s, d), _gold(s, d)).select("program_code", "field", "status"), D.scalar_status()),
    "status_histogram": (lambda s, d: evaluation.compare_scalars(_records(s, d), _gold(s, d)).groupBy("status").agg(F.count("*").alias("n")), f"select status, count(*) as n from ({D.scalar_status()}) x group by status"),
    "compare_keyword_field": (lambda s, d: evaluation.compare_keywords(_records(s, d), _gold(s, d)).select("program_code", "status", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")), D.KEYWORD_SCORES),
    "evaluation_summary": (_summary, D.summary()),
    "benchmark_status": (lambda s, d: evaluation.summarize(evaluation.field_results(_records(s, d), _gold(s, d)), _gold(s, d)).select("program_code", "benchmark_status"), f"select program_code, benchmark_status from ({D.summary()}) s"),
    "gold_draft": (lambda s, d: evaluation.gold_draft(_targets(s, d), _records(s, d)).withColumn("prerequisite_keywords", F.array_join("prerequisite_keywords", ",")), D.GOLD_DRAFT),
    # reports
    "export_rows": (_exports, D.EXPORT_ROWS),
    "latest_exports": (
        lambda s, d: reports.latest_exports(_export_table(s, d)).drop("university"),
        f"""{_LATEST} select program_code, coalesce(program_name, '') as program_name, coalesce(deadline, '') as deadline, coalesce(tuition, '') as tuition, coalesce(english_requirement, '') as language_requirement,
            coalesce(academic_requirement, '') as background_requirement, s as mentions_statistics_foundation, p as mentions_programming_foundation, m as mentions_math_foundation from latest""",
    ),
    "earliest_deadline": (
        lambda s, d: reports.derived_signals(reports.latest_exports(_export_table(s, d))).select("earliest_deadline"),
        f"{_SIGNALS} select concat(cast(day as varchar), ' (', program_code, ')') as earliest_deadline from dated where day is not null order by day, program_code limit 1",
    ),
    "comparison_table": (
        lambda s, d: reports.derived_signals(reports.latest_exports(_export_table(s, d))).select("statistics", "programming", "cs_leaning", "mathematics"),
        f"""{_LATEST} select string_agg(program_code, ', ' order by program_code) filter (s) as statistics, string_agg(program_code, ', ' order by program_code) filter (p) as programming,
            string_agg(program_code, ', ' order by program_code) filter (p and not m) as cs_leaning, string_agg(program_code, ', ' order by program_code) filter (m) as mathematics from latest""",
    ),
    "signal_programs": (
        lambda s, d: reports.signal_programs(reports.latest_exports(_export_table(s, d))),
        f"{_LATEST} select 'statistics' as signal, program_code from latest where s union all select 'programming', program_code from latest where p union all select 'cs_leaning', program_code from latest where p and not m union all select 'mathematics', program_code from latest where m",
    ),
    "comparison_report": (
        lambda s, d: reports.comparison_lines(reports.latest_exports(_export_table(s, d))),
        f"""{_SIGNALS}
          select 0 as section, '' as code, '| program_code | program_name | deadline | tuition | stats_foundation | programming_foundation | math_foundation |' as line union all select 1, '', '| --- | --- | --- | --- | --- | --- | --- |'
          union all select 2, program_code, concat('| ', concat_ws(' | ', program_code, coalesce(program_name, ''), coalesce(deadline, ''), coalesce(tuition, ''), case when s then 'True' else 'False' end, case when p then 'True' else 'False' end, case when m then 'True' else 'False' end), ' |') from dated
          union all select 3, '', '' union all select 4, '', '## Derived Signals'
          union all select 5, '', concat('- Earliest parsed deadline: ', coalesce(arg_min(concat(cast(day as varchar), ' (', program_code, ')'), (day, program_code)) filter (day is not null), 'not available')) from dated
          union all select 6, '', concat('- Programs mentioning statistics foundation: ', coalesce(string_agg(program_code, ', ' order by program_code) filter (s), 'none')) from dated
          union all select 7, '', concat('- Programs leaning CS/programming (heuristic): ', coalesce(string_agg(program_code, ', ' order by program_code) filter (p and not m), 'none')) from dated
          union all select 8, '', concat('- Programs mentioning mathematics foundation: ', coalesce(string_agg(program_code, ', ' order by program_code) filter (m), 'none')) from dated""",
    ),
    "ask_questions": (_ask, _ANSWERS),
    # functions
    "parse_currency_amounts": (_money, f"select source_url, list_max({D.amounts('body_text')}) as max_amount, cast(len({D.amounts('body_text')}) as int) as n_amounts from ({D.CAPTURES}) c"),
    "parse_deadline_date": (
        lambda s, d: S.extracts(s, d).where("deadline is not null").select("source_url", reports.parse_deadline(F.col("deadline")).alias("day")),
        f"select source_url, cast({_DAY} as date) as day from (select source_url, {D.squash(chr(114) + 'eplace(deadline, ' + D.q(',') + ', ' + D.q(' ') + ')')} as d from ({D.EXTRACTS}) e where deadline is not null) x",
    ),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
