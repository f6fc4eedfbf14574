"""Registered queries of whole runs, and their DuckDB counterparts.

The made pages of programmes stand for sites: the first page of a programme is its seed, each page links to the next three,
and every fifth page, as well as the second of every programme whose code ends in 7, is not in the store. Pages are extracted already, so the run's extractor is a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import audit, crawl, links, programs, record_state, runs, targets
from ..sources import synthetic as S
from ..sources.staging import stage
from . import duck as D


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made pages with their place in the programme and next, the links to the three pages after them."""
    w = W.partitionBy("program_code").orderBy("source_url")
    label = F.concat(F.initcap(F.regexp_replace(F.regexp_extract("source_url", r"edu/([a-z\-]+)/", 1), "-", " ")), F.lit(" page"))
    e = S.extracts(spark, sf_dir).withColumn("label", label)
    later = F.array_compact(F.array(*[F.when(F.lead("source_url", i).over(w).isNotNull(), F.struct(F.lit(i).alias("pos"), F.lead("label", i).over(w).alias("anchor_text"), F.lead("source_url", i).over(w).alias("url"))) for i in (1, 2, 3)]))
    return e.withColumns({"place": F.row_number().over(w), "next": later}).drop("label")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed, made once and written, as a run reads it many times."""
    return stage(placed(spark, sf_dir), "site")


def edges(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("source_url").alias("from_url"), F.explode("next").alias("l")).select("from_url", "l.*")


def store_of(pages: DataFrame) -> DataFrame:
    there = pages.where("place % 5 != 4 and not (place = 2 and program_code like '%7')")
    return there.select(F.col("source_url").alias("requested_url"), "source_url", "page_title", F.lit("").alias("body_text"))


def web(pages: DataFrame) -> tuple[DataFrame, DataFrame, runs.Extractor]:
    """(store, links, extractor) of the pages of site."""
    fields = pages.drop("program_code", "page_title", "place", "next")
    return store_of(pages), stage(edges(pages), "web-links"), lambda captures: captures.select("source_url", "page_title").join(fields, "source_url")


def explored(spark: SparkSession, sf_dir: str) -> runs.Run:
    pages = site(spark, sf_dir)
    requests = pages.where("place = 1").select(F.col("program_code").alias("run_id"), F.col("source_url").alias("seed_url"))
    return runs.explore(requests, *web(pages))


def _flat(records: DataFrame, key: str) -> DataFrame:
    sources = [f"{f}_source" for f in V.AGGREGATED_FIELDS]
    return records.select(key, "source_url", "page_title", "completeness", *V.AGGREGATED_FIELDS, *sources, F.array_join("prerequisite_keywords", ",").alias("keywords"), *programs.FLAGS)


def follow_up_records(spark, sf_dir):
    return _flat(explored(spark, sf_dir).records, "run_id")


def follow_up_outcomes(spark, sf_dir):
    return explored(spark, sf_dir).outcomes.withColumns({c: F.array_join(c, ",") for c in ("missing", "updated")})


def follow_up_changes(spark, sf_dir):
    return explored(spark, sf_dir).changes.where(F.col("field").isin(V.AGGREGATED_FIELDS))


def run_candidates(spark, sf_dir):
    return explored(spark, sf_dir).candidates


def curated(spark, sf_dir, make_targets) -> runs.Run:
    """make_targets: from the made pages to their targets."""
    pages = site(spark, sf_dir)
    return runs.curated_run(stage(make_targets(pages), "targets"), *web(pages))


def curated_rejects(spark, sf_dir, make_targets) -> DataFrame:
    """The rejects of the run above, which are known before its scan begins."""
    pages = placed(spark, sf_dir)
    return runs.curated_seeds(stage(make_targets(pages), "targets"), store_of(pages))[1]


def state_records(spark, sf_dir):
    """Records from the states of three parts of the pages, merged."""
    pages = S.extracts(spark, sf_dir)
    part = F.pmod(F.xxhash64("source_url"), F.lit(3))
    return _flat(record_state.records(record_state.merge_states(*[record_state.record_state(pages.where(part == k)) for k in range(3)])), "program_code")


def page_links(spark, sf_dir):
    return links.page_links(S.raw_links(spark, sf_dir), S.captures(spark, sf_dir).select("source_url", "body_text"))


def decision_audit(spark, sf_dir):
    nested = audit.decisions(audit.decision_candidates(S.extracts(spark, sf_dir)))
    each = nested.select("program_code", "field", "strategy", F.posexplode("candidates").alias("position", "c"))
    return each.select("program_code", "field", "strategy", "position", "c.source_url", "c.value", "c.hint_score", "c.specificity_score", "c.completeness_score", "c.eligible", "c.selected")


ASKED = ["UNI", "UNI P1", "p7", "data analytics p10", "nothing here", "", "the seventh", "UNI master of science in data analytics p22"]
NAMED = {"the seventh": "P7", "nothing here": "NOT_THERE"}


def resolved_targets(spark, sf_dir):
    """The made queries against one target for each programme."""
    t = S.extracts(spark, sf_dir).select("program_code").distinct()
    t = t.select(F.lit("UNI").alias("university"), "program_code", F.concat(F.lit("Master of Science in Data Analytics "), "program_code").alias("program_name"))
    return targets.resolved_targets(spark.createDataFrame([(a,) for a in ASKED], "query string"), t, NAMED)


# ---- DuckDB ----
_FIELDS = ", ".join([*V.AGGREGATED_FIELDS, "prerequisite_keywords", *programs.FLAGS])
_FLAT = ", ".join(["source_url", "page_title", "completeness", *V.AGGREGATED_FIELDS, *(f"{f}_source" for f in V.AGGREGATED_FIELDS), "array_to_string(prerequisite_keywords, ',') as keywords", *programs.FLAGS])
_THERE = "(place % 5 <> 4 and not (place = 2 and program_code like '%7'))"
WEB = f"""placed as (select *, {D.COMPLETE} as completeness, row_number() over (partition by program_code order by source_url) as place,
    case regexp_extract(source_url, 'edu/([a-z\\-]+)/', 1) when 'overview' then 'Overview page' when 'admissions' then 'Admissions page' when 'fees' then 'Fees page' else 'English Faq page' end as label from ({D.EXTRACTS}) x),
  edges as (select x.program_code, x.source_url as from_url, x.place as from_place, y.place - x.place as pos, y.label as anchor_text, y.source_url as url, y.place as to_place, {_THERE.replace("place", "y.place").replace("program_code", "y.program_code")} as there, {D.plain('y.label')} as a, {D.plain('y.source_url')} as u
    from placed x join placed y on x.program_code = y.program_code and y.place > x.place and y.place <= x.place + 3)"""
_ORDER = "score desc, length(url), url, lower(anchor_text)"


def _follow_up() -> str:
    """Common tables up to f (the audited links of the round) and h2 (all inspected pages with hints)."""
    combined = f"case when mt and me then {D.follow_up_score(['tuition', 'english_requirement'])} when mt then {D.follow_up_score(['tuition'])} else {D.follow_up_score(['english_requirement'])} end"
    source_text = "lower(concat_ws(' ', page_title, anchor, source_url))"
    hinted = lambda *parts: D.plain("concat_ws(' ', " + ", ".join(parts) + ")")
    return f"""{WEB},
  l1 as (select *, {D.link_score('a', 'u')} as score from edges where from_place = 1),
  s1 as (select *, score > 0 and row_number() over (partition by program_code order by {_ORDER}, pos) <= 5 as selected from l1),
  h1 as (select program_code, source_url, page_title, {_FIELDS}, completeness, '' as anchor, {hinted('page_title', 'source_url')} as hint, place = 1 as is_seed from placed where place = 1
    union all select p.program_code, p.source_url, p.page_title, {', '.join(f'p.{f}' for f in _FIELDS.split(', '))}, p.completeness, s.anchor_text, {hinted('p.page_title', 's.anchor_text', 'p.source_url')}, false
    from s1 s join placed p on p.source_url = s.url where selected and there),
  r1 as (select p.program_code, p.source_url as seed_url, c.tuition is null as mt, c.english_requirement is null as me, c.* exclude (program_code) from placed p left join ({D.chosen('select * from h1')}) c using (program_code) where p.place = 1),
  src as (select * from (select h1.program_code, h1.source_url as from_url, seed_url, mt, me, row_number() over (partition by program_code order by coalesce(source_url in (deadline_source, academic_requirement_source, english_requirement_source), false) desc,
     {D.plus(*((f"contains({source_text}, {D.q(k)})", n) for k, n in crawl.SOURCE_WORDS))} desc, completeness desc, source_url) as rn
     from h1 join r1 using (program_code) where (mt or me) and {D.plus(*((f"contains({source_text}, {D.q(k)})", n) for k, n in crawl.SOURCE_WORDS))} > 0) z where rn = 1),
  f0 as (select 0 as attempt, e.*, {combined} as score from src join edges e using (program_code, from_url)),
  g0 as (select *, score > 0 and not exists (select 1 from h1 where h1.program_code = f0.program_code and h1.source_url = f0.url) as eligible from f0),
  f1 as (select 1 as attempt, e.*, {combined} as score from src join edges e on e.program_code = src.program_code and e.from_url = src.seed_url
    where src.from_url <> src.seed_url and not exists (select 1 from g0 where g0.program_code = src.program_code and eligible)),
  g as (select * from g0 union all select *, score > 0 and not exists (select 1 from h1 where h1.program_code = f1.program_code and h1.source_url = f1.url) as eligible from f1),
  o as (select *, row_number() over (partition by program_code, eligible, url order by {_ORDER}, attempt) as of_url from g),
  p as (select *, eligible and of_url = 1 and row_number() over (partition by program_code, eligible and of_url = 1 order by {_ORDER}, attempt) <= (select greatest(1, cast(mt as int) + cast(me as int)) from r1 where r1.program_code = o.program_code) as selected from o),
  f as (select *, selected and there as fetched, case when selected and not there then 'fetch_failed' when score <= 0 then 'irrelevant_to_missing_fields' when not eligible then 'already_inspected' when selected then null
    when bool_or(selected) over (partition by program_code, url) then 'duplicate_of_selected_candidate' else 'not_in_follow_up_top_k' end as rejection_reason from p),
  h2 as (select * exclude (anchor, is_seed) from h1 union all select p.program_code, p.source_url, p.page_title, {', '.join(f'p.{f}' for f in _FIELDS.split(', '))}, p.completeness, {hinted('p.page_title', 'f.anchor_text', 'p.source_url')} from f join placed p on p.source_url = f.url where fetched),
  before as materialized ({D.chosen('select * from h1')}), after as materialized ({D.chosen('select * from h2')})"""


_UNPIVOT = lambda t: " union all ".join(f"select program_code, {D.q(f)} as field, {f} as value, {f}_source as source from {t}" for f in V.AGGREGATED_FIELDS)
_CHANGED = f"""b as ({_UNPIVOT('before')}), x as ({_UNPIVOT('after')}), changes as (select program_code, field, b.value as before, x.value as after, b.source as before_source, x.source as source,
   case when b.value is not distinct from x.value then 'moved' when b.value is null then 'added' when x.value is null then 'removed' else 'changed' end as change
   from b full join x using (program_code, field) where b.value is distinct from x.value or b.source is distinct from x.source)"""

FOLLOW_UP_RECORDS = f"with {_follow_up()} select program_code as run_id, {_FLAT} from ({D.records('select * from h2')}) r"
FOLLOW_UP_CHANGES = f"with {_follow_up()}, {_CHANGED} select program_code as run_id, * exclude (program_code) from changes"
FOLLOW_UP_OUTCOMES = f"""with {_follow_up()}, {_CHANGED},
  n as (select program_code, count(*) as found, count(*) filter (score > 0) as positive, count(*) filter (selected) as picked, count(*) filter (fetched) as fetched from f group by program_code),
  u as (select program_code, concat_ws(',', max(case when field = 'tuition' then field end), max(case when field = 'english_requirement' then field end)) as updated from changes
    where after is not null and change in ('added', 'changed') and ((field = 'tuition' and before is null) or (field = 'english_requirement' and before is null)) group by program_code)
  select r1.program_code as run_id, concat_ws(',', case when mt then 'tuition' end, case when me then 'english_requirement' end) as missing, from_url as source_url, coalesce(found, 0) as found, coalesce(fetched, 0) as fetched, coalesce(updated, '') as updated,
   case when not (mt or me) then 'no_missing_high_value_fields' when from_url is null then 'no_follow_up_source_page_selected' when coalesce(found, 0) = 0 then 'no_same_domain_follow_up_candidates_found'
     when positive = 0 then 'no_follow_up_candidates_matched_missing_fields' when picked = 0 then 'all_follow_up_candidates_rejected_by_filtering' when fetched = 0 then 'follow_up_candidates_selected_but_not_fetched'
     when coalesce(updated, '') <> '' then 'fields_supplemented' else 'follow_up_pages_did_not_fill_missing_fields' end as reason
  from (select program_code, mt, me from r1) r1 left join (select program_code, from_url from src) s using (program_code) left join n using (program_code) left join u using (program_code)"""
RUN_CANDIDATES = f"""with {_follow_up()} select program_code as run_id, cast(null as int) as attempt, from_url, anchor_text, url, cast(score as int) as score, score > 0 as eligible, selected, selected and there as fetched, cast(null as varchar) as rejection_reason, 'seed' as discovery_stage from s1
  union all select program_code, attempt, from_url, anchor_text, url, cast(score as int), eligible, selected, fetched, rejection_reason, 'follow_up' from f"""
STATE_RECORDS = f"select program_code, {_FLAT} from ({D.RECORDS}) r"


# ---- the supplement scan, one pick a turn, each programme's pool as a list ----
_SEEDS = f"""seeds as (select * from (select program_code, regexp_extract(source_url, 'edu/([a-z\\-]+)/', 1) as page_type, source_url, cast(length(source_url) % 3 as int) as priority, {_THERE} as there, page_title,
    case when contains(source_url, '/fees/') then ['tuition'] when contains(source_url, '/admissions/') then ['deadline', 'academic_requirement'] else ['tuition', 'deadline'] end as intended,
    row_number() over (partition by program_code order by regexp_extract(source_url, 'edu/([a-z\\-]+)/', 1), source_url) as rn from placed) z where rn <= 3),
  wanted as (select program_code, list_distinct(flatten(list(intended))) as fields from seeds group by program_code)"""


def _boost() -> str:
    """What a link's text is worth for a programme: its name and code, whatever is missing."""
    names = f"list_filter(regexp_split_to_array(lower(concat('Master of Science in Data Analytics ', program_code)), '[^a-z0-9]+'), lambda t: t <> '' and t not in ({', '.join(map(D.q, crawl.NAME_STOPS))}))"
    codes = "list_filter(regexp_split_to_array(lower(program_code), '[^a-z0-9]+'), lambda t: t <> '' and t not in ('uni', 'msc', 'ms'))"
    found, by_code = f"len(list_filter({names}, lambda t: contains(txt, t)))", f"len(list_filter({codes}, lambda t: contains(txt, t))) > 0"
    details = D.any_of("txt", ["programme-details", "program-details", "programme details", "program details"])
    sure = f"({by_code} or {found} >= 2)"
    return D.plus((by_code, 25), (f"{found} >= 2", 15), (f"{found} = 1", 7), (f"({details} and {sure})", 30), (f"(contains(txt, '?programme=') and {sure})", 20))


def _lack(missing: list[str]) -> str:
    details = D.any_of("txt", ["programme details", "program details", "programme-details", "program-details"])
    listed = D.any_of("txt", ["programme listing", "program listing"])
    pairs = [("contains(txt, 'faq')", -30), (listed, -8), ("contains(txt, 'faculty=')", -8)]
    if "tuition" in missing:
        fee = D.any_of("txt", ["programme fee", "program fee", "tuition", "fee and payment"])
        pairs += [(details, 12), (fee, 5), ("contains(txt, 'application fee')", -20), ("(contains(txt, 'programme fee and payment') and not contains(txt, '?programme='))", -10)]
    if "deadline" in missing:
        pairs += [(D.any_of("txt", ["deadline", "apply", "application", "admission"]), 4), ("contains(txt, 'application deadline')", 8), (D.any_of("txt", ["how do i apply", "when are the application deadlines"]), -25)]
    return D.plus(*pairs)


def _turns(first: str) -> str:
    """first: common tables with sources (program_code, from_url, attempt, missing) -> tables up to picks."""
    sets = {"dt": ["deadline", "tuition"], "d": ["deadline"], "t": ["tuition"]}
    columns = ", ".join(f"cast({D.follow_up_score(m)} as int) as s_{k}, cast({_boost()} + {_lack(m)} as int) as b_{k}" for k, m in sets.items())
    by_missing = lambda c, m: f"case when len({m}) = 2 then {c}_dt when {m}[1] = 'deadline' then {c}_d else {c}_t end"
    link = lambda m, depth, attempt: f"{{'depth': {depth}, 'attempt': {attempt}, 'from_url': k.from_url, 'anchor': anchor_text, 'url': url, 'score': {by_missing('k.s', m)}, 'b_dt': b_dt, 'b_d': b_d, 'b_t': b_t, 'there': there}}"
    pool_type = "struct(depth int, attempt int, from_url varchar, anchor varchar, url varchar, score int, b_dt int, b_d int, b_t int, there boolean)[]"
    open_ = "list_filter(pool, lambda x: x.score > 0 and not list_contains(taken, x.url))"
    worth = "(x.score + case when len(missing) = 2 then x.b_dt when missing[1] = 'deadline' then x.b_d else x.b_t end - x.depth)"
    keyed = f"list_sort(list_transform({open_}, lambda x: {{'a': -{worth}, 'b': -x.score, 'c': x.depth, 'd': length(x.url), 'e': x.url, 'f': lower(x.anchor), 'g': x.attempt, 'x': x}}))[1]"
    gives = f"list_filter([case when {D.eligible('deadline', 'deadline')} then 'deadline' end, case when {D.eligible('tuition', 'tuition')} then 'tuition' end], lambda f: f is not null)"
    return f"""{first},
  shelf as (select source_url as page, {gives} as gives from placed),
  k as (select *, {columns} from (select *, lower(concat_ws(' ', anchor_text, url)) as txt from edges) z),
  next_pool as (select k.from_url, {', '.join(f"list({link(repr(m), 0, 0)}) as {n}" for n, m in (('p_dt', ['deadline', 'tuition']), ('p_d', ['deadline']), ('p_t', ['tuition'])))} from k group by k.from_url),
  start as (select s.program_code, any_value(missing) as missing, list_distinct(list(s.from_url)) as sources, list({link('missing', 0, 's.attempt')}) filter (k.url is not null) as pool from sources s left join k on k.from_url = s.from_url group by s.program_code),
  st as (select program_code, 0 as n, missing, 0 as done, sources as taken, sources as expanded, cast(coalesce(pool, []) as {pool_type}) as pool, cast(null as {pool_type[:-2]}) as pick, 0 as priority, false as fetched from start
    union all
    select program_code, n + 1, left_, done + cast(got as int), list_append(taken, best.x.url), case when deeper then list_append(expanded, best.x.url) else expanded end,
      case when deeper then list_concat(pool, cast(coalesce(list_transform(case when len(left_) = 2 then p_dt when left_[1] = 'deadline' then p_d else p_t end,
        lambda y: {{'depth': best.x.depth + 1, 'attempt': 1000 + n, 'from_url': y.from_url, 'anchor': y.anchor, 'url': y.url, 'score': y.score, 'b_dt': y.b_dt, 'b_d': y.b_d, 'b_t': y.b_t, 'there': y.there}}), []) as {pool_type})) else pool end,
      best.x, -best.a, got
    from (select *, got and best.x.depth + 1 < {crawl.MAX_DEPTH} and len(left_) > 0 and not list_contains(expanded, best.x.url) as deeper from (
      select b.*, best.x.there as got, case when best.x.there then list_filter(missing, lambda m: not list_contains(gives, m)) else missing end as left_, np.p_dt, np.p_d, np.p_t
      from (select *, {keyed} as best from st where done < {crawl.MAX_FETCHES} and len(missing) > 0) b left join shelf on page = best.x.url left join next_pool np on np.from_url = best.x.url where best is not null) z) z2),
  picks as (select program_code, n as round, pick.depth as depth, pick.from_url as from_url, pick.anchor as anchor_text, pick.url as url, pick.score as score, priority, fetched from st where n > 0)"""


def _lacking(records: str) -> str:
    return f"""lacking as (select program_code, list_filter([case when r.deadline is null and list_contains(fields, 'deadline') then 'deadline' end, case when r.tuition is null and list_contains(fields, 'tuition') then 'tuition' end], lambda f: f is not null) as missing
    from wanted join (select distinct program_code from h1) z using (program_code) left join ({records}) r using (program_code))"""


_PAGE_FIELDS = "source_url, page_title, " + _FIELDS + ", completeness"
_SCAN = f"""{WEB}, {_SEEDS},
  h1 as (select program_code, {_PAGE_FIELDS}, {D.plain("concat_ws(' ', page_title, source_url)")} as hint from placed where place = 1), {_lacking(D.chosen('select * from h1'))},
  sources as (select program_code, source_url as from_url, 1 as attempt, missing from h1 join lacking using (program_code) where len(missing) > 0)"""
_PLAIN_STORE = _SCAN.replace(_THERE.replace("place", "y.place").replace("program_code", "y.program_code"), "(y.place % 5 <> 4)")
SUPPLEMENT_CRAWL = f"with recursive {_turns(_PLAIN_STORE)} select program_code, cast(round as int) as round, depth, from_url, url, score, priority, fetched from picks"

_CURATED = f"""{WEB}, {_SEEDS}, gone as (select program_code, source_url as url, 'seed_page_not_fetched' as reason from seeds where not there),
  h1 as (select s.program_code, {', '.join(f'p.{c}' for c in _PAGE_FIELDS.split(', '))}, {D.plain("concat_ws(' ', p.page_title, s.page_type, array_to_string(s.intended, ' '), p.source_url)")} as hint
    from seeds s join placed p using (source_url) where s.program_code not in (select program_code from gone)), {_lacking(D.chosen('select * from h1'))},
  sources as (select program_code, source_url as from_url, row_number() over (partition by program_code order by overlap = 0, overlap desc, case when priority = 0 then 999 else priority end, source_url) as attempt, missing
    from (select s.*, missing, len(list_intersect(intended, missing)) as overlap from seeds s join lacking using (program_code) where len(missing) > 0) z)"""
CURATED_REJECTS = f"with {_CURATED} select program_code, url, reason from gone"
_CURATED_ALL = f"""{_turns(_CURATED)},
  h2 as (select * from h1 union all select p.program_code, {', '.join(f'p.{c}' for c in _PAGE_FIELDS.split(', '))}, {D.plain("concat_ws(' ', p.page_title, k.anchor_text, p.source_url)")} from picks k join placed p on p.source_url = k.url where fetched),
  final as materialized (select * from ({D.records('select * from h2')}) r), shown as (select f.program_code, coalesce(program_name_source, a, b) as url from final f join
    (select program_code, arg_min(source_url, (priority, source_url)) filter (page_type = 'overview') as a, arg_min(source_url, (priority, source_url)) as b from seeds group by program_code) s using (program_code))"""
CURATED_RECORDS = f"""with recursive {_CURATED_ALL} select f.program_code, {', '.join('x.' + c if c in ('source_url', 'page_title') else c for c in _FLAT.split(', ', 2)[:2])}, {_FLAT.split(', ', 2)[2].replace("array_to_string(prerequisite_keywords, ',')", "array_to_string(f.prerequisite_keywords, ',')")}
  from (select * exclude (source_url, page_title) from final) f join shown using (program_code) join (select distinct source_url, page_title from placed) x on x.source_url = shown.url"""
CURATED_OUTCOMES = f"""with recursive {_CURATED_ALL},
  n as (select program_code, count(*) as picked, count(*) filter (fetched) as fetched from picks group by program_code),
  looked as (select program_code, from_url from sources union select program_code, url from (select *, row_number() over (partition by program_code order by round desc) as last_, count(*) filter (fetched) over (partition by program_code order by round) as so_far from picks) z
    where fetched and depth + 1 < {crawl.MAX_DEPTH} and so_far < {crawl.MAX_FETCHES} and exists (select 1 from st where st.program_code = z.program_code and st.n = z.round and len(st.missing) > 0)),
  l as (select program_code, count(*) as found from looked join edges using (program_code, from_url) group by program_code),
  u as (select program_code, concat_ws(',', case when list_contains(missing, 'deadline') and f.deadline is not null then 'deadline' end, case when list_contains(missing, 'tuition') and f.tuition is not null then 'tuition' end) as updated, array_to_string(missing, ',') as missing,
    len(missing) as lacks from lacking join final f using (program_code))
  select program_code, missing, from_url as source_url, coalesce(case when lacks > 0 then found end, 0) as found, coalesce(fetched, 0) as fetched, updated, case when lacks = 0 then 'no_missing_curated_fields' when coalesce(found, 0) = 0 then 'no_same_domain_supplement_candidates_found'
    when not exists (select 1 from st where st.program_code = u.program_code and len(list_filter(pool, lambda x: x.score > 0)) > 0) then 'no_supplement_candidates_matched_missing_fields' when coalesce(picked, 0) = 0 then 'all_supplement_candidates_rejected_by_filtering'
    when coalesce(fetched, 0) = 0 then 'supplement_candidates_selected_but_not_fetched' when updated <> '' then 'fields_supplemented' else 'supplement_pages_did_not_fill_missing_fields' end as reason
  from u left join n using (program_code) left join l using (program_code) left join (select program_code, from_url from sources where attempt = 1) s using (program_code)"""


# ---- one round of further links from the seed pages alone ----
FOLLOW_UP_CANDIDATES = f"""with {WEB},
  h1 as (select program_code, {_PAGE_FIELDS}, {D.plain("concat_ws(' ', page_title, source_url)")} as hint from placed where place = 1),
  r1 as (select h1.program_code, c.tuition is null as mt, c.english_requirement is null as me from h1 left join ({D.chosen('select * from h1')}) c using (program_code)
    where {D.plus(*((f"contains(lower(concat_ws(' ', h1.page_title, '', h1.source_url)), {D.q(k)})", n) for k, n in crawl.SOURCE_WORDS))} > 0),
  f as (select e.*, mt, me, case when mt and me then {D.follow_up_score(['tuition', 'english_requirement'])} when mt then {D.follow_up_score(['tuition'])} else {D.follow_up_score(['english_requirement'])} end as score
    from r1 join edges e using (program_code) where from_place = 1 and (mt or me)),
  p as (select *, score > 0 and row_number() over (partition by program_code, score > 0 order by {_ORDER}) <= greatest(1, cast(mt as int) + cast(me as int)) as selected from f)
  select program_code as run_id, 0 as attempt, from_url, cast(pos as int) as pos, anchor_text, url, cast(score as int) as score, score > 0 as eligible, selected, selected and to_place % 5 <> 4 as fetched,
    case when selected and to_place % 5 = 4 then 'fetch_failed' when score <= 0 then 'irrelevant_to_missing_fields' when selected then null else 'not_in_follow_up_top_k' end as rejection_reason from p"""
REJECTION_REASONS = f"select rejection_reason, count(*) as n from ({FOLLOW_UP_CANDIDATES}) c group by rejection_reason"
SOURCE_OUTCOMES = f"""select *, case when positive = 0 then 'candidates_found_but_all_irrelevant' when eligible = 0 then 'all_eligible_candidates_already_inspected' when fetched > 0 then 'selected_candidates_fetched'
    when selected > 0 then 'selected_candidates_not_fetched' else 'eligible_candidates_not_selected' end as outcome
  from (select run_id, attempt, from_url, count(*) as candidates, count(*) filter (score > 0) as positive, count(*) filter (eligible) as eligible, count(*) filter (selected) as selected, count(*) filter (fetched) as fetched
    from ({FOLLOW_UP_CANDIDATES}) c group by run_id, attempt, from_url) x"""


# ---- parts ----
PAGE_LINKS = f"""with a as (select from_url, cast(pos as bigint) as place, text as anchor_text, regexp_extract(from_url, '^(https://[^/]*)', 1) as root, trim(href) as href from ({S.raw_links_sql('duck')}) r where visible),
  known as (select from_url, place, {D.squash('anchor_text')} as anchor_text, case when starts_with(href, '/') then concat(root, regexp_replace(href, '#.*$', '')) when starts_with(href, '../') then concat(root, substr(href, 3)) else href end as url from a where not starts_with(href, '#') and not contains(href, 'example.org')
    union all select source_url, 1000000 + generate_subscripts(u, 1), unnest(u), unnest(u) from (select source_url, regexp_extract_all(body_text, 'https?://[^\\s)>\\]}}]+') as u from ({D.CAPTURES}) c) z),
  firsts as (select *, row_number() over (partition by from_url, url order by place) as rn from known)
  select from_url, cast(row_number() over (partition by from_url order by place) - 1 as int) as pos, anchor_text, url from firsts where rn = 1"""

_ON = "list_filter([case when foundation_statistics then 'statistics' end, case when foundation_programming then 'programming' end, case when foundation_mathematics then 'mathematics' end], lambda x: x is not null)"


def _merged_audit(field: str, items: str, hint: str, strategy: str) -> str:
    return f"""select program_code, '{field}' as field, '{strategy}' as strategy, source_url, array_to_string(items, ', ') as value, hint_score, len(items) as specificity_score, completeness as completeness_score, len(items) > 0 as eligible,
      source_url in (select u from (select distinct program_code as pc, first_value(source_url) over (partition by program_code, item order by hint_score desc, completeness desc, source_url) as u
        from (select program_code, source_url, completeness, {D.hint_score(hint)} as hint_score, unnest({items}) as item from h) z) y where y.pc = x.program_code) as selected
    from (select *, {items} as items, {D.hint_score(hint)} as hint_score from h) x"""


DECISION_AUDIT = f"""with h as materialized ({D.HINTED}), c as ({D.candidates()}),
  whole as (select program_code, field, case when field = 'program_name' then '{audit.BY_NAME}' else '{audit.BY_HINT}' end as strategy, source_url, value, hint_score, specificity as specificity_score, completeness as completeness_score, eligible, selected from c
    union all {_merged_audit('prerequisite_keywords', 'prerequisite_keywords', 'prerequisite_keywords', audit.STRATEGIES['prerequisite_keywords'])}
    union all {_merged_audit('foundation_mentions', _ON, 'academic_requirement', audit.STRATEGIES['foundation_mentions'])})
  select program_code, field, strategy, cast(row_number() over (partition by program_code, field order by selected desc, eligible desc, hint_score desc, source_url) - 1 as int) as position, source_url, value, cast(hint_score as int) as hint_score,
    cast(specificity_score as int) as specificity_score, cast(completeness_score as int) as completeness_score, eligible, selected from whole"""

RESOLVED_TARGETS = f"""with s as (select * from ({D.query_scores([a for a in ASKED if a and a not in NAMED])}) q), best as (select query, program_code, score from (select *, max(score) over (partition by query) as top from s) z where score = top and score > 0),
  asked as (select unnest([{', '.join(map(D.q, ASKED))}]) as query),
  hit as (select query, program_code, cast(score as bigint) as score from best union all select 'the seventh', program_code, null from (select distinct program_code from ({D.EXTRACTS}) e where program_code = 'P7') z),
  n as (select query, count(*) as n from hit group by query)
  select query, case when query = '' then 'empty' when n is null then 'no match' when n = 1 then 'resolved' else 'ambiguous' end as outcome, program_code, score from asked left join hit using (query) left join n using (query)"""

# ---- HTML ----
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _decoded(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


RAW_LINKS = f"""select from_url, pos, {_decoded("regexp_extract(head, '(?is)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]*)', 1)")} as href, {_decoded("regexp_replace(a, '(?s)<[^>]*>', '', 'g')")} as text,
    not regexp_matches(head, '(?i)\\bhidden\\b|display\\s*:\\s*none|visibility\\s*:\\s*hidden') as visible
  from (select from_url, cast(pos as int) as pos, a, regexp_extract(a, '(?is)^<a\\b([^>]*)>', 1) as head from (select url as from_url, unnest(l) as a, generate_subscripts(l, 1) - 1 as pos from (select url, regexp_extract_all(coalesce(html, ''), '(?is)<a\\b[^>]*>.*?</a\\s*>') as l from pages) x) y) z"""
SAME_SITE = f"""with r as ({RAW_LINKS}), k as (select from_url, pos, {D.squash('text')} as anchor_text, {D.squash('href')} as href, regexp_extract(from_url, '^(https?://[^/?#]*)', 1) as root from r where visible),
  u as (select from_url, pos, anchor_text, regexp_replace(case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '/') then concat(root, href)
      else concat(case when regexp_replace(from_url, '[?#].*$', '') = root then concat(root, '/') else regexp_extract(regexp_replace(from_url, '[?#].*$', ''), '^(.*/)', 1) end, href) end, '#.*$', '') as url, root
    from k where href <> '' and not regexp_matches(lower(href), '^(?:#|javascript:|mailto:|tel:)')),
  s as (select *, regexp_extract(regexp_replace(lower(root), '^https?://(www\\.)?', ''), '([^.:]+\\.[^.:]+)(:[0-9]+)?$', 1) as own, regexp_extract(regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)), '^https?://(www\\.)?', ''), '([^.:]+\\.[^.:]+)(:[0-9]+)?$', 1) as its from u where regexp_matches(url, '^https?:'))
  select from_url, pos, anchor_text, url from (select *, row_number() over (partition by from_url, url order by pos) as rn from s where own <> '' and own = its) z where rn = 1"""
_BODY = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', '', 'g'),
   '(?i)<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title|body))\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')""".replace("\\\\", "\\")
CAPTURE_FROM_HTML = f"""select url as source_url, {D.squash(_decoded("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"))} as page_title, cast(length({D.squash(_decoded(_BODY))}) as int) as n_chars from pages"""

# ---- records from captures: the extraction of every field, put together ----
_EXTRACTED = f"""select c.program_code, c.source_url, c.page_title, {', '.join(V.AGGREGATED_FIELDS)}, case when coalesce(keywords, '') = '' then [] else string_split(keywords, ',') end as prerequisite_keywords,
    {', '.join(f'coalesce({f}, false) as {f}' for f in programs.FLAGS)}
  from ({D.CAPTURES}) c left join ({D.program_name()}) f1 using (source_url) left join ({D.department()}) f2 using (source_url) left join ({D.duration()}) f3 using (source_url) left join ({D.deadline()}) f4 using (source_url)
    left join ({D.tuition()}) f5 using (source_url) left join ({D.english()}) f6 using (source_url) left join ({D.academic()}) f7 using (source_url) left join ({D.keywords()}) f8 using (source_url) left join ({D.foundations()}) f9 using (source_url)"""
PROGRAM_RECORDS = f"with pages as materialized (select *, {D.plain(D.PAGE_TEXT)} as hint, {D.COMPLETE} as completeness from ({_EXTRACTED}) e) select program_code, {_FLAT} from ({D.records('select * from pages')}) r"
