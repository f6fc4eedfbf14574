"""The same rules as DuckDB SQL text, for checking: small builders of SQL expressions and the queries made of them."""

from __future__ import annotations

import re

from ..functions import values as V
from ..sources import synthetic as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_of(x: str, words: list[str]) -> str:
    return rx(x, "|".join(re.sub(r"([^A-Za-z0-9 _])", r"\\\1", w) for w in words))


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    a = f"regexp_replace({squash(x)}, '^[\\s\\-:;,.()]+', '')"
    b = f"(case when {rx(a, '^[sS] +[A-Z]')} then regexp_replace({a}, '^[sS]\\s+', '') else {a} end)"
    return f"trim(regexp_replace({b}, '\\s+([,.;:])', '\\1', 'g'))"


def first(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {q('(?i)' + pattern)}, 0), '')"


def has_date(x: str) -> str:
    return rx(x, "(?i)" + "|".join(f"(?:{p})" for p in V.DATES))


def date(x: str) -> str:
    return "coalesce(" + ", ".join(squash(first(x, p)) for p in V.DATES) + ")"


def has_money(x: str) -> str:
    return rx(x, "(?i)" + V.CURRENCY)


def amounts(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q('(?i)' + V.CURRENCY)}), lambda m: cast(trunc(cast(replace(regexp_extract(m, {q(V.AMOUNT)}, 0), ',', '') as double)) as bigint))"


def words(x: str) -> str:
    return f"(case when {squash(x)} = '' then 0 else length({squash(x)}) - length(replace({squash(x)}, ' ', '')) + 1 end)"


def strip_label(x: str, labels: list[str]) -> str:
    prefix = f"split_part({x}, ':', 1)"
    colon = f"(contains({x}, ':') and length({prefix}) <= 80 and not contains(lower({prefix}), 'http') and {any_of(f'lower({prefix})', labels)})"
    parts = [f"case when {colon} then nullif({squash(f'substr({x}, length({prefix}) + 2)')}, '') end"]
    for label in labels:
        rest = squash(f"ltrim(substr({x}, {len(label) + 1}), ' -:')")
        parts.append(f"case when starts_with(lower({x}), {q(label)}) then nullif(regexp_replace({rest}, '(?i)^(?:on|is)\\s+', ''), '') end")
    return "coalesce(" + ", ".join([*parts, squash(x)]) + ")"


def sentence(x: str, fits) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: {clean('s')}), lambda s: s <> '' and {fits('lower(s)')})"
    whole = clean(x)
    return f"coalesce({parts}[1], case when {whole} <> '' and {fits(f'lower({whole})')} then {whole} end)"


def is_header(x: str) -> str:
    low = f"rtrim(lower({x}), ':')"
    short = f"({words(x)} <= 6 and not contains({x}, ':') and not {has_date(x)} and not {has_money(x)} and not {rx(x, '[.!?]')} and {any_of(low, V.HEADER_WORDS)})"
    return f"({rx(x, ':$')} or {low} in ({', '.join(map(q, V.HEADER_LABELS))}) or {short})"


def weighted(x: str, patterns, times: int = 1) -> str:
    return "(" + " + ".join(f"(case when {rx(x, p)} then {w * times} else 0 end)" for p, w in patterns) + ")"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def plus(*pairs) -> str:
    return "(" + " + ".join(f"(case when {c} then {n} else 0 end)" for c, n in pairs) + ")"


# ---- predicates on lower-cased lines ----
def noise(x: str) -> str:
    return f"({any_of(x, V.DEADLINE_REJECTED)} or ({any_of(x, V.DEADLINE_EVENTS)} and {has_date(x)}))"


def tests(x: str) -> str:
    return rx(x, r"\b(?:" + "|".join(V.ENGLISH_TESTS) + r")\b")


def english_line(x: str) -> str:
    context = f"({any_of(x, ['english', 'language', 'proficiency'])} and {any_of(x, ['requirement', 'medium of instruction', 'taught in english', 'exempt'])})"
    medium = f"(not contains({x}, 'medium of instruction') or {any_of(x, ['requirement', 'exempt', 'waiv', 'proof', 'satisfy', 'accepted'])})"
    return f"(not {any_of(x, V.OPENING)} and ({any_of(x, V.ENGLISH_LABELS)} or {tests(x)} or ({context} and {medium})))"


def looks_english(x: str) -> str:
    return f"({tests(x)} or {any_of(x, V.ENGLISH_SIGNALS)} or ({any_of(x, V.INSTRUCTION)} and {any_of(x, ['english', 'language', 'requirement', 'satisfy', 'exempt', 'waiv'])}))"


def academic_line(x: str) -> str:
    has = any_of(x, V.ACADEMIC_CONTENT)
    return f"(not ({looks_english(x)} and not {has}) and ({any_of(x, V.ACADEMIC_LABELS)} or ({has} and {any_of(x, V.ACADEMIC_CONTEXT)})))"


CAPTURES = S.captures_sql("duck")
LINES = f"""cap as ({CAPTURES}),
 raw as (select source_url, unnest(string_split(concat(page_title, chr(10), body_text), chr(10))) as r, generate_subscripts(string_split(concat(page_title, chr(10), body_text), chr(10)), 1) as pos from cap),
 lines as (select source_url, cast(row_number() over (partition by source_url order by pos) - 1 as int) as idx, {squash('r')} as line from raw where {squash('r')} <> '')"""
HEADS = f"{LINES}, heads as (select *, {is_header('line')} as is_header from lines)"
SNIPS = f"""{HEADS},
 around as (select *, lead(line, 1) over w as n1, lead(line, 2) over w as n2, lead(line, 3) over w as n3, lead(is_header, 1) over w as h1, lead(is_header, 2) over w as h2, lead(is_header, 3) over w as h3,
                   lag(line, 1) over w as b1, lag(line, 2) over w as b2 from heads window w as (partition by source_url order by idx)),
 snips as (select source_url, idx, line, is_header, b1, b2, n1, case when is_header and n1 is not null and not h1
             then {squash("concat_ws(' ', line, n1, case when not h2 then n2 end, case when not h2 and not h3 then n3 end)")} else line end as snippet from around)"""


def best_text(value: str, score: str, gate: str, name: str) -> str:
    """Per page the best candidate text; pages without one keep a null."""
    return f"""with {SNIPS}, v as (select source_url, snippet, line, b1, b2, n1, lower(snippet) as low, {value} as value from snips),
      c as (select source_url, value, {score} as score from v where {gate} and value is not null),
      best as (select source_url, value, row_number() over (partition by source_url order by score desc, length(value) desc, value) as rn from c where score > 0)
      select cap.source_url, best.value as {name} from cap left join best on best.source_url = cap.source_url and rn = 1"""


def deadline() -> str:
    window = "lower(concat_ws(' ', b2, b1, line))"
    line = "lower(line)"
    candidate = f"({any_of(line, V.DEADLINE_LABELS)} or (contains({line}, 'round') and {has_date(line)}) or ({has_date('low')} and {any_of(window, V.DEADLINE_CONTEXT)}))"
    other = clean(strip_label("snippet", V.DEADLINE_LABELS))
    value = f"coalesce({date('snippet')}, {other})"
    fits = f"({has_date('snippet')} or (value <> '' and not {any_of('lower(value)', V.OPENING)} and not {noise('lower(value)')} and not contains(value, '?') and not contains(lower(value), 'http')))"
    score = f"case when {has_date('snippet')} then 10 + {plus((any_of('low', V.DEADLINE_LABELS), 4), ("contains(low, 'round')", 2))} else 4 + {plus((any_of('low', V.DEADLINE_LABELS), 2))} end"
    return best_text(value, score, f"not {any_of('low', V.OPENING)} and not {noise('low')} and {candidate} and {fits}", "deadline")


def tuition() -> str:
    text = clean(strip_label("snippet", V.TUITION_LABELS))
    value = f"case when {has_money(text)} then case when {any_of(f'lower({text})', ['full time', 'part-time', 'part time', 'full-time'])} then {clean(first(text, V.CURRENCY))} else {text} end end"
    is_line = f"(not {any_of('low', V.TUITION_REJECTED)} and ({any_of('low', V.TUITION_LABELS)} or ({has_money('low')} and {any_of('low', V.TUITION_CONTEXT)})))"
    most, low = f"list_max({amounts('value')})", "lower(value)"
    none = f"({any_of(low, V.TUITION_REJECTED)} or {is_header('value')} or contains({low}, 'announced every year') or {most} is null or {most} < 50000 or not {any_of(f'concat({low}, {q(chr(32))}, low)', V.TUITION_SCORED)})"
    points = plus(
        (f"contains({low}, 'tuition fee')", 5), (any_of(low, ["programme fee", "program fee"]), 5), (any_of(low, ["local students", "non local students"]), 5),
        (any_of(low, ["students admitted", "payable", "instalment", "installment"]), 2), (f"{most} >= 100000", 8), (f"{most} >= 300000", 6),
    )
    return best_text(value, f"case when {none} then 0 else 10 + {points} + length(value) end", is_line, "tuition")


def english() -> str:
    value = sentence(clean(strip_label("snippet", V.ENGLISH_LABELS)), english_line)
    low = "lower(value)"
    points = plus((tests(low), 10), (any_of(low, V.ENGLISH_SIGNALS), 8), (any_of(low, V.INSTRUCTION), 2))
    answered = f"({rx(low, r'\b(?:ielts|toefl|pte|duolingo)\b\s*\d')} or {any_of(low, ['expected to satisfy', 'must satisfy', 'required to satisfy', 'shall satisfy', 'exempt', 'waiv'])})"
    asks = f"(contains({low}, '?') and not {answered} and ({rx(low, '^(?:' + '|'.join(V.QUESTIONS) + ')')} or {rx(low, r'\?$')}))"
    medium = f"(contains({low}, 'medium of instruction') and not {any_of(low, ['exempt', 'waiv', 'proof', 'satisfy', 'accepted', 'requirement'])})"
    none = f"({asks} or {is_header('value')} or not {english_line(low)} or {medium} or ({words('value')} < 5 and {points} < 10))"
    return best_text(value, f"case when {none} then 0 else {points} + length(value) end", english_line("low"), "english_requirement")


def duration() -> str:
    bare = lambda x: f"regexp_replace({clean(x)}, '(?i)^(?:normative\\s+study\\s+)?duration[:\\-\\s]*', '')"
    near, wide = squash("concat_ws(' ', b1, line, n1)"), "concat_ws(chr(10), low, lower(near))"
    modes = ["full-time", "part-time", "full time", "part time"]
    label = any_of(wide, V.DURATION_LABELS)
    gate = f"(({label} or ({rx(wide, V.UNITS)} and {any_of(wide, modes)})) and not ({any_of('low', V.DURATION_NOISE)} and not {label}))"
    cuts = [bare(clean(strip_label("snippet", V.DURATION_LABELS))), bare("near"), *(bare(clean(first("snippet", x))) for x in V.DURATIONS)]

    def value(i: int) -> str:
        found = clean(first(f"d{i}", V.UNITS + r"(?:\s*\([^)]{1,40}\))?"))
        return f"case when contains(d{i}, '/') and {any_of(f'lower(d{i})', ['full', 'part'])} then d{i} else coalesce({found}, d{i}) end as e{i}"

    both = "(contains(lower(e0), 'full-time') and contains(lower(e0), 'part-time'))"
    points = [f"18 + length(e0) + {plus(('contains(e0, chr(47))', 4), (both, 4))}", f"14 + length(e1) + {plus(('is_label', 4), ('is_mode', 3))}"]
    points += [f"5 + length(e{i}) + {plus((rx(f'e{i}', '^[0-9]'), 3), ('contains(low, ' + q('duration') + ')', 8), (any_of('low', ['full-time', 'part-time']), 4))}" for i in range(2, len(cuts))]
    fits = [f"e{i} is not null" + (f" and {rx(f'e{i}', '(?i)' + V.UNITS)}" if i < 2 else "") for i in range(len(cuts))]
    each = " union all ".join(f"select source_url, e{i} as value, {points[i]} as score from e where {fits[i]}" for i in range(len(cuts)))
    return f"""with {SNIPS}, w as (select source_url, snippet, lower(snippet) as low, {near} as near from snips),
      d as (select source_url, low, {label} as is_label, {any_of(wide, modes)} as is_mode, {", ".join(f"{x} as d{i}" for i, x in enumerate(cuts))} from w where {gate}),
      e as materialized (select source_url, low, is_label, is_mode, {", ".join(value(i) for i in range(len(cuts)))} from d), c as ({each}),
      best as (select source_url, value, row_number() over (partition by source_url order by score desc, length(value) desc, value) as rn from c)
      select cap.source_url, best.value as duration from cap left join best on best.source_url = cap.source_url and rn = 1"""


ACADEMIC_VALUE = sentence(f"coalesce(trim({first(clean(strip_label('snippet', V.ACADEMIC_LABELS)), r'\b(?:Applicants?|Candidates?)\b(?s:.*)')}), {clean(strip_label('snippet', V.ACADEMIC_LABELS))})", academic_line)


def academic() -> str:
    low = "lower(value)"
    points = plus((any_of(low, ["bachelor", "degree"]), 8), (any_of(low, V.ACADEMIC_COURSES), 10), (f"contains({low}, 'equivalent qualification')", 4), (any_of(low, V.ACADEMIC_PEOPLE), 4))
    none = f"({looks_english(low)} or not {any_of(low, V.ACADEMIC_CONTENT)})"
    return best_text(ACADEMIC_VALUE, f"case when {none} then 0 else {points} + length(value) end", academic_line("low"), "academic_requirement")


def _first_by_order(patterns: list[str], tidy, fits, limit: int, name: str) -> str:
    pieces = ", ".join(f"case when {fits(tidy(first('line', p)))} then {tidy(first('line', p))} end" for p in patterns)
    return f"""with {LINES}, c as (select source_url, idx, coalesce({pieces}) as value from lines where idx < {limit}),
      best as (select source_url, arg_min(value, idx) as value from c where value is not null group by source_url)
      select cap.source_url, best.value as {name} from cap left join best using (source_url)"""


def program_name() -> str:
    tidy = lambda x: f"rtrim(regexp_extract({squash(x)}, '(?i)^(.*?)(?:\\b(?:admissions?|overview|programme|program)\\b|$)', 1), ' -|:')"
    return _first_by_order(V.PROGRAM_NAMES, tidy, lambda x: f"{x} is not null", 10, "program_name")


def department() -> str:
    def tidy(x):
        cut = f"trim(regexp_extract({clean(x)}, '(?i)^(.*?)(?:\\b(?:is|are|was|were)\\b|$)', 1), ' -|:;,.')"
        return f"(case when {words(cut)} > 14 then '' else {cut} end)"

    return _first_by_order(V.DEPARTMENTS, tidy, lambda x: f"{words(x)} >= 3", 120, "department")


def keywords() -> str:
    """Without the academic part, which a page of these captures holds in a context snippet anyway."""
    ctx = ", ".join(f"arg_min(case when contains(lower(line), {q(k)}) then snippet end, case when contains(lower(line), {q(k)}) then idx end) as k{i}" for i, k in enumerate(V.PREREQUISITE_CONTEXT))
    text = "concat_ws(' ', " + ", ".join(f"k{i}" for i in range(len(V.PREREQUISITE_CONTEXT))) + ", academic_requirement)"
    items = ", ".join(
        f"case when {rx('regexp_replace(t, ' + q('(?i)linear algebra') + ', ' + q('linear_algebra') + ', ' + q('g') + ')', r'(?i)\balgebra\b')} then 'algebra' end" if k == "algebra" else f"case when {rx('t', '(?i)' + p)} then {q(k)} end"
        for k, p in V.PREREQUISITES
    )
    return f"""with {SNIPS}, ctx as (select source_url, {ctx} from snips group by source_url),
      ac as ({academic()}), t as (select source_url, {text} as t from ctx left join ac using (source_url))
      select source_url, array_to_string(list_filter([{items}], lambda x: x is not null), ',') as keywords from t"""


def foundations() -> str:
    # word-bounded patterns without look-behind hold as they stand
    flags = ", ".join(f"bool_or({rx('line', '(?i)' + p)}) as foundation_{k}" for k, p in V.FOUNDATIONS.items())
    return f"with {LINES} select source_url, {flags} from lines group by source_url"


def link_score(a: str, u: str) -> str:
    both = f"trim(concat({a}, ' ', {u}))"
    any_rx = lambda ps: rx(both, "|".join(f"(?:{p})" for p in ps))
    adm, dec, fee, eng, faq = map(any_rx, (V.TOPIC_ADMISSIONS, V.TOPIC_DECISION, V.TOPIC_FEES, V.TOPIC_ENGLISH, V.TOPIC_FAQ))
    topic = f"({adm} or {fee} or {eng})"
    bonus = plus((f"({adm} and {dec})", 3), (fee, 3), (eng, 2), (f"({faq} and {topic})", 1), (f"({any_rx([p for p, _ in V.LINK_NEGATIVE])} and not {topic})", -2))
    return f"({weighted(a, V.LINK_POSITIVE, 2)} - {weighted(a, V.LINK_NEGATIVE, 2)} + {weighted(u, V.LINK_POSITIVE)} - {weighted(u, V.LINK_NEGATIVE)} + {bonus})"


LINK_WORDS = f"select *, {plain('anchor_text')} as a, {plain('url')} as u from ({S.links_sql('duck')}) l"
LINK_SCORES = f"select from_url, pos, anchor_text, url, {link_score('a', 'u')} as score from ({LINK_WORDS}) w"


def follow_up_score(fields: list[str]) -> str:
    """Over a and u, the plain words of a link's anchor text and URL."""
    patterns = [*(p for f in fields for p in V.FOLLOW_UP[f]), *V.FOLLOW_UP_SHARED]
    both = "trim(concat(a, ' ', u))"
    found = rx(both, "|".join(f"(?:{p})" for p, _ in patterns))
    score = f"{weighted('a', patterns, 2)} + {weighted('u', patterns)} + least(greatest({link_score('a', 'u')}, 0), 6) - {weighted('a', V.LINK_NEGATIVE, 2)} - {weighted('u', V.LINK_NEGATIVE)}"
    return f"case when {found} then {score} else 0 end"


def follow_up_scores(fields: list[str]) -> str:
    return f"select from_url, pos, anchor_text, url, {follow_up_score(fields)} as score from ({LINK_WORDS}) w"


def ranked(scores: str, k: int) -> str:
    return f"""select from_url, pos, url, score, rank, score > 0 and rank <= {k} as selected from
      (select *, cast(row_number() over (partition by from_url order by score desc, length(url), url, lower(anchor_text), pos) as int) as rank from ({scores}) s) r"""


# ---- programmes ----
EXTRACTS = S.extracts_sql("duck")


def has(c: str) -> str:
    return f"coalesce({c} <> '', false)"


COMPLETE = plus(*((has(f), n) for f, n in {"program_name": 2, "department": 1, "duration": 1, "deadline": 2, "tuition": 2, "english_requirement": 2, "academic_requirement": 2}.items()))
COMPLETE = f"({COMPLETE} + least(len(prerequisite_keywords), 3) + cast(foundation_statistics as int) + cast(foundation_programming as int) + cast(foundation_mathematics as int))"
PAGE_TEXT = "concat(page_title, ' ', source_url)"
HINTED = f"select *, {plain(PAGE_TEXT)} as hint, {COMPLETE} as completeness from ({EXTRACTS}) e"


def hint_score(field: str) -> str:
    return plus(*((f"contains(hint, {q(k)})", w) for k, w in V.HINTS[field]))


def eligible(field: str, v: str) -> str:
    low = f"lower({v})"
    dated = f"({rx(v, rf'(?i)\b{V.MONTH}\b')} and {rx(v, V.YEAR)})"
    rules = {
        "deadline": f"not {rx(low, '|'.join(V.DEADLINE_VALUE_REJECTED))} and (not contains({low}, 'http') or {dated}) and ({dated} or {rx(v, '(?i)' + '|'.join(f'(?:{p})' for p in V.DEADLINE_VALUE_ACCEPTED))})",
        "department": f"{any_of(low, ['department', 'school', 'faculty', 'college', 'institute'])} and {words(v)} >= 3",
        "duration": f"({rx(low, V.UNITS)} or ({any_of(low, ['full-time', 'part-time'])} and {any_of(low, ['year', 'month'])}))",
        "tuition": f"{has_money(v)} and not {rx(low, '|'.join(V.TUITION_VALUE_REJECTED))} and coalesce(list_max({amounts(v)}), 50000) >= 50000",
    }
    return f"coalesce({squash(v)} <> '' and {rules.get(field, 'true')}, false)"


def specificity(field: str, v: str) -> str:
    n, w = f"length({v})", words(v)
    rules = {
        "program_name": f"{plus((rx(v, V.PROGRAM_WORD), 20))} + {w} + {n}",
        "department": f"{plus((any_of(f'lower({v})', ['department', 'school', 'faculty', 'college']), 20))} + {w} + {n}",
        "duration": f"{plus((rx(v, r'(?i)\byears?\b|\bmonths?\b'), 20))} + {w} + {n}",
        "deadline": f"{plus((rx(v, V.YEAR), 20), (rx(v, rf'(?i)\b{V.MONTH}\b'), 10))} + {n}",
        "tuition": f"{plus((has_money(v), 20))} + length(regexp_replace({v}, '[^0-9]', '', 'g')) + {n}",
    }
    return rules.get(field, f"{w} * 2 + {n}")


def candidates(hinted: str = HINTED) -> str:
    parts = [
        f"select program_code, source_url, completeness, {q(f)} as field, {f} as value, {hint_score(f)} as hint_score, {eligible(f, f)} as eligible, case when {eligible(f, f)} then {specificity(f, f)} else 0 end as specificity from h"
        for f in V.AGGREGATED_FIELDS
    ]
    return f"with h as ({hinted}), c as ({' union all '.join(parts)}) select *, eligible and row_number() over (partition by program_code, field order by eligible desc, case when field = 'program_name' then specificity else hint_score end desc, case when field = 'program_name' then hint_score else specificity end desc, completeness desc, length(value) desc nulls last, source_url, value) = 1 as selected from c"


def keyword_merge(hinted: str = HINTED) -> str:
    return f"""with h as ({hinted}),
      each as (select program_code, source_url, -{hint_score('prerequisite_keywords')} as hs, -completeness as cs, unnest(prerequisite_keywords) as keyword, generate_subscripts(prerequisite_keywords, 1) as pos from h),
      firsts as (select *, row_number() over (partition by program_code, keyword order by hs, cs, source_url, pos) as rn from each)
      select program_code, string_agg(keyword, ',' order by hs, cs, source_url, pos) as keywords, count(distinct source_url) as n_sources from firsts where rn = 1 group by program_code"""


def foundation_merge(hinted: str = HINTED) -> str:
    flags = ["foundation_statistics", "foundation_programming", "foundation_mathematics"]
    at = [f"min(case when {f} then {{'h': hs, 'c': cs, 'u': source_url}} end) as s{i}" for i, f in enumerate(flags)]
    return f"""with h as (select *, -{hint_score('academic_requirement')} as hs, -completeness as cs from ({hinted}) x),
      g as (select program_code, {', '.join(f'bool_or({f}) as {f}' for f in flags)}, {', '.join(at)} from h group by program_code)
      select program_code, {', '.join(flags)}, cast(len(list_distinct(list_filter([s0.u, s1.u, s2.u], lambda x: x is not null))) as int) as n_sources from g"""


def best_page(hinted: str = HINTED) -> str:
    return f"""select program_code, source_url, page_title, completeness from (select *, row_number() over (partition by program_code order by completeness desc, {has('department')} desc, {has('duration')} desc, {has('deadline')} desc,
   {has('tuition')} desc, {has('english_requirement')} desc, {has('academic_requirement')} desc, len(prerequisite_keywords) desc, {has('program_name')} desc, source_url) as rn from ({hinted}) h) r where rn = 1"""


def chosen(hinted: str = HINTED) -> str:
    fields = ", ".join(f"max(case when field = {q(f)} then value end) as {f}, max(case when field = {q(f)} then source_url end) as {f}_source" for f in V.AGGREGATED_FIELDS)
    return f"select program_code, {fields} from ({candidates(hinted)}) c where selected group by program_code"


BEST_PAGE, CHOSEN = best_page(), chosen()

# ---- evaluation ----
GOLD = S.gold_sql("duck")


def tidy(v: str) -> str:
    return f"regexp_replace({squash(v)}, '\\s+([,.;:])', '\\1', 'g')"


def norm(v: str) -> str:
    return f"replace(lower(nullif(trim({tidy(v)}), '')), 'ß', 'ss')"


def norm_field(field: str, v: str) -> str:
    if field == "program_name":
        return norm(f"regexp_replace({tidy(v)}, '\\s*\\(([A-Z][A-Z0-9&/\\-]{{1,15}})\\)\\s*$', '')")
    if field == "deadline":
        a = f"regexp_replace({tidy(v)}, {q(rf'(?i)\b({V.MONTH})\s+0([1-9])(,\s*\d{{4}}\b)')}, '\\1 \\2\\3', 'g')"
        return norm(f"regexp_replace({a}, {q(rf'(?i)\b0([1-9])\s+({V.MONTH})(\s+\d{{4}}\b)')}, '\\1 \\2\\3', 'g')")
    return norm(v)


def scalar_status() -> str:
    parts = []
    for f in V.SCALAR_FIELDS:
        equal = f"{norm_field(f, 'r.' + f)} = {norm_field(f, 'g.' + f)}"
        if f == "tuition":
            ga, ea = amounts("lower(g.tuition)"), amounts("lower(r.tuition)")
            equal = f"({equal} or (len({ga}) > 0 and len(list_filter({ga}, lambda x: not list_contains({ea}, x))) = 0))"
        parts.append(
            f"select g.program_code, {q(f)} as field, case when {norm_field(f, 'g.' + f)} is null and label_status <> 'completed' then 'skipped_due_to_missing_gold_truth' when {norm_field(f, 'g.' + f)} is null and {norm_field(f, 'r.' + f)} is null then 'expected_null' "
            f"when {norm_field(f, 'g.' + f)} is null then 'extraction_error' when {norm_field(f, 'r.' + f)} is null then {q('field_left_null' if f in ('deadline', 'tuition') else 'missing_source_coverage')} when coalesce({equal}, false) then 'matched' else 'extraction_error' end as status from g join r using (program_code)"
        )
    return f"with g as ({GOLD}), r as ({CHOSEN}) " + " union all ".join(parts)


# ---- records, exports, drafts and summaries ----
def records(hinted: str = HINTED) -> str:
    keywords = f"select program_code, string_split(keywords, ',') as prerequisite_keywords from ({keyword_merge(hinted)}) k"
    return f"""select b.program_code, b.source_url, b.page_title, b.completeness, {", ".join(f"c.{f}, c.{f}_source" for f in V.AGGREGATED_FIELDS)}, coalesce(k.prerequisite_keywords, []) as prerequisite_keywords,
   m.foundation_statistics, m.foundation_programming, m.foundation_mathematics
   from ({best_page(hinted)}) b left join ({chosen(hinted)}) c using (program_code) left join ({keywords}) k using (program_code) left join ({foundation_merge(hinted)}) m using (program_code)"""


RECORDS = records()


def flag_text(c: str) -> str:
    return f"case when coalesce({c}, false) then 'True' else 'False' end"


EXPORT_ROWS = f"""select 'UNI' as university, program_code, coalesce(nullif(program_name, ''), 'Unnamed') as program_name, coalesce(department, '') as department, coalesce(duration, '') as duration,
   coalesce(tuition, '') as tuition, coalesce(deadline, '') as deadline, coalesce(english_requirement, '') as language_requirement, coalesce(academic_requirement, '') as background_requirement,
   {flag_text("foundation_statistics")} as mentions_statistics_foundation, {flag_text("foundation_programming")} as mentions_programming_foundation, {flag_text("foundation_mathematics")} as mentions_math_foundation,
   array_to_string(prerequisite_keywords, '; ') as prerequisite_keywords, coalesce(source_url, '') as source_url, coalesce(page_title, '') as page_title from ({RECORDS}) r"""

GOLD_DRAFT = f"""select program_code, 'UNI' as university, 'official_seed' as mode, 'manual_template_pending' as label_status, {", ".join(V.SCALAR_FIELDS)}, array_to_string(prerequisite_keywords, ',') as prerequisite_keywords from ({RECORDS}) r"""

#: Both sides as sorted lists of normal forms; the label of every programme has the same three keywords.
KEYWORD_STATUS = f"""select program_code, case when len(e) = 0 then 'missing_source_coverage' when e = g then 'matched' else 'extraction_error' end as status, len(e) as n_e, len(g) as n_g, cast(len(list_intersect(e, g)) as double) as n_both
   from (select program_code, list_sort(list_distinct(list_transform(prerequisite_keywords, lambda x: {norm("x")}))) as e, ['linear algebra', 'python', 'statistics'] as g from ({RECORDS}) r) x"""
KEYWORD_SCORES = f"""select program_code, status, round(case when n_e > 0 then n_both / n_e else 0.0 end, 6) as precision, round(case when n_e > 0 then n_both / n_g else 0.0 end, 6) as recall,
   round(case when n_e > 0 then 2 * n_both / (n_e + n_g) else 0.0 end, 6) as f1 from ({KEYWORD_STATUS}) k"""


def summary() -> str:
    scalar = " union all ".join(f"select program_code, {i} as place, {q(f)} as field, {norm('g.' + f)} is not null as has_gold, {norm('r.' + f)} is not null as has_extracted from g join r using (program_code)" for i, f in enumerate(V.EVALUATED_FIELDS) if f in V.SCALAR_FIELDS)
    names = lambda c: f"coalesce(string_agg(field, ',' order by place) filter ({c}), '')"
    rate = lambda x: f"case when label_status = 'completed' and required > 0 then round({x} / required, 6) end"
    return f"""with g as materialized ({GOLD}), r as materialized ({RECORDS}), st as materialized ({scalar_status()}), h as ({scalar}),
      each as (select h.*, st.status, case when st.status in ('matched', 'expected_null') then 1.0 else 0.0 end as score from h join st using (program_code, field)
        union all select program_code, {V.EVALUATED_FIELDS.index("prerequisite_keywords")}, 'prerequisite_keywords', true, n_e > 0, status, case when n_e > 0 then 2 * n_both / (n_e + n_g) else 0.0 end from ({KEYWORD_STATUS}) k),
      a as (select program_code, count(*) filter (has_gold) as required, count(*) filter (has_gold and has_extracted) as covered, count(*) filter (has_gold and status in ('matched', 'expected_null')) as matched,
        count(*) filter (has_extracted) as populated, sum(score) filter (has_gold) as total, {names("has_gold")} as scored_fields, {names("status in ('field_left_null', 'missing_source_coverage')")} as missing_fields,
        {names("status = 'skipped_due_to_missing_gold_truth'")} as skipped_fields from each group by program_code)
      select program_code, case when label_status <> 'completed' and required = 0 then 'skipped_due_to_incomplete_gold_label' when label_status <> 'completed' then 'incomplete_gold_label' when required = 0 then 'score_not_meaningful' else 'completed' end as benchmark_status,
        required, covered, matched, populated, {rate("total")} as overall_field_score, {rate("covered")} as field_coverage_rate, {rate("matched")} as exact_match_rate, scored_fields, missing_fields, skipped_fields
      from a join g using (program_code)"""


def query_scores(asked: list[str]) -> str:
    pieces = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    stops = "['master', 'science', 'of', 'in', 'for', 'and', 'data', 'driven']"
    return f"""with q as (select query, {squash("lower(query)")} as nq, list_distinct({pieces("query")}) as qt from (values {", ".join(f"({q(a)})" for a in asked)}) v(query) where {squash("query")} <> ''),
      p as (select distinct program_code, concat('Master of Science in Data Analytics ', program_code) as program_name from ({EXTRACTS}) e),
      n as (select *, {pieces("program_name")} as toks from p),
      a as (select *, coalesce(array_to_string(list_transform(list_filter(toks, lambda t, i: list_position(toks, t) = i and not list_contains({stops}, t)), lambda t: t[1]), ''), '') as short from n),
      t as (select *, list_distinct(list_concat({pieces("concat_ws(' ', 'UNI', program_code, program_name)")}, {pieces("replace(program_code, '_', ' ')")}, case when short <> '' then [short] else [] end)) as own from a)
      select query, program_code, cast({plus((f"nq = {squash('lower(program_code)')}", 40), (f"nq = {squash("lower(concat_ws(' ', 'UNI', program_name))")}", 40), ("short <> '' and list_contains(qt, short)", 20), ("list_contains(qt, 'uni')", 20), ("len(qt) > 0 and len(list_intersect(qt, own)) = len(qt)", 12))}
        + 8 * len(list_intersect(qt, own)) as int) as score from t, q"""
