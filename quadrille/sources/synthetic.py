"""Captures, extracts, links and labels made from the order tables, by one SQL text for two engines.

The driver's tables hold no admissions pages; these queries write such pages with plain string
functions. `spark_sql` and `duck_sql` fill in the few functions whose names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"money": "format_number(cast(floor({}) as bigint), 0)", "day": "date_format({}, 'MMMM d, yyyy')", "iso": "date_format({}, 'yyyy-MM-dd')", "arr": "array({})", "nl": "'\\n'", "text": "string", "hint": "/*+ shuffle_hash(customer) */ "},
    "duck": {"money": "format('{{:,}}', cast(floor({}) as bigint))", "day": "strftime({}, '%B %-d, %Y')", "iso": "strftime({}, '%Y-%m-%d')", "arr": "[{}]", "nl": "chr(10)", "text": "varchar", "hint": ""},
}


def _base(d: dict) -> str:
    # Customers are met by hash: a sort join holds the orders of a partition in memory, this one its customers, a tenth as many and each once.
    return f"""
      select {d['hint']}concat('P', cast(o_custkey as {d['text']})) as program_code, o_orderkey as k, cast(o_orderkey % 4 as int) as m4, cast(o_orderkey % 7 as int) as m7,
             concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) as seg,
             concat('https://', lower(replace(n_name, '_', '')), '.example.edu') as site,
             {d['money'].format('o_totalprice')} as money, o_totalprice as price, {d['day'].format('o_orderdate')} as day, {d['iso'].format('o_orderdate')} as iso
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


def captures_sql(engine: str) -> str:
    """(program_code, source_url, page_title, body_text): one page for each order."""
    d = DIALECTS[engine]
    nl = d["nl"]
    return f"""
    select program_code,
           concat(site, case m4 when 0 then '/overview/' when 1 then '/admissions/' when 2 then '/fees/' else '/english-faq/' end, cast(k as {d['text']})) as source_url,
           case m4 when 0 then concat('Master of Science in ', seg, ' Analytics - Programme Information') when 1 then 'Admissions and key facts' when 2 then 'Tuition fee and payment' else 'English FAQ' end as page_title,
           case m4
             when 0 then concat('Welcome to our site', {nl}, 'Department of ', seg, ' and Decision Studies is a leading unit', {nl},
                case when m7 < 3 then 'Duration: 1.5 years (full-time) / 3 years (part-time)' when m7 < 5 then 'Duration: 2 years' else 'Study anywhere' end, {nl}, 'Campus  news', {nl}, 'Read more at ', site, '/news.')
             when 1 then concat('Application deadline: ', day, {nl},
                case when m7 < 2 then 'Applications open on September 1, 2025' when m7 < 4 then concat('Closing date ', iso) else 'Contact us' end, {nl},
                'Admission requirements', {nl}, 'Applicants should hold a bachelor degree with subjects in ',
                case when m7 < 3 then 'statistics, linear algebra and programming' when m7 < 5 then 'calculus and python' else 'mathematics' end, '.', {nl}, 'Campus news')
             when 2 then concat(case when m7 < 5 then concat('Tuition fee: HK$', money, ' for local students') else concat('The programme costs HK$', money, ' in total') end, {nl}, 'Campus news', {nl}, 'Application fee: HK$300', {nl}, 'Payment information')
             else concat('Do I need to take a test?', {nl}, case when m7 < 4 then 'English requirement: IELTS 6.5 or TOEFL 80 is accepted.' else 'All courses are taught in English.' end, {nl}, 'Knowledge of machine learning is welcome')
           end as body_text
    from ({_base(d)}) b"""


def extracts_sql(engine: str) -> str:
    """(program_code, source_url, page_title, fields, flags): pages that are already extracted, with gaps and junk."""
    d = DIALECTS[engine]
    arr = d["arr"].format
    return f"""
    select program_code,
           concat(site, case m4 when 0 then '/overview/' when 1 then '/admissions/' when 2 then '/fees/' else '/english-faq/' end, cast(k as {d['text']})) as source_url,
           case m4 when 0 then 'Programme overview' when 1 then 'Admission requirements' when 2 then 'Programme fee' else 'English FAQ' end as page_title,
           case when m7 = 0 then null when m7 < 3 then concat('MSc in ', seg) else concat('Master of Science in ', seg) end as program_name,
           case when m4 = 0 then concat('Department of ', seg, ' Studies') when m7 = 3 then 'School' end as department,
           case when m4 = 0 and m7 < 5 then '1.5 years (full-time)' when m7 = 6 then 'Two semesters' end as duration,
           case when m4 = 1 and m7 < 5 then day when m4 = 1 then 'Please visit our site for details' when m7 = 2 then iso end as deadline,
           case when m4 = 2 and m7 < 5 then concat('HK$', money) when m4 = 2 then 'HK$60,000 with scholarship' end as tuition,
           case when m4 = 3 then 'IELTS 6.5 or TOEFL 80 is accepted.' end as english_requirement,
           case when m4 = 1 then concat('Applicants hold a degree in ', lower(seg), '.') end as academic_requirement,
           case when m7 = 1 then {arr("'statistics', 'python'")} when m7 = 2 then {arr("'python', 'calculus'")} when m7 = 3 then {arr("'calculus', 'statistics', 'programming'")} else {arr("'mathematics'")} end as prerequisite_keywords,
           m7 in (1, 3) as foundation_statistics, m7 in (1, 2, 3) as foundation_programming, m7 not in (1) as foundation_mathematics
    from ({_base(d)}) b"""


def links_sql(engine: str) -> str:
    """(from_url, pos, anchor_text, url): seven links for each customer's site."""
    d = DIALECTS[engine]
    return f"""
    select concat('https://', lower(replace(n_name, '_', '')), '.example.edu/c', cast(c_custkey as {d['text']})) as from_url, cast(p_partkey as int) as pos,
           case cast((c_custkey + p_partkey) % 9 as int) when 0 then 'Admissions' when 1 then 'Apply now' when 2 then 'Tuition and fees' when 3 then 'FAQ' when 4 then 'News' when 5 then 'Contact' when 6 then 'English language requirements' when 7 then 'Application deadlines' else 'Our campus' end as anchor_text,
           concat('https://', lower(replace(n_name, '_', '')), '.example.edu/', case cast((c_custkey * 3 + p_partkey) % 6 as int) when 0 then 'admissions/how-to-apply' when 1 then 'programme-fees' when 2 then 'news/latest' when 3 then 'faq' when 4 then 'english-requirement' else 'about' end, '/', cast(p_partkey as {d['text']})) as url
    from customer join nation on c_nationkey = n_nationkey join part on p_partkey <= 7"""


def raw_links_sql(engine: str) -> str:
    """(from_url, pos, href, text, visible): five anchors for each page, some hidden, elsewhere, or met before."""
    d = DIALECTS[engine]
    key = f"cast(k as {d['text']})"
    return f"""
    select concat(site, case m4 when 0 then '/overview/' when 1 then '/admissions/' when 2 then '/fees/' else '/english-faq/' end, {key}) as from_url, cast(p_partkey as int) as pos,
           case cast(p_partkey as int) when 1 then concat('/apply/', {key}) when 2 then case when m7 < 3 then concat(site, '/news.') else '#top' end when 3 then concat('../help/', {key})
             when 4 then concat('https://other.example.org/', {key}) else concat(' /apply/', {key}, '#again') end as href,
           concat('Link  ', cast(p_partkey as {d['text']})) as text, not (p_partkey = 3 and m4 = 1) as visible
    from ({_base(d)}) b join part on p_partkey <= 5"""


def gold_sql(engine: str) -> str:
    """(program_code, label_status, scalar fields): labels that differ from the extracts in known ways."""
    d = DIALECTS[engine]
    return f"""
    select program_code, case when n % 10 = 0 then 'manual_template_pending' else 'completed' end as label_status,
           case when n % 5 = 0 then null else concat('Master of Science in ', seg, ' (MSC)') end as program_name,
           case when n % 6 = 0 then null else concat(day, ' ') end as deadline,
           case when n % 7 = 0 then null when n % 11 = 0 then 'HKD 70,000' else concat('HKD ', money) end as tuition,
           case when n % 4 = 0 then null else 'IELTS 6.5 or TOEFL 80 is accepted .' end as english_requirement,
           case when n % 3 = 0 then 'Applicants hold a degree.' end as academic_requirement
    from (select *, row_number() over (partition by program_code order by k) as rn, cast(k as bigint) as n from ({_base(d)}) b) x where rn = 1"""


def view(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _run(spark: SparkSession, sf_dir: str, names: list[str], sql: str) -> DataFrame:
    view(spark, sf_dir, names)
    return spark.sql(sql)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["orders", "customer", "nation"], captures_sql("spark"))


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["orders", "customer", "nation"], extracts_sql("spark"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["customer", "nation", "part"], links_sql("spark"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["orders", "customer", "nation"], gold_sql("spark"))


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ["orders", "customer", "nation", "part"], raw_links_sql("spark"))
