"""Whole runs over small page stores, with an extractor of its own: a page's text is a JSON object of its fields."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.functions import values as V
from quadrille.operators import frontier, programs, record_state, runs

FIELDS = ", ".join(f"{f} string" for f in V.AGGREGATED_FIELDS) + ", prerequisite_keywords array<string>, foundation_statistics boolean, foundation_programming boolean, foundation_mathematics boolean"
DEADLINE, TUITION, ENGLISH = "1 December 2025", "HK$300,000", "IELTS 6.5 is required."


def read_json(captures):
    x = F.from_json("body_text", FIELDS)
    out = captures.select("source_url", "page_title", x.alias("x")).select("source_url", "page_title", "x.*")
    lists = {"prerequisite_keywords": F.coalesce("prerequisite_keywords", F.array().cast("array<string>"))}
    return out.withColumns(lists | {f: F.coalesce(f, F.lit(False)) for f in programs.FLAGS})


def store_of(spark, pages):
    """pages: {url: (title, fields)} or {url: (title, fields, url after redirect)}."""
    rows = [(u, p[2] if len(p) > 2 else u, p[0], json.dumps(p[1])) for u, p in pages.items()]
    return spark.createDataFrame(rows, "requested_url string, source_url string, page_title string, body_text string")


def links_of(spark, links):
    """links: {url: [(anchor, url)]}."""
    rows = [(u, i, a, to) for u, found in links.items() for i, (a, to) in enumerate(found)]
    return spark.createDataFrame(rows, "from_url string, pos int, anchor_text string, url string")


def explore(spark, pages, links, seeds=None):
    seeds = seeds or [("r", "https://x.edu/")]
    return runs.explore(spark.createDataFrame(seeds, "run_id string, seed_url string"), store_of(spark, pages), links_of(spark, links), read_json)


def outcome(run, key="r"):
    rows = run.outcomes.where(F.col(run.key) == key).collect()
    assert len(rows) == 1
    return rows[0]


X = "https://x.edu/"


def test_generic_run_without_anything_missing(spark):
    pages = {X: ("Seed", {"program_name": "MSc in AI"}), X + "admissions": ("Admissions", {"deadline": DEADLINE, "english_requirement": ENGLISH}), X + "fees": ("Fees", {"tuition": TUITION})}
    run = explore(spark, pages, {X: [("Admissions", X + "admissions"), ("Tuition fees", X + "fees"), ("News", X + "news"), ("Apply", X + "gone")]}, [("r", X), ("lost", "https://gone.edu/"), ("none", None)])
    r = run.records.collect()
    assert len(r) == 1 and (r[0]["run_id"], r[0]["deadline"], r[0]["tuition"], r[0]["tuition_source"]) == ("r", DEADLINE, TUITION, X + "fees")
    assert outcome(run)["reason"] == "no_missing_high_value_fields"
    assert {(x["run_id"], x["reason"]) for x in run.rejects.collect()} == {("lost", "seed_page_not_fetched"), ("none", "no_seed_url")}
    assert [(p["stage"], p["source_url"]) for p in run.pages.orderBy("position").collect()][0] == ("seed", X) and run.pages.count() == 3
    audit = {c["url"]: c for c in run.candidates.collect()}
    assert audit[X + "gone"]["selected"] and not audit[X + "gone"]["fetched"] and not audit[X + "news"]["eligible"] and run.changes.isEmpty()


def test_follow_up_fills_the_tuition_and_its_source(spark):
    pages = {X: ("Seed", {"program_name": "MSc in AI"}), X + "admissions": ("Admissions", {"deadline": DEADLINE, "english_requirement": ENGLISH}), X + "a/fees": ("Programme fees", {"tuition": TUITION, "program_name": "MSc in Artificial Intelligence and more"})}
    links = {X: [("Admissions", X + "admissions")], X + "admissions": [("Tuition and fees", X + "a/fees"), ("Fees", X + "dead"), ("News", X + "news"), ("Tuition", X)]}
    run = explore(spark, pages, links)
    r, o = run.records.first(), outcome(run)
    assert (r["tuition"], r["tuition_source"], r["program_name_source"]) == (TUITION, X + "a/fees", X + "a/fees")
    assert (o["reason"], o["updated"], o["source_url"], o["fetched"]) == ("fields_supplemented", ["tuition"], X + "admissions", 1)
    changes = {c["field"]: c for c in run.changes.collect()}
    assert changes["tuition"].asDict() == {"run_id": "r", "field": "tuition", "before": None, "before_source": None, "after": TUITION, "source": X + "a/fees", "change": "added"}
    assert changes["program_name"]["change"] == "changed" and changes["program_name"]["before"] == "MSc in AI"
    reasons = {(c["url"]): c["rejection_reason"] for c in run.candidates.where("discovery_stage = 'follow_up'").collect()}
    assert reasons == {X + "a/fees": None, X + "dead": "not_in_follow_up_top_k", X + "news": "irrelevant_to_missing_fields", X: "already_inspected"}
    assert [(p["stage"], p["discovered_from"]) for p in run.pages.orderBy("position").collect()] == [("seed", None), ("primary_candidate", X), ("follow_up_candidate", X + "admissions")]


def test_reasons_of_follow_ups(spark):
    """Eight sites in one plan. The source is the page that gave the deadline; it gives its links, or, if it went to an address that the store has
    no page for, cannot be read again; without an eligible link the seed page is the fallback."""
    cases = {
        "none": [],
        "irrelevant": [("News", "news")],
        "inspected": [("Tuition fees", "admissions")],
        "dead": [("Tuition fees", "dead")],
        "useless": [("Tuition fees", "empty")],
        "filled": [("Tuition fees", "fees")],
        "moved": [("Tuition fees", "fees")],
        "fallback": [("News", "news")],
    }
    pages, links, seeds = {}, {}, []
    for name, found in cases.items():
        base = f"https://{name}.edu/"
        own = base + ("moved/admissions" if name == "moved" else "admissions")
        busy = [("Admissions and application deadlines, tuition fees", base + f"dead/admissions/{i}") for i in range(4)] if name == "fallback" else []
        pages |= {base: ("Seed", {}), base + "admissions": ("Admissions", {"deadline": DEADLINE, "english_requirement": ENGLISH}, own), base + "empty": ("Fees", {}), base + "fees": ("Fees", {"tuition": TUITION})}
        links[base] = [("Apply for admissions", base + "admissions"), *busy, *([("Programme fee", base + "fees")] if busy else [])]
        links[own] = [(a, base + u) for a, u in found]
        seeds.append((name, base))
    seeds.append(("plain", "https://plain.org/"))
    pages["https://plain.org/"] = ("Seed", {})
    run = explore(spark, pages, links, seeds)
    got = {o["run_id"]: (o["reason"], o["fetched"]) for o in run.outcomes.collect()}
    assert got == {
        "none": ("no_follow_up_candidates_matched_missing_fields", 0),  # the seed page has a link, to no fees
        "irrelevant": ("no_follow_up_candidates_matched_missing_fields", 0),
        "inspected": ("all_follow_up_candidates_rejected_by_filtering", 0),
        "dead": ("follow_up_candidates_selected_but_not_fetched", 0),
        "useless": ("follow_up_pages_did_not_fill_missing_fields", 1),
        "filled": ("fields_supplemented", 1),
        "moved": ("no_follow_up_candidates_matched_missing_fields", 0),
        "fallback": ("fields_supplemented", 1),
        "plain": ("no_follow_up_source_page_selected", 0),
    }
    outcomes = {(s["run_id"], s["attempt"]): (s["outcome"], s["candidates"]) for s in run.sources.collect()}
    assert outcomes["moved", 0] == ("source_fetch_failed", 0) and outcomes["none", 0] == ("no_candidates_found", 0)
    assert outcomes["irrelevant", 0] == ("candidates_found_but_all_irrelevant", 1) and outcomes["inspected", 0] == ("all_eligible_candidates_already_inspected", 1)
    assert outcomes["dead", 0] == ("selected_candidates_not_fetched", 1) and outcomes["filled", 0] == ("selected_candidates_fetched", 1)
    assert outcomes["fallback", 1] == ("selected_candidates_fetched", 6)
    assert {r["run_id"]: r["tuition_source"] for r in run.records.collect()}["fallback"] == "https://fallback.edu/fees"


# ---- curated runs ----
SEEDS = "array<struct<page_type:string,url:string,priority:int,intended_fields:array<string>>>"


def curated(spark, targets, pages, links):
    t = spark.createDataFrame([("UNI", code, f"Master of {code}", "core", seeds) for code, seeds in targets], f"university string, program_code string, program_name string, tier string, seed_pages {SEEDS}")
    return runs.curated_run(t, store_of(spark, pages), links_of(spark, links), read_json)


def seed(url, kind="overview", priority=1, intended=("deadline", "tuition")):
    return (kind, url, priority, list(intended))


def test_missing_seed_pages_fail_their_programme_only(spark):
    pages = {X: ("Seed", {"deadline": DEADLINE, "tuition": TUITION}), X + "b": ("B", {})}
    run = curated(spark, [("OK", [seed(X)]), ("BAD", [seed(X + "b"), seed(X + "gone"), seed(X + "gone2")]), ("NONE", [])], pages, {})
    assert [r["program_code"] for r in run.records.collect()] == ["OK"]
    assert sorted(map(tuple, run.rejects.collect()), key=str) == sorted([("BAD", X + "gone", "seed_page_not_fetched"), ("BAD", X + "gone2", "seed_page_not_fetched"), ("NONE", None, "no_seed_pages")], key=str)
    assert outcome(run, "OK")["reason"] == "no_missing_curated_fields" and run.outcomes.count() == 1 and run.candidates.isEmpty()


def test_supplement_takes_two_fields_over_two_hops_and_dead_links(spark):
    dead = [(f"Application deadline {i}", X + f"dead/{i}") for i in range(30)]
    pages = {
        X: ("Overview", {"program_name": "MSc in AI"}),
        X + "apply/deadline": ("Deadlines", {"deadline": DEADLINE}, X + "apply/when"),
        X + "fees/tuition": ("Fees", {"tuition": TUITION}),
        X + "more": ("More", {}),
    }
    links = {X: [*dead, ("Application deadline", X + "apply/deadline"), ("News", X + "news")], X + "apply/when": [("Tuition fee and payment", X + "fees/tuition"), ("Application deadline", X + "dead/0"), ("Overview", X)]}
    run = curated(spark, [("P", [seed(X)])], pages, links)
    r, o = run.records.first(), outcome(run, "P")
    assert (r["deadline"], r["deadline_source"], r["tuition"], r["tuition_source"]) == (DEADLINE, X + "apply/when", TUITION, X + "fees/tuition")
    assert (o["reason"], o["updated"], o["fetched"], o["found"]) == ("fields_supplemented", ["deadline", "tuition"], 2, 35)
    assert (r["source_url"], r["page_title"]) == (X, "Overview")
    audit = {(c["from_url"], c["url"]): c for c in run.candidates.collect()}
    got = audit[X, X + "apply/deadline"]
    assert got["selected"] and got["fetched"] and not got["eligible"] and got["rejection_reason"] is None
    assert audit[X + "apply/when", X]["rejection_reason"] in ("already_inspected", "irrelevant_to_missing_fields")
    tried = [c for c in audit.values() if c["selected"] and not c["fetched"]]
    assert all(c["eligible"] and c["rejection_reason"] is None for c in tried)
    sources = {s["from_url"]: s for s in run.sources.collect()}
    assert sources[X]["outcome"] == "selected_candidates_fetched" and sources[X + "apply/when"]["depth"] == 1
    assert [p["stage"] for p in run.pages.orderBy("position").collect()] == ["official_seed_page"] + ["official_seed_auto_candidate"] * 2


def test_supplement_stops_at_its_budget_and_depth(spark):
    pages, links, targets = {}, {}, []
    for name in ("STAR", "PATH", "DEAD", "NEWS", "NOTHING"):
        base = f"https://{name.lower()}.edu/"
        targets.append((name, [seed(base)]))
        pages[base] = ("Overview", {})
        if name in ("STAR", "PATH"):
            pages |= {base + f"deadline/{i}": (f"Deadline {i}", {}) for i in range(9)}
    links["https://star.edu/"] = [(f"Application deadline {i}", f"https://star.edu/deadline/{i}") for i in range(9)]
    links |= {"https://path.edu/" + (f"deadline/{i}" if i >= 0 else ""): [("Application deadline", f"https://path.edu/deadline/{i + 1}")] for i in range(-1, 8)}
    links["https://dead.edu/"] = [("Application deadline", "https://dead.edu/d"), ("Apply for admission, tuition", "https://dead.edu/e")]
    links["https://news.edu/"] = [("News", "https://news.edu/n")]
    run = curated(spark, targets, pages, links)
    got = {o["program_code"]: (o["reason"], o["fetched"]) for o in run.outcomes.collect()}
    useless = "supplement_pages_did_not_fill_missing_fields"
    assert got == {
        "STAR": (useless, 6), "PATH": (useless, 3),  # pages at depth 3 are not expanded
        "DEAD": ("supplement_candidates_selected_but_not_fetched", 0), "NEWS": ("no_supplement_candidates_matched_missing_fields", 0), "NOTHING": ("no_same_domain_supplement_candidates_found", 0),
    }
    assert run.records.count() == 5


def test_rounds_equal_single_turns_on_random_webs(spark):
    import random

    from quadrille.operators import crawl
    from quadrille.operators.links import with_follow_up_score

    rng = random.Random(9)
    anchors = ["Application deadline", "Tuition fees", "Apply", "News", "FAQ", "Programme fee and payment", "Admissions"]
    targets, webs = [], {}
    store, links = {}, {}
    for p in range(8):
        base = f"https://u{p}.edu/"
        urls = [base + rng.choice(["a", "bb/tuition", "deadline/c"]) + str(i) for i in range(14)]
        for u in [base, *urls]:
            if u == base or rng.random() < 0.5:
                store[u] = (u, {k: v for k, v in (("deadline", DEADLINE), ("tuition", TUITION)) if u != base and rng.random() < 0.15})
            links[u] = [(rng.choice(anchors), v) for v in rng.sample([base, *urls], rng.randint(0, 6))]
        targets.append((f"P{p}", [seed(base)]))
        webs[f"P{p}"] = (base, urls)
    t = spark.createDataFrame([("UNI", code, f"Master of {code}", "core", seeds) for code, seeds in targets], f"university string, program_code string, program_name string, tier string, seed_pages {SEEDS}")
    table = links_of(spark, links)
    seeds = read_json(store_of(spark, {b: store[b] for b, _ in webs.values()}).drop("requested_url")).join(t.select("program_code", F.col("seed_pages")[0]["url"].alias("source_url")), "source_url")
    shelf = read_json(store_of(spark, store)).withColumn("url", F.col("source_url"))
    _, done = frontier.supplement_crawl(t, seeds, table, shelf)
    got = {}
    for r in done.picks.orderBy("program_code", "round").collect():
        got.setdefault(r["program_code"], []).append((r["from_url"], r["url"], r["fetched"]))
    scored = {}
    for missing in (["deadline", "tuition"], ["deadline"], ["tuition"]):
        out = with_follow_up_score(table, F.array(*map(F.lit, missing)))
        out = out.withColumns({"t": F.lower(F.concat_ws(" ", "anchor_text", "url")), "code": F.concat(F.lit("P"), F.regexp_extract("from_url", r"//u(\d+)", 1))})
        extra = crawl.target_boost(F.col("t"), F.lit("UNI"), F.col("code"), F.concat(F.lit("Master of "), "code")) + crawl.missing_boost(F.col("t"), F.array(*map(F.lit, missing)))
        for r in out.withColumn("extra", extra).collect():
            scored[r["code"], tuple(missing), r["from_url"], r["anchor_text"], r["url"]] = (r["score"], r["extra"])
    for code, _ in targets:
        base, urls = webs[code]
        pages = {u: set(store[u][1]) for u in urls if u in store}
        frozen = {}

        class Links(dict):
            def get(self, u, default=None):
                return [(a, v, frozen.setdefault((u, a, v), scored[code, tuple(self.missing), u, a, v][0])) for a, v in links.get(u, [])]

        web = Links()
        web.missing = ["deadline", "tuition"]

        def boost(x, missing):
            web.missing = missing
            return x[5] + scored[code, tuple(missing), x[2], x[3], x[4]][1] - x[0]

        # relevance is frozen with what is missing when a page is expanded, which is after the last pick was read
        want = one_by_one_frozen(base, web, pages, boost)
        assert got.get(code, []) == want, code


def one_by_one_frozen(base, web, pages, boost):
    missing = ["deadline", "tuition"]
    inspected, taken, pool, picks, queue, done, attempt, expanded = {base}, set(), [], [], [(base, 0)], 0, 0, set()
    while done < 6:
        for u, depth in queue:
            if u not in expanded:
                expanded.add(u)
                attempt += 1
                web.missing = missing
                pool += [(depth, attempt, u, a, v, s) for a, v, s in web.get(u)]
        queue = []
        live = [x for x in pool if x[5] > 0 and x[4] not in inspected and x[4] not in taken]
        if not live:
            break
        depth, _, u, a, v, s = min(live, key=lambda x: (-boost(x, missing), -x[5], x[0], len(x[4]), x[4], x[3].lower(), x[1]))
        taken.add(v)
        picks.append((u, v, v in pages))
        if v in pages:
            inspected.add(v)
            done += 1
            missing = [m for m in missing if m not in pages[v]]
            if not missing:
                break
            if depth + 1 < 3:
                queue.append((v, depth + 1))
    return picks


# ---- the record state and the extension point ----
def extracts(spark, n=40):
    import random

    rng = random.Random(4)
    pick = lambda *xs: rng.choice([None, "", *xs])
    rows = []
    for i in range(n):
        page = f"https://x.edu/{rng.choice(['admissions', 'fees', 'faq'])}/{i % 30}"
        rows.append((f"P{i % 4}", page, rng.choice(["Admissions", "Tuition fee", None]), pick("MSc in AI", "Master of AI"), pick("Department of Computer Science", "School"), pick("2 years", "soon"), pick(DEADLINE, "2026-01-05", "please visit us"), pick(TUITION, "HK$80,000", "HK$10"), pick(ENGLISH), pick("A degree."), rng.sample(["python", "calculus", "statistics"], rng.randint(0, 3)), *[rng.random() < 0.4 for _ in range(3)]))
    return spark.createDataFrame(rows, f"program_code string, source_url string, page_title string, {FIELDS}")


def test_states_merge_to_the_state_of_all_in_any_split(spark):
    pages = extracts(spark)
    whole = {r["program_code"]: r for r in programs.aggregate_programs(pages).collect()}
    one = {r["program_code"]: r for r in record_state.records(record_state.record_state(pages)).collect()}
    parts = [record_state.record_state(pages.where(F.pmod(F.xxhash64("source_url"), F.lit(3)) == k)) for k in range(3)]
    merged = {r["program_code"]: r for r in record_state.records(record_state.merge_states(parts[2], record_state.merge_states(*parts[:2]), parts[0])).collect()}
    for code, r in whole.items():
        for name in r.asDict():
            if name not in ("page_title",):
                assert (one[code][name] or None) == (r[name] or None) and merged[code][name] == one[code][name], name
    assert record_state.record_state(pages.limit(0)).count() == 0 and record_state.records(record_state.record_state(pages.limit(0))).count() == 0


def test_changes_between_versions(spark):
    pages = extracts(spark)
    before = record_state.records(record_state.record_state(pages.where("program_code <> 'P3'")))
    after = record_state.records(record_state.record_state(pages.where("program_code <> 'P0'")))
    assert record_state.record_changes(before, before).isEmpty()
    changes = record_state.record_changes(before, after).collect()
    assert {c["change"] for c in changes if c["program_code"] == "P0"} == {"removed"} and {c["change"] for c in changes if c["program_code"] == "P3"} == {"added"}
    assert not [c for c in changes if c["program_code"] in ("P1", "P2")]


def test_an_extractor_must_give_all_fields(spark):
    captures = spark.createDataFrame([("u", "t", "b")], "source_url string, page_title string, body_text string")
    with pytest.raises(TypeError, match="tuition string \\(is missing\\)"):
        runs.extract_with(captures, lambda c: read_json(c).drop("tuition"))
    with pytest.raises(TypeError, match="foundation_statistics boolean \\(is string\\)"):
        runs.extract_with(captures, lambda c: read_json(c).withColumn("foundation_statistics", F.lit("x")))
    assert runs.extract_with(captures, lambda c: read_json(c).withColumn("extra", F.lit(1))).columns == list(runs.EXTRACTED)


def test_a_programme_that_has_ended_is_not_ranked_again(spark, monkeypatch):
    """Each round writes the open links of the programmes that still lack something, and every link is in the audit once."""
    written = []
    monkeypatch.setattr(frontier, "stage", lambda df, name: written.append((name, kept := df.localCheckpoint())) or kept)
    base = lambda p: f"https://{p}.edu/"
    seed = lambda p: {"page_type": "overview", "url": base(p), "priority": 1, "intended_fields": ["deadline", "tuition"]}
    t = spark.createDataFrame([("U", p, "Master of Things", [seed(p)]) for p in ("A", "B")], "university string, program_code string, program_name string, seed_pages array<struct<page_type:string,url:string,priority:int,intended_fields:array<string>>>")
    there = {base("A") + "fees": ("Fees", {"deadline": DEADLINE, "tuition": TUITION}), base("B") + "fees": ("Fees", {"tuition": TUITION}), base("B") + "apply": ("Apply", {"deadline": DEADLINE})}
    links = {base("A"): [("Tuition fees", base("A") + "fees"), ("Apply now", base("A") + "apply"), ("Nothing", base("A") + "x")], base("B"): [("Tuition fees", base("B") + "fees"), ("Apply now", base("B") + "apply")]}
    store = read_json(store_of(spark, there)).withColumn("url", F.col("source_url"))
    seeds = t.select("program_code", F.col("seed_pages")[0]["url"].alias("source_url"), F.lit("Home").alias("page_title"))
    missing = t.select("program_code", F.array(F.lit("deadline"), F.lit("tuition")).alias("missing"))
    done = frontier.run_supplement(t, seeds, missing, links_of(spark, links), store.select("url"), lambda wanted: wanted.join(store, "url"))
    assert {(r["program_code"], r["url"]) for r in done.picks.where("fetched").collect()} == {("A", base("A") + "fees"), ("B", base("B") + "fees"), ("B", base("B") + "apply")}
    ranked = [sorted(r["program_code"] for r in df.collect()) for name, df in written if name == "frontier"][:-1]
    assert ranked[:2] == [["A", "A", "B", "B"], ["B"]] and not any("A" in r for r in ranked[1:])
    assert sorted((r["program_code"], r["url"]) for r in done.candidates.collect()) == sorted((u[8], v) for u, ls in links.items() for _, v in ls)


def test_rounds_do_not_look_up_the_store_again(spark, monkeypatch):
    """Links are marked with whether their page is there before the first round; a page behind two hops is still fetched, a dead link is not."""
    plans, real = [], frontier.stage
    monkeypatch.setattr(frontier, "stage", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df, name))
    targets = spark.createDataFrame([("P", "UNI", "Art", [(X, 1, ["tuition"])])], "program_code string, university string, program_name string, seed_pages array<struct<url:string,priority:int,intended_fields:array<string>>>")
    store = spark.createDataFrame([(X + "fees", X + "fees", "Fees", None), (X + "fees/more", X + "fees/more", "More", TUITION)], "url string, source_url string, page_title string, tuition string").withColumn("deadline", F.lit(None).cast("string"))
    done = frontier.run_supplement(
        targets, spark.createDataFrame([("P", X, "Home")], "program_code string, source_url string, page_title string"), spark.createDataFrame([("P", ["tuition"])], "program_code string, missing array<string>"),
        links_of(spark, {X: [("Tuition fees", X + "dead/tuition"), ("Fees", X + "fees")], X + "fees": [("Tuition", X + "fees/more")]}), store.select(F.col("url").alias("known_url")).withColumnRenamed("known_url", "url"), lambda wanted: wanted.join(store, "url"),
    )
    assert sum("url#" in plan and "known_url" in plan and "known-links" not in plan for plan in plans) == 1
    assert sorted((r["url"], r["fetched"]) for r in done.picks.collect()) == [(X + "dead/tuition", False), (X + "fees", True), (X + "fees/more", True)]


def test_updated_fields_are_the_missing_ones_with_a_new_value(spark):
    versions = [[("a", None, "x", "t"), ("b", "1", "", "t"), ("c", "1", "2", "t")], [("a", "1", "x", "u"), ("b", "1", "2", "t"), ("c", "3", "", "t"), ("d", "4", "5", "t")]]
    before, after = (spark.createDataFrame(v, "program_code string, deadline string, tuition string, other string") for v in versions)
    wanted = spark.createDataFrame([(k, ["tuition", "deadline"]) for k in "abcde"], "program_code string, missing array<string>")
    got = record_state.updated_fields(before, after, wanted, ("deadline", "tuition"))
    assert dict(map(tuple, got.collect())) == {"a": ["deadline"], "b": ["tuition"], "c": ["deadline"], "d": ["tuition", "deadline"], "e": []}
