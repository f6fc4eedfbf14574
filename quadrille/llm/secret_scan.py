"""Secret scans: candidates by pattern, false positives removed by a random forest, DataFrame operations only.

Candidates are unbroken runs of at least 14 letters, digits and + / _ - with a digit, however late
it comes, and values of 6 characters and more that are assigned to a secret word. Each gets
features of its length, character transitions (kinds of characters, and how likely its letter pairs are in the
corpus's own words), coverage by a dictionary of the corpus's most frequent words, source path and
neighbouring words. A random forest is trained on labelled findings with the machine-learning
DataFrame API and compiled into plain column expressions with the model's own averaged leaf probabilities, so that
scanning is one narrow pass.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AROUND = 40

# Words next to secrets, words next to other long tokens, parts of paths.
SECRET_WORDS = ["access", "api", "auth", "aws", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token"]
PLAIN_WORDS = ["account", "build", "card", "checksum", "commit", "digest", "example", "hash", "id", "invoice", "isbn", "md5", "number", "order", "phone", "revision", "sample", "sha", "uuid", "version"]
TEST_PATHS = ["doc", "example", "fixture", "mock", "sample", "test"]
FEATURES = ["length", "digits", "uppers", "lowers", "others", "hex", "numeric", "changes", "pairs", "distinct", "dictionary", "assigned", "quoted", "secret_word", "plain_word", "test_path", "prefix"]

PREFIXES = "AKIA|ASIA|ghp_|gho_|sk_live|sk-|xox[bap]-|AIza|glpat-|eyJ"
# A run starts after any other character, after a ruler of 8 and more signs, or at a telling prefix after a sign; it ends where the next one starts.
_TELLING = rf"(?<![A-Za-z0-9])(?=(?:{PREFIXES})[A-Za-z0-9]{{8}})"
_STOP = rf"(?!{_TELLING})(?![+/_\-]{{8}})"
RUN = (
    rf"(?:(?<![A-Za-z0-9+/_\-])|(?<=[+/_\-]{{8}})(?![+/_\-])|{_TELLING})(?![+/_\-]{{8}})(?=[A-Za-z+/_\-]?+(?:{_STOP}[A-Za-z+/_\-])*+[0-9])"
    rf"[A-Za-z0-9+/_\-](?:{_STOP}[A-Za-z0-9+/_\-]){{13,}}+"
)
# A value of a secret word: any characters up to a blank, a quote or the next assignment, without closing punctuation.
ASSIGNED = (
    r"(?<=[=:\s\"'])(?<=[=:][\s\"']{0,4})(?<=(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
    r"(?:(?![.,;:)\]}>]{0,3}+(?:[\s\"']|$))(?![&;,][A-Za-z_]\w{0,30}=)[^\s\"']){6,}+"
)
CANDIDATE = f"(?:{ASSIGNED}|{RUN})"


@dataclass
class Dictionary:
    """The most frequent words of a corpus, and how likely each pair of letters is in them."""

    words: list[str] = field(default_factory=list)
    pairs: list[float] = field(default_factory=lambda: [math.log(1 / 26)] * 676)  # log P(second | first), by 26 * first + second


def learn_dictionary(docs: DataFrame, size: int = 2000) -> Dictionary:
    """The `size` (a fixed bound) most frequent runs of 3 to 20 letters a-z of all texts, lower-cased; those met once are left out."""
    each = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 20))
    top = each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()
    seen = [[1.0] * 26 for _ in range(26)]
    for r in top:
        for x, y in zip(r["word"], r["word"][1:]):
            seen[ord(x) - 97][ord(y) - 97] += r["n"]
    return Dictionary([r["word"] for r in top], [math.log(n / sum(row)) for row in seen for n in row])


def _covered(found: Column, dictionary: Dictionary) -> Column:
    """The share of the characters that are in words of the dictionary; words begin at capitals and other signs."""
    if not dictionary.words:
        return F.lit(0.0)
    parts = F.regexp_extract_all(found, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    known = F.filter(parts, lambda x: F.lower(x).isin(*dictionary.words))
    return F.aggregate(known, F.lit(0), lambda n, x: n + F.length(x)) / F.length(found)


def _pair_likelihood(lower: Column, dictionary: Dictionary) -> Column:
    """The mean log likelihood of the letter pairs; that of chance where there is none."""
    table = F.array(*map(F.lit, dictionary.pairs))
    letters = F.regexp_extract_all(lower, F.lit("(?=([a-z][a-z]))"), F.lit(1))
    likely = lambda p: F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97)
    return F.when(F.size(letters) > 0, F.aggregate(letters, F.lit(0.0), lambda n, p: n + likely(p)) / F.size(letters)).otherwise(math.log(1 / 26))


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.length(text)


def features(found: Column, before: Column, after: Column, path: Column, dictionary: Dictionary) -> Column:
    """Struct of FEATURES of a candidate with the text around it."""
    near, lower = F.lower(before), F.lower(found)
    words = lambda text, some: text.rlike("(?:" + "|".join(some) + ")").cast("double")
    tail = F.regexp_extract(near, r"(\S+\s*[=:]?\s*[\"']?)$", 1)
    head = F.regexp_extract(near, r"((?:[^\s]+\s+){0,1}[^\s]*[=:\s\"']*)$", 1)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(found, "dul", "xxx"), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    values = {
        "length": F.length(found),
        "digits": _share(found, "0-9"),
        "uppers": _share(found, "A-Z"),
        "lowers": _share(found, "a-z"),
        "others": _share(found, r"+/_\-"),
        "hex": found.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "numeric": found.rlike(r"^[0-9\-]+$"),
        "changes": F.regexp_count(kinds, F.lit("(?=ld|dl|ud|du|lu|ul)")) / F.length(found),
        "pairs": _pair_likelihood(lower, dictionary),
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / F.length(found),
        "dictionary": _covered(found, dictionary),
        "assigned": tail.rlike(r"[=:]\s*[\"']?$"),
        "quoted": F.startswith(after, F.lit('"')) | F.startswith(after, F.lit("'")),
        "secret_word": words(head, SECRET_WORDS),
        "plain_word": words(head, PLAIN_WORDS),
        "test_path": words(F.lower(path), TEST_PATHS),
        "prefix": found.rlike("^(?:" + PREFIXES + ")"),
    }
    return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()])


def synthetic_findings(spark: SparkSession, dictionary: Dictionary, n: int = 6000) -> DataFrame:
    """Labelled findings (found, before, after, path, label), made from row numbers and words of the corpus: n rows, half of them secrets.

    A stand-in where no reviewed findings exist: secrets of common forms with and without a telling
    word, short and digit-free passwords, and what scanners mistake for them: card and phone numbers, checksums and revisions beside
    such words, ids, versions, names with digits, sample values, words assigned to a secret word.
    """
    i = F.col("id")
    raw = F.sha2(i.cast("string").cast("binary"), 512)
    digits = F.translate(raw, "abcdef", "012345")
    mixed = F.replace(F.replace(F.base64(F.unhex(raw)), F.lit("="), F.lit("")), F.lit("\n"), F.lit(""))
    base32 = F.translate(F.upper(raw), "0189", "GHKL")
    pick = lambda some, by: F.element_at(F.array(*map(F.lit, some)), (F.pmod(F.xxhash64(i, F.lit(by)), F.lit(len(some))) + 1).cast("int"))
    length = lambda lo, hi, by: (F.pmod(F.xxhash64(i, F.lit(by)), F.lit(hi - lo + 1)) + lo).cast("int")
    word = pick(dictionary.words[:50] or PLAIN_WORDS, 1)
    secret_lead = F.concat(word, F.lit(" "), pick(SECRET_WORDS, 2), pick([" = \"", "=", ": ", " = '", "=\"", " "], 3))
    plain_lead = F.concat(word, F.lit(" "), pick(PLAIN_WORDS, 4), pick([" ", ": ", "=", " #", " is "], 5))
    bare = F.concat(word, F.lit(" "), pick(["this ", "ion ", "and ", "", "der "], 6))
    some = dictionary.words[:300] or PLAIN_WORDS
    frag = lambda by: pick(some, by)
    named = F.concat(frag(7), frag(8), frag(9), pick(["_", "-", "", "/"], 10), frag(11), frag(12), F.substring(digits, 1, 2))
    set_lead = F.concat(word, F.lit(" "), pick(SECRET_WORDS, 28), pick([" = \"", "=", ": ", " = '", "=\"", ":"], 29))
    letters = F.translate(mixed, "0123456789+/", "ghkmpqrtvxzw")
    kind = F.pmod(i, F.lit(16))
    forms = [
        (F.concat(pick(["AKIA", "ASIA"], 13), F.substring(base32, 1, 16)), pick(["", "the ", "key ", "aws "], 14), 1),
        (F.substring(raw, F.lit(1), length(16, 64, 15)), secret_lead, 1),
        (F.substring(mixed, F.lit(1), length(16, 60, 16)), secret_lead, 1),
        (F.concat(pick(["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza"], 17), F.substring(mixed, F.lit(1), length(20, 40, 18))), bare, 1),
        (F.upper(F.substring(raw, F.lit(1), length(16, 40, 19))), secret_lead, 1),
        (F.substring(mixed, F.lit(1), length(24, 44, 20)), bare, 1),
        (F.concat(F.lit("4"), F.substring(digits, 1, 15)), bare, 0),
        (F.substring(digits, F.lit(1), length(14, 22, 21)), plain_lead, 0),
        (F.substring(raw, F.lit(1), length(32, 64, 22)), plain_lead, 0),
        (named, bare, 0),
        (F.concat(F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-4"), F.substring(raw, 13, 3), F.lit("-a"), F.substring(raw, 16, 3), F.lit("-"), F.substring(raw, 19, 12)), plain_lead, 0),
        (F.concat(frag(23), frag(24), F.lit("0123456789012345")), secret_lead, 0),
        (F.concat(F.substring(mixed, F.lit(1), length(4, 8, 30)), pick(["!", "#", "$", "@", "%", "*", ""], 31), F.substring(digits, 1, 3)), set_lead, 1),
        (F.substring(letters, F.lit(1), length(8, 32, 32)), set_lead, 1),
        (F.concat(frag(33), frag(34), pick(["ing", "ation", "ment", "able"], 35)), set_lead, 0),
        (pick(["required", "optional", "string", "undefined", "missing", "example", "default", "Option<String>", "process.env", "<password>", "${PASSWORD}", "getpass()", "********"], 36), set_lead, 0),
    ]
    found, before, label = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for k, (what, lead, is_secret) in enumerate(forms):
        found, before, label = F.when(kind == k, what).otherwise(found), F.when(kind == k, lead).otherwise(before), F.when(kind == k, is_secret).otherwise(label)
    after = F.when(before.endswith('"'), '" ').when(before.endswith("'"), "' ").otherwise(" ")
    path = F.when((label == 0) & (F.pmod(F.xxhash64(i, F.lit(25)), F.lit(3)) == 0), pick(["tests/a.py", "docs/x.md", "examples/b"], 26)).otherwise(pick(["src1", "src2", "app/config", "src12"], 27))
    return spark.range(n).select(found.alias("found"), before.alias("before"), after.alias("after"), path.alias("path"), label.alias("label"))


def with_features(findings: DataFrame, dictionary: Dictionary) -> DataFrame:
    """findings (found, before, after, path, label) -> FEATURES, features (a vector), label."""
    rows = findings.select(features(F.col("found"), F.col("before"), F.col("after"), F.col("path"), dictionary).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train_forest(findings: DataFrame, dictionary: Dictionary, trees: int = 24, depth: int = 6, seed: int = 7):
    """findings (found, before, after, path, label) -> fitted forest over FEATURES. The caller bounds findings."""
    rows = with_features(findings, dictionary).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="sqrt").fit(rows)


def held_out_figures(findings: DataFrame, dictionary: Dictionary, limit: float = 0.5) -> dict[str, float]:
    """Precision and recall on the quarter of the findings, by hash of what was found, that a forest trained on the others has not seen."""
    fold = F.pmod(F.xxhash64("found"), F.lit(4)) == 0
    model = train_forest(findings.where(~fold), dictionary)
    rows = with_features(findings.where(fold), dictionary)
    told = rows.select((forest_column(model, F.struct(*FEATURES)) >= limit).alias("told"), (F.col("label") == 1).alias("real"))
    n = told.agg(F.count_if(F.col("told") & F.col("real")).alias("hit"), F.count_if("told").alias("told"), F.count_if("real").alias("real")).first()
    return {"precision": n["hit"] / max(1, n["told"]), "recall": n["hit"] / max(1, n["real"])}


def forest_column(model, values: Column) -> Column:
    """The model's probability of a secret as an expression over a struct of FEATURES: the mean over the trees of the share of label 1 in the leaf."""

    def build(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return F.lit(stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0)
        split = node.split()
        return F.when(values[FEATURES[split.featureIndex()]] <= float(split.threshold()), build(node.leftChild())).otherwise(build(node.rightChild()))

    votes = [build(tree._call_java("rootNode")) for tree in model.trees]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total / len(votes)


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """Adds to docs (text, source, ...) the column secrets: array<struct<start, length, found, probability, is_secret>>.

    One row for each row of docs, other columns untouched, whatever their names; a column named secrets is replaced.
    findings: labelled ones (found, before, after, path, label), a bounded number; without them the forest is trained on made ones.
    start counts characters from 0. Null and empty texts, and texts without candidates, have an empty array. A null source is
    no path. Repeated rows are treated alike. Texts are read whole. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    dictionary = learn_dictionary(docs.select("text"))
    model = train_forest(synthetic_findings(spark, dictionary) if findings is None else findings, dictionary)
    mark = f"__{uuid.uuid4().hex[:8]}"  # no column of the caller has it
    own = {k: f"{mark}_{k}" for k in ("has", "found", "gaps", "starts", "scored", "rated")}
    text, path = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    has = text.rlike(CANDIDATE)
    empty = "array<struct<start:int,length:int,found:string,probability:double,is_secret:boolean>>"
    out = docs.withColumn(own["has"], has)
    out = out.withColumn(own["found"], F.when(F.col(own["has"]), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
    out = out.withColumn(own["gaps"], F.when(F.col(own["has"]), F.split(text, CANDIDATE, -1)))
    gaps = F.col(own["gaps"])
    # the start of candidate k: the lengths of all gaps up to k and of all candidates before it
    sizes = F.transform(own["found"], lambda x, k: F.length(x) + F.length(F.get(gaps, k + 1)))
    starts = F.aggregate(sizes, F.array(F.length(F.get(gaps, F.lit(0)))), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    out = out.withColumn(own["starts"], F.when(F.col(own["has"]), starts))

    def parts(x, k):
        before = F.right(F.get(gaps, k), F.lit(AROUND))
        after = F.left(F.get(gaps, k + 1), F.lit(2))
        return F.struct(F.get(F.col(own["starts"]), k).alias("start"), x.alias("found"), features(x, before, after, path, dictionary).alias("f"))

    out = out.withColumn(own["scored"], F.transform(own["found"], parts))
    # each tree is looked up in the features of one candidate
    rated = F.transform(own["scored"], lambda c: F.struct(c["start"].alias("start"), c["found"].alias("found"), forest_column(model, c["f"]).alias("p")))
    out = out.withColumn(own["rated"], rated)
    final = F.transform(
        own["rated"],
        lambda c: F.struct(c["start"].alias("start"), F.length(c["found"]).alias("length"), c["found"].alias("found"), c["p"].alias("probability"), (c["p"] >= limit).alias("is_secret")),
    )
    return out.withColumn("secrets", F.coalesce(final.cast(empty), F.array().cast(empty))).drop(*own.values())


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each finding that is a secret replaced by the mark."""
    real = F.filter(secrets, lambda s: s["is_secret"])
    text = F.coalesce(text, F.lit(""))
    cut = F.aggregate(
        real,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("done"), (s["start"] + s["length"]).alias("at")),
    )
    return F.when(F.size(real) > 0, F.concat(cut["done"], F.substring(text, cut["at"] + 1, F.length(text)))).otherwise(text)
