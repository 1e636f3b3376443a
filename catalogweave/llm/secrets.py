"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule is a regular expression. From its syntax tree a Boolean query is derived: a set
of alternatives, each a conjunction of the trigrams of its mandatory literals. The index
holds, for every trigram that some query names, the documents whose lower-cased text
contains it. Postings are intersected by counting the trigrams of an alternative per
document; what survives is a candidate of the rule and is verified with the regular
expression itself. Rules without mandatory trigrams (hex strings) scan every document.

Spans are counted in code points, the end exclusive: the text between matches
(``split``) and the matches (``regexp_extract_all``) alternate, so their lengths add up to
positions. Matches are leftmost and do not overlap within a rule; those that are too
short are dropped afterwards, so they still use up their text.

The index names no text; texts are shuffled once, by document key, to meet their candidate
rules. Each key is one document, so no partition grows with a popular pattern.

Defined results: a null or empty text has no spans. Rows without a key are verified
against every rule. Rows that repeat a key share candidates and are verified one by one.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MOST_ALTERNATIVES = 1024  # a query with more alternatives is given up: the rule scans fully
SMALL_CLASS = 8  # character classes up to this size are spelled out


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # matches whose group is shorter are dropped


# The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Widely published formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _alternatives(tree) -> list[tuple] | None:
    """The ways through a syntax tree, each a tuple of literal strings with None for gaps.

    None when there are too many ways.
    """
    ways = [()]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            steps = [(chr(value),)]
        elif name == "IN":
            letters = [chr(v) for k, v in value if str(k) == "LITERAL"]
            plain = len(letters) == len(value) <= SMALL_CLASS
            steps = [(c,) for c in letters] if plain else [(None,)]
        elif name == "BRANCH":
            steps = []
            for branch in value[1]:
                more = _alternatives(branch)
                if more is None:
                    return None
                steps += more
        elif name == "SUBPATTERN":
            steps = _alternatives(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = value
            inner = _alternatives(body)
            if inner is None or least == 0 and most != 1:
                steps = [(None,)]
            elif least == 0:
                steps = [()] + inner
            elif most == least == 1:
                steps = inner
            else:  # at least one: what it begins with is mandatory, then anything may follow
                steps = [(*way, None) for way in inner]
        else:
            steps = [(None,)]
        if steps is None or len(ways) * len(steps) > MOST_ALTERNATIVES:
            return None
        ways = [way + step for way in ways for step in steps]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams, or None when the rule has to scan fully."""
    ways = _alternatives(re._parser.parse(pattern))
    if ways is None:
        return None
    out = set()
    for way in ways:
        runs = "".join("\n\n\n" if piece is None else piece for piece in way).lower().split("\n\n\n")
        grams = frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2))
        if not grams or any(not g.isascii() for g in grams):
            return None
        out.add(grams)
    return sorted((g for g in out if not any(other < g for other in out)), key=sorted)


def trigram_index(docs: DataFrame, grams: list[str], key="doc_id", text="text") -> DataFrame:
    """Postings (gram, doc_id) of the given trigrams; every document is read once."""
    low = docs.select(F.col(key).alias("doc_id"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.where(F.col("doc_id").isNotNull()).select(F.explode(held).alias("gram"), "doc_id").distinct()


def candidates(docs: DataFrame, rules=RULES, key="doc_id", text="text") -> DataFrame:
    """(doc_id, kinds): the rules with a trigram query that a document may match."""
    spark = docs.sparkSession
    clauses = [(r.kind, n, g, len(way)) for r in rules for n, way in enumerate(trigram_query(r.pattern) or ()) for g in sorted(way)]
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    if not clauses:
        return spark.createDataFrame([], f"doc_id {kind}, kinds array<string>")
    postings = stage(trigram_index(docs, sorted({c[2] for c in clauses}), key, text), "postings")
    # As many rows as the rules have trigrams: fixed by the rules, not by the data.
    query = F.broadcast(spark.createDataFrame(clauses, "kind string, way int, gram string, needed int"))
    met = postings.join(query, "gram").groupBy("doc_id", "kind", "way").agg(
        F.count("*").alias("found"), F.first("needed").alias("needed")
    )
    whole = met.where("found = needed")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, stop) of a rule's matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    kind = "struct<start:int,kind:int,stop:int>"

    def span(at, row):
        start = at + F.char_length(row["gap"])
        return F.struct(
            start.alias("start"), F.lit(number).alias("kind"), (start + F.char_length(row["match"])).alias("stop")
        ).cast(kind)

    def step(state, row):
        made = span(state["at"], row)
        out = F.when(F.char_length(row["counted"]) >= rule.least, F.array_append(state["out"], made)).otherwise(state["out"])
        return F.struct(made["stop"].alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    rows = F.arrays_zip(between.alias("gap"), whole.alias("match"), counted.alias("counted"))
    return F.aggregate(rows, zero, step, lambda state: state["out"])


def _scanned(rule: Rule) -> Rule:
    """A plain repeated class with a least length matches the same runs when the length is in the pattern."""
    if rule.group == 0 and rule.pattern.endswith("+") and trigram_query(rule.pattern) is None:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


def scan(docs: DataFrame, rules=RULES, key="doc_id", text="text") -> DataFrame:
    """(doc, spans): the row as a struct and its spans, an ordered array of (start, kind number in ``rules``, stop)."""
    found = candidates(docs, rules, key, text).select(F.col("doc_id").alias("candidate"), "kinds")
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    met = rows.join(found, F.col("key") == F.col("candidate"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    parts = []
    for number, rule in enumerate(rules):
        wanted = F.lit(True)
        if trigram_query(rule.pattern) is not None:
            wanted = F.coalesce(F.array_contains("kinds", F.lit(rule.kind)), F.lit(False)) | F.col("key").isNull()
        checked = _scanned(rule)
        hit = wanted & F.col("text").rlike(checked.pattern)
        parts.append(F.when(hit, _spans(F.col("text"), checked, number)).otherwise(none))
    return met.select("doc", F.array_sort(F.concat(*parts)).alias("spans"))


def find_secrets(docs: DataFrame, rules=RULES, key="doc_id", text="text") -> DataFrame:
    """(doc_id, spans) of every document; see ``scan``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return scan(rows, rules, "doc_id", "text").select(F.col("doc.doc_id").alias("doc_id"), "spans")


def redact(docs: DataFrame, rules=RULES, key="doc_id", text="text", mark="[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all columns stay, a null text stays null."""
    found = scan(docs, rules, key, text)
    own = F.col("doc").getField(text)
    columns = [
        redacted(own, F.col("spans"), mark).alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns
    ]
    return found.select(*columns)


def listed(spans: Column, rules=RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    names = F.array(*[F.lit(r.kind) for r in rules])

    def one(span):
        return F.concat_ws(":", F.get(names, span["kind"]), span["start"].cast("string"), span["stop"].cast("string"))

    return F.concat_ws(",", F.transform(spans, one))


def redacted(text: Column, spans: Column, mark="[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are replaced together."""

    def step(state, span):
        fresh = span["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], kept, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
