"""URL filters: host and path rules first, gradient-boosted trees for the rest.

With DataFrame functions only. Every URL becomes a few lexical features, each a small whole
number (a bin). The rules label a part of the URLs; trees are boosted on ALL of them: equal
feature rows are counted together first, every level of a tree is one aggregation of
gradient sums per (node, feature, bin), a table of fixed size, from which the driver takes the
best splits. A fitted tree is a CASE expression, so scoring is one projection.

Suffix statistics are the share of blocked URLs and the frequency of the host's last label
among the labelled ones, for the ``MAX_SUFFIXES`` most frequent; all others have the overall share.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; the
trees judge it by what is left. Without labels of both kinds everything unruled is allowed.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

TREES = 10
DEPTH = 3
RATE = 0.5
RIDGE = 1.0
MAX_SUFFIXES = 4096
BINS = 32


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # block or allow

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
FEATURES = "length host_length depth digits entropy parameters labels suffix_share suffix_count path_length hyphens".split()
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&:#%"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest matching rule, null without one; ties go to the later rule."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _binned(value: Column, width: float) -> Column:
    return F.least(F.floor(value / width), F.lit(BINS - 1)).cast("int")


def lexical_features(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that need nothing but the URL, as bins, in the order of ``FEATURES`` without suffix statistics."""
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    low = ascii_lower(text)

    def count(symbol: str, where: Column = low) -> Column:
        return F.char_length(where) - F.char_length(F.replace(where, F.lit(symbol)))

    shares = [count(s) / size for s in _SYMBOLS]
    other = 1.0 - sum(shares[1:], shares[0])
    bits = [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in (*shares, other)]
    entropy = sum(bits[1:], bits[0])
    digits = F.char_length(F.regexp_replace(text, "[^0-9]", "")) / size
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    parameters = F.when(query == "", 0).otherwise(count("&", query) + 1)
    return [
        _binned(F.char_length(text), 4),
        _binned(F.char_length(host), 2),
        _binned(count("/", path), 1),
        _binned(digits, 1 / 32),
        _binned(entropy, 0.2),
        _binned(parameters, 1),
        _binned(count(".", host), 1),
        _binned(F.char_length(path), 3),
        _binned(count("-", host), 1),
    ]


@dataclass
class UrlModel:
    suffixes: list = field(default_factory=list)  # (suffix, share bin, count bin)
    trees: list = field(default_factory=list)  # nested (feature, bin, left, right) or a leaf value


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def described(pages: DataFrame, url="url", rules=RULES) -> DataFrame:
    """Add host, path, the rule's name and verdict, and the lexical feature bins to ``pages``."""
    known = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    known = known.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules))
    names = [f for f in FEATURES if not f.startswith("suffix")]
    columns = lexical_features(F.col(url), F.col("host"), F.col("path"))
    return known.withColumns({f"f_{n}": c for n, c in zip(names, columns)})


def _with_suffixes(known: DataFrame, suffixes: list) -> DataFrame:
    """Add the suffix statistics' bins; the lookup has at most ``MAX_SUFFIXES`` rows."""
    table = known.sparkSession.createDataFrame(suffixes or [("", 0, 0)], "suffix string, share int, often int")
    joined = known.withColumn("suffix", _suffix(F.col("host"))).join(F.broadcast(table), "suffix", "left")
    return joined.withColumns(
        {"f_suffix_share": F.coalesce("share", F.lit(BINS // 2)), "f_suffix_count": F.coalesce("often", F.lit(0))}
    )


def _value(tree, leaf=lambda v: F.lit(float(v))) -> Column:
    """A tree as an expression over the feature columns."""
    if not isinstance(tree, tuple):
        return leaf(tree)
    name, cut, left, right = tree
    return F.when(F.col(f"f_{name}") < cut, _value(left, leaf)).otherwise(_value(right, leaf))


def _margin(trees: list) -> Column:
    return sum((_value(t) for t in trees), F.lit(0.0))


def _place(tree, number=1):
    """The same tree with the number of the leaf in place of its value."""
    if not isinstance(tree, tuple):
        return number
    name, cut, left, right = tree
    return name, cut, _place(left, 2 * number), _place(right, 2 * number + 1)


def _best_splits(sums: list) -> dict:
    """The best (gain, feature, cut, left leaf, right leaf) of every node from its gradient sums."""
    nodes: dict = {}
    for row in sums:
        nodes.setdefault(row["node"], {}).setdefault(FEATURES[row["feature"]], {})[row["bin"]] = (row["g"], row["h"])
    out = {}
    for node, features in nodes.items():
        best = None
        for name, bins in sorted(features.items()):
            g, h = sum(v[0] for v in bins.values()), sum(v[1] for v in bins.values())
            left_g = left_h = 0.0
            for low, cut in zip(sorted(bins), sorted(bins)[1:]):
                left_g, left_h = left_g + bins[low][0], left_h + bins[low][1]
                left, right = left_g / (left_h + RIDGE), (g - left_g) / (h - left_h + RIDGE)
                gain = left_g * left + (g - left_g) * right - g * g / (h + RIDGE)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, name, cut, RATE * left, RATE * right)
        out[node] = best
    return out


def _grown(tree, splits: dict, number=1):
    if isinstance(tree, tuple):
        name, cut, left, right = tree
        return name, cut, _grown(left, splits, 2 * number), _grown(right, splits, 2 * number + 1)
    best = splits.get(number)
    return tree if best is None else (best[1], best[2], best[3], best[4])


def fit_urls(known: DataFrame) -> UrlModel:
    """Boost trees on every described URL that a rule has judged (1 for block)."""
    blocked = (F.col("ruled.verdict") == "block").cast("int")
    lexical = [c for c in known.columns if c.startswith("f_")]
    labelled = stage(
        known.where("ruled IS NOT NULL")
        .groupBy(_suffix(F.col("host")).alias("suffix"), *lexical)
        .agg(F.count("*").alias("n"), F.sum(blocked).alias("y")),
        "labelled-urls",
    )
    total, bad = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == total:
        return UrlModel()
    by_suffix = labelled.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    share = (F.col("y") + 10.0 * bad / total) / (F.col("n") + 10.0)
    top = by_suffix.orderBy(F.desc("n"), "suffix").limit(MAX_SUFFIXES)
    found = top.select("suffix", _binned(share, 1 / BINS).alias("share"), _binned(F.log2("n"), 1).alias("often")).collect()
    model = UrlModel([tuple(r) for r in found])
    rows = _with_suffixes(labelled.withColumn("host", F.col("suffix")), model.suffixes)
    features = [f"f_{name}" for name in FEATURES]
    rows = stage(rows.groupBy(*features).agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "url-features")
    bins = F.posexplode(F.array(*features)).alias("feature", "bin")
    for _ in range(TREES):
        chance = 1.0 / (1.0 + F.exp(-_margin(model.trees)))
        pulled = rows.select(
            *features, (F.col("y") - F.col("n") * chance).alias("g"), (F.col("n") * chance * (1.0 - chance)).alias("h")
        )
        tree = 0.0
        for _ in range(DEPTH):
            node = _value(_place(tree), lambda v: F.lit(int(v)))
            level = pulled.select(node.alias("node"), "g", "h", bins).groupBy("node", "feature", "bin")
            splits = _best_splits(level.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
            grown = _grown(tree, splits)
            if grown == tree:
                break
            tree = grown
        model.trees.append(tree)
    return model


def judge_urls(pages: DataFrame, url="url", rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict (block or allow), and the trees' ``block_probability``, to the other columns of ``pages``.

    Columns of ``pages`` by those names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "block_probability")
    kept = [c for c in pages.columns if c not in added or c == url]
    known = described(pages.select(F.struct(*kept).alias("page"), F.col(url).alias("url")), "url", rules)
    model = fit_urls(known)
    scored = _with_suffixes(known, model.suffixes).withColumn(
        "block_probability", 1.0 / (1.0 + F.exp(-_margin(model.trees)))
    )
    method = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page.*",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", method).alias("verdict"),
        "block_probability",
    )
