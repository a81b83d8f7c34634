"""URL filters: gradient-boosted trees on lexical features of a URL, trained
from labelled URLs, behind a list of host and path rules.

Features: lengths of the URL, host and path, depth of the path, labels of the
host, share of digits, entropy of the characters, number of parameters,
hyphens, and for the host's last and last two labels (its suffixes) the
smoothed share of blocked training URLs and how often they were seen.

Only DataFrame functions and Spark's own trees are used. The trees are fitted
on a bounded sample of the distinct labelled URLs: those whose hash lies in a
share of the range that holds about ``TRAIN_ROWS`` of them. Suffix statistics
count all labelled URLs.

Defined results: a URL that is null or has no ``://`` has an empty host and
path and fits no rule; where no labelled URL exists, or all have one verdict,
that verdict (allow if there is none) is given to URLs without a rule; repeated
rows each give a row; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table

#: Distinct labelled URLs that the trees are fitted on, about.
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
#: Weight of the overall share in a suffix's smoothed share.
SMOOTHING = 20.0

# The fixed rules of the query: rule (host/path) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_share", "entropy",
            "parameters", "hyphens", "suffix1_share", "suffix1_seen", "suffix2_share", "suffix2_seen"]


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    """From there up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[tuple[str, str], ...], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits: its host is the host or a parent of it and
    the path starts with its path. Null where none fits."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((F.col(host) == rule[:at]) | F.col(host).endswith("." + rule[:at])) & F.col(path).startswith(rule[at:])
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def suffixes(host: str = "host") -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that need no training; ``urls`` has url, host, path."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    rest = F.col("__chars")
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c != "", n - F.length(F.replace(url, c, F.lit("")))).otherwise(F.lit(0)))
    entropy = F.aggregate(rest, F.lit(0.0), lambda acc, k: acc - F.when(k > 0, k / n * F.log2(k / n)).otherwise(F.lit(0.0)))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    s1, s2 = suffixes()
    return urls.withColumn("__chars", counts).select(
        *urls.columns, n.cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]+", "")) / n).otherwise(F.lit(0.0)).alias("digit_share"),
        entropy.alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("parameters"),
        (n - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        s1.alias("suffix1"), s2.alias("suffix2"))


def _suffix_stats(labelled: DataFrame, overall: float) -> tuple[DataFrame, DataFrame]:
    out = []
    for s in ("suffix1", "suffix2"):
        out.append(labelled.groupBy(s).agg(
            ((F.sum("label") + SMOOTHING * overall) / (F.count(F.lit(1)) + SMOOTHING)).alias(f"{s}_share"),
            F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{s}_seen")))
    return out[0], out[1]


def with_stats(rows: DataFrame, stats: tuple[DataFrame, DataFrame], overall: float) -> DataFrame:
    """Add a suffix's statistics; a suffix never seen has the overall share.
    The statistics are per suffix and not broadcast; a hot suffix is split by
    the skew-join rule."""
    for s, table in zip(("suffix1", "suffix2"), stats, strict=True):
        rows = rows.join(table, s, "left").withColumn(f"{s}_share", F.coalesce(f"{s}_share", F.lit(overall))) \
            .withColumn(f"{s}_seen", F.coalesce(f"{s}_seen", F.lit(0.0)))
    return rows


class UrlFilter:
    """A fitted filter: ``verdicts(urls)`` adds block_score and the trees' verdict."""

    def __init__(self, model, stats, overall: float):
        self.model, self.stats, self.overall = model, stats, overall

    def score(self, features: DataFrame) -> DataFrame:
        """Add ``predicted``, block or allow, to rows with lexical features."""
        if self.model is None:
            return features.withColumn("predicted", F.lit("block" if self.overall > 0.5 else "allow"))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_stats(features, self.stats, self.overall))
        return self.model.transform(rows).withColumn("predicted", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> UrlFilter:
    """Train from rows with lexical features and a ``label`` (1.0 block, 0.0 allow)."""
    n, blocked = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    overall = float(blocked or 0.0) / n if n else 0.0
    if not n or blocked in (0.0, n):
        return UrlFilter(None, None, overall)
    stats = _suffix_stats(labelled, overall)
    distinct = labelled.dropDuplicates(["url", "label"])
    share = min(1.0, train_rows / distinct.count())
    sample = with_stats(distinct.where(F.pmod(F.xxhash64("url", "label"), F.lit(1 << 30)) < int(share * (1 << 30))), stats, overall)
    train, path = write_table(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label"), "url-train")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(train)
    drop_tables(labelled.sparkSession, [path])
    return UrlFilter(model, stats, overall)


def report(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.
    ``labelled`` (url, verdict) trains the trees; without it the URLs that a
    rule decides do, by its verdict."""
    def parsed(df: DataFrame, *more: str) -> DataFrame:
        return df.select("url", *more).withColumns({"host": host_of(), "path": path_of()})

    verdict = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else None
    judged = parsed(pages, "page_id").withColumn("rule", rule_of(rules))
    rows, _ = write_table(lexical(judged), "url-features")
    if labelled is None:
        known = rows.where("rule IS NOT NULL").withColumn("label", F.when(verdict[F.col("rule")] == "block", 1.0).otherwise(0.0))
    else:
        known = lexical(parsed(labelled, "verdict")).withColumn("label", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0))
    scored = fit(known).score(rows)
    by_rule = verdict[F.col("rule")] if rules else F.lit(None).cast("string")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.col("predicted")).alias("verdict"))
