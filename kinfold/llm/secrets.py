"""Secret scans with an incremental blob ledger.

Every version of every path (a row) is addressed by its content: a blob is the
SHA-256 of a text. The ledger, a table of (blob, rule, version, spans), says
what has been scanned. A scan takes the blobs of the input, finds the pairs of
blob and rule version that the ledger lacks, scans one text for each such blob
with the rules that are new to it, appends what it found (also when that is
nothing), and joins the findings back to all paths of the blobs.

Only DataFrame functions are used. A text is split at a rule's pattern; the
lengths of the pieces and of the matches between them, added up, are the
places of the matches in code points. Matches are leftmost and do not overlap
within a rule; those whose secret is too short are dropped afterwards.

Defined results: a null text is the empty text; a repeated row gives a row
each time; an empty table gives no row; the ledger may not exist yet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, scratch_path, write_table


class Rule(NamedTuple):
    """``pattern`` in Java's syntax; a match counts if its ``group`` has at
    least ``least`` characters. ``probe`` matches every text with such a match."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    probe: str


# Fixed values of the base rules, in the order in which their spans are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
# Rules that the ledger scans beside the base ones.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:long,end:long>>"


def blob() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger at ``path``; empty where there is none yet."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def matches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(blob, text) -> (blob, start, end) of the rule's matches. Only texts
    that match at all are split. The window is over one text's matches."""
    found = texts.where(F.col("text").rlike(rule.probe)).select(
        "blob", F.split("text", rule.pattern, -1).alias("pieces"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("parts"))
    each = found.select("blob", F.posexplode(F.arrays_zip(
        F.transform("pieces", F.length).alias("gap"), F.transform("all", F.length).alias("size"),
        F.transform("parts", F.length).alias("part"))).alias("i", "m")).where("m.size IS NOT NULL")
    before = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("long")
    return each.withColumn("end", end).where(F.col("m.part") >= rule.least).select(
        "blob", (F.col("end") - F.col("m.size")).alias("start"), "end")


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the blobs of ``docs`` (doc_id, text) and ``rules``."""
    keys = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    rows = docs.select("doc_id", blob().alias("blob"))
    # One row for each unseen blob, with the id of a path that holds it.
    unseen, at_unseen = write_table(
        rows.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left")
        .withColumn("new", F.array_except(keys, F.coalesce("seen", F.filter(keys, lambda k: F.lit(False))))).drop("seen")
        .where(F.size("new") > 0), "unseen-blobs")
    texts = docs.select("doc_id", blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    hits = None
    # A text is looked at only if some rule matches: most texts end here, before any shuffle.
    some = " OR ".join(f"text RLIKE '{_sql(r.probe)}'" for r in rules)
    same = (F.col("t.blob") == F.col("u.blob")) & F.col("t.doc_id").eqNullSafe(F.col("u.doc_id"))
    own, at_own = write_table(
        texts.where(some).alias("t").join(unseen.alias("u"), same).select("t.blob", "t.text", "u.new")
        .groupBy("blob").agg(F.first("text").alias("text"), F.first("new").alias("new")), "unseen-texts")
    for r in rules:
        new = own.where(F.array_contains("new", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))))
        got = matches(new, r).withColumn("rule", F.lit(r.kind)).withColumn("version", F.lit(r.version))
        hits = got if hits is None else hits.unionByName(got)
    spans = hits.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = unseen.select("blob", F.explode("new").alias("k")).select("blob", "k.rule", "k.version")
    out, _ = write_table(pairs.join(spans, ["blob", "rule", "version"], "left").select(
        "blob", "rule", "version", F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).alias("spans")), "scanned")
    drop_tables(docs.sparkSession, [at_unseen, at_own])
    return out


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it there, and return the
    ledger."""
    scan(docs, read_ledger(docs.sparkSession, path), rules).write.mode("append").parquet(path)
    return read_ledger(docs.sparkSession, path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id and found, the spans of ``rules`` as structs
    of start, rule's place in ``rules``, end and kind, in this order."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}@{r.version}", i)])
    own = ledger.where(F.size("spans") > 0).withColumn("place", order[F.concat_ws("@", "rule", F.col("version").cast("string"))]).where("place IS NOT NULL") \
        .dropDuplicates(["blob", "place"])
    per_blob = own.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("rule").alias("kind")))))).alias("found"))
    return docs.select("doc_id", blob().alias("blob")).join(per_blob, "blob", "left").select(
        "doc_id", F.coalesce("found", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind"))), lambda x: F.lit(False))).alias("found"))


def report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and
    spans, from a ledger that is made up to date first."""
    path = ledger_path or scratch_path(docs.sparkSession, "ledger")
    got = findings(docs, scan_into(docs, path))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["place"] < len(BASE_RULES))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), *[n(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                      F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same spans in SQL, without the ledger: pieces and matches of each text."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''").replace(r"\x20", " ")
        parts.append(f"""
SELECT r, {i} AS place, '{r.kind}' AS kind, e - n AS s, e, part FROM (
  SELECT r, n, part, sum(gap + n) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
    SELECT r, generate_subscripts(m, 1) AS i, length(unnest(m)) AS n, length(unnest(g)) AS part, length(unnest(p[1:len(m)])) AS gap
    FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g,
                 string_split_regex(text, '{pattern}') AS p FROM d) WHERE len(m) > 0)) WHERE part >= {r.least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans,
             string_agg(CASE WHEN place < {len(BASE_RULES)} THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, place) AS base,
             {', '.join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)}
      FROM f GROUP BY r)
SELECT d.doc_id, {', '.join(f'CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}' for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


OP5_SQL = _oracle()
