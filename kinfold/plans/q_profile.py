"""Queries: profiling and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import groups as G
from ..operators import ordered
from ..operators import profile as P
from ..sources.manifest import manifest, read_table
from .registry import register, with_manifest

ID = "PassengerId"
NUMERIC = ["PassengerId", "Survived", "Pclass", "Age", "SibSp", "Parch", "Fare"]
CATEGORICAL = ["Name", "Sex", "Ticket", "Cabin", "Embarked"]
# Fixed lookup ids of the reference (rows shown with their raw group key).
LOOKUP_IDS = [195, 1067, 59, 473, 1142]
# Fixed bins of the reference.
AGE_BINS_LEFT = [0, 20, 36, 51, None]
AGE_LABELS_LEFT = ["Kids and Teens", "Adults", "Middle-Aged", "Seniors"]
FARE_BINS_LEFT = [0, 8, 15, 30, 60, None]
FARE_LABELS_LEFT = ["$", "$$", "$$$", "$$$$", "$$$$$"]
AGE_BINS_4 = [0, 16, 30, 50, 100]
AGE_LABELS_4 = ["Child", "Young", "Middle", "Old"]


def r6(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def round_doubles(df: DataFrame, d: int = 6) -> DataFrame:
    from pyspark.sql import types as T
    return df.select(*[F.round(f.name, d).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")


# ---------------------------------------------------------------------------
_desc_sql = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
       round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75,
       round(CAST(max({c}) AS DOUBLE), 6) AS max FROM manifest""" for c in NUMERIC)


@register("describe_numeric", with_manifest(_desc_sql))
def q_describe_numeric(spark, sf_dir):
    return round_doubles(P.describe_numeric(manifest(spark, sf_dir), NUMERIC))


_cat_sql = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", (SELECT count({c}) FROM manifest) AS count,
       (SELECT count(DISTINCT {c}) FROM manifest) AS unique,
       (SELECT {c} FROM manifest WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
       (SELECT count(*) FROM manifest WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq"""
                         for c in CATEGORICAL)


@register("describe_categorical", with_manifest(_cat_sql))
def q_describe_categorical(spark, sf_dir):
    return P.describe_categorical(manifest(spark, sf_dir), CATEGORICAL)


_DTYPE = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
          "WHEN 'DOUBLE' THEN 'double' END")
_MANIFEST_COLS = ["PassengerId", "Survived", "Pclass", "Name", "Sex", "Age", "SibSp", "Parch", "Ticket",
                  "Fare", "Cabin", "Embarked"]
_info_sql = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", (SELECT {_DTYPE.format(c=c)} FROM manifest LIMIT 1) AS dtype, "
    f"(SELECT count({c}) FROM manifest) AS non_null" for i, c in enumerate(_MANIFEST_COLS))


@register("table_info", with_manifest(_info_sql))
def q_table_info(spark, sf_dir):
    return P.table_info(manifest(spark, sf_dir))


_ids = ", ".join(map(str, LOOKUP_IDS))


@register("lookup_ids", with_manifest(f"""
SELECT PassengerId, Name, regexp_extract(Name, '^([^,]*),', 1) || '-' || CAST(Pclass AS VARCHAR) || '-' ||
       coalesce(regexp_replace(Ticket, '.$', 'X'), 'NA') || '-' ||
       coalesce(CAST(CAST(Fare AS DECIMAL(12,2)) AS VARCHAR), 'NA') || '-' || coalesce(Embarked, 'NA') AS GroupId
FROM manifest WHERE PassengerId IN ({_ids})"""))
def q_lookup_ids(spark, sf_dir):
    d = G.engineer_keys(manifest(spark, sf_dir))
    d = G.add_group_key(d, mask_men=False)
    ids = spark.createDataFrame([(i,) for i in LOOKUP_IDS], f"{ID} long")
    return d.join(ids, ID, "left_semi").select(ID, "Name", "GroupId")


_miss_sql = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM manifest"
                               for c in _MANIFEST_COLS)


@register("missing_by_column", with_manifest(_miss_sql))
def q_missing_by_column(spark, sf_dir):
    return P.missing_by_column(manifest(spark, sf_dir))


@register("non_missing_count", with_manifest("SELECT count(Age) AS non_missing FROM manifest"))
def q_non_missing_count(spark, sf_dir):
    return manifest(spark, sf_dir).agg(F.count("Age").alias("non_missing"))


@register("value_counts", with_manifest("SELECT Embarked, count(*) AS count FROM manifest GROUP BY Embarked"))
def q_value_counts(spark, sf_dir):
    return P.value_counts(manifest(spark, sf_dir), "Embarked", include_null=True)


@register("title_counts", with_manifest("""
t AS (SELECT CASE WHEN regexp_matches(Name, ',\\s*([^.]+)\\.') THEN trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1)) END AS raw
      FROM manifest)
SELECT CASE raw WHEN 'Rev' THEN 'Clergy' WHEN 'Col' THEN 'Military' WHEN 'Major' THEN 'Military'
                WHEN 'Capt' THEN 'Military' WHEN 'Mlle' THEN 'Miss' WHEN 'Ms' THEN 'Miss' WHEN 'Mme' THEN 'Mrs'
                WHEN 'Lady' THEN 'Royalty' WHEN 'Sir' THEN 'Royalty' WHEN 'Don' THEN 'Royalty'
                WHEN 'Jonkheer' THEN 'Royalty' ELSE raw END AS Title, count(*) AS count
FROM t GROUP BY 1"""))
def q_title_counts(spark, sf_dir):
    return manifest(spark, sf_dir).select(fx.title_group("Name").alias("Title")).groupBy("Title") \
        .agg(F.count(F.lit(1)).alias("count"))


@register("rate_by_group", with_manifest("""
SELECT Embarked, count(*) AS n, round(avg(Survived), 6) AS rate FROM manifest WHERE Survived IS NOT NULL
GROUP BY Embarked"""))
def q_rate_by_group(spark, sf_dir):
    r = P.rate_by_group(manifest(spark, sf_dir), ["Embarked"], dropna=False)
    return r.withColumn("rate", r6("rate"))


_AGE4 = ("CASE WHEN a > 0 AND a <= 16 THEN 'Child' WHEN a > 16 AND a <= 30 THEN 'Young' "
         "WHEN a > 30 AND a <= 50 THEN 'Middle' WHEN a > 50 AND a <= 100 THEN 'Old' END")


@register("rate_by_two_keys", with_manifest(f"""
t AS (SELECT *, coalesce(Age, (SELECT median(Age) FROM manifest WHERE Survived IS NOT NULL)) AS a
      FROM manifest WHERE Survived IS NOT NULL)
SELECT {_AGE4} AS age_group, Sex, count(*) AS count, round(avg(Survived), 6) AS mean
FROM t GROUP BY 1, 2 HAVING count(*) > 5"""))
def q_rate_by_two_keys(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    med = P.exact_quantiles(m, "Age", {"__med": 0.5}).select("__med")
    d = m.crossJoin(F.broadcast(med)).withColumn("a", F.coalesce("Age", "__med"))
    d = d.withColumn("age_group", fx.bin_right_closed("a", AGE_BINS_4, AGE_LABELS_4))
    r = d.groupBy("age_group", "Sex").agg(F.count(F.lit(1)).alias("count"),
                                         F.avg(F.col("Survived").cast("double")).alias("mean"))
    return r.where(F.col("count") > 5).withColumn("mean", r6("mean"))


@register("pivot_mean", with_manifest("""
SELECT Sex, round(avg(CASE WHEN Pclass = 1 THEN Survived END), 6) AS "1",
       round(avg(CASE WHEN Pclass = 2 THEN Survived END), 6) AS "2",
       round(avg(CASE WHEN Pclass = 3 THEN Survived END), 6) AS "3"
FROM manifest WHERE Survived IS NOT NULL GROUP BY Sex"""))
def q_pivot_mean(spark, sf_dir):
    return round_doubles(P.pivot_mean(manifest(spark, sf_dir), "Sex", "Pclass", [1, 2, 3]))


def _bins_left(c, edges, labels):
    parts = []
    for (a, b), lab in zip(zip(edges, edges[1:]), labels):
        cond = f"{c} >= {a}" + ("" if b is None else f" AND {c} < {b}")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


_AGE_L = _bins_left("Age", AGE_BINS_LEFT, AGE_LABELS_LEFT)
_FARE_L = _bins_left("Fare", FARE_BINS_LEFT, FARE_LABELS_LEFT)


def _binned(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    return (m.withColumn("Age_Bin", fx.bin_left_closed("Age", AGE_BINS_LEFT, AGE_LABELS_LEFT))
             .withColumn("Age_Ord", fx.bin_ordinal("Age", AGE_BINS_LEFT, right_closed=False))
             .withColumn("Fare_Bin", fx.bin_left_closed("Fare", FARE_BINS_LEFT, FARE_LABELS_LEFT))
             .withColumn("Fare_Ord", fx.bin_ordinal("Fare", FARE_BINS_LEFT, right_closed=False)))


_pcr_cols = ", ".join(
    f"round(avg(CASE WHEN Fare_Bin = '{lab}' THEN Survived END), 6) AS \"{lab}_rate\", "
    f"count(CASE WHEN Fare_Bin = '{lab}' THEN 1 END) AS \"{lab}_n\"" for lab in FARE_LABELS_LEFT)


@register("pivot_count_rate", with_manifest(f"""
t AS (SELECT *, {_AGE_L} AS Age_Bin, {_FARE_L} AS Fare_Bin FROM manifest WHERE Survived IS NOT NULL)
SELECT Age_Bin, {_pcr_cols} FROM t WHERE Age_Bin IS NOT NULL AND Fare_Bin IS NOT NULL GROUP BY Age_Bin"""))
def q_pivot_count_rate(spark, sf_dir):
    d = _binned(spark, sf_dir).where(F.col("Age_Bin").isNotNull() & F.col("Fare_Bin").isNotNull())
    p = d.groupBy("Age_Bin").pivot("Fare_Bin", FARE_LABELS_LEFT).agg(
        F.round(F.avg(F.col("Survived").cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    # Empty cells: rate NULL, count 0.
    return p.select("Age_Bin", *[c for lab in FARE_LABELS_LEFT for c in (
        F.col(f"`{lab}_rate`"), F.coalesce(F.col(f"`{lab}_n`"), F.lit(0)).alias(f"{lab}_n"))])


@register("best_worst_cell", with_manifest(f"""
t AS (SELECT *, {_AGE_L} AS Age_Bin, {_FARE_L} AS Fare_Bin,
        {_bins_left('Age', AGE_BINS_LEFT, ['1', '2', '3', '4'])} AS ao,
        {_bins_left('Fare', FARE_BINS_LEFT, ['1', '2', '3', '4', '5'])} AS fo FROM manifest WHERE Survived IS NOT NULL),
c AS (SELECT Age_Bin, Fare_Bin, min(ao) AS ao, min(fo) AS fo, count(*) AS count, avg(Survived) AS mean FROM t
      WHERE Age_Bin IS NOT NULL AND Fare_Bin IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT 'best' AS kind, Age_Bin, Fare_Bin, count, round(mean, 6) AS mean FROM c ORDER BY mean DESC, ao, fo LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'worst' AS kind, Age_Bin, Fare_Bin, count, round(mean, 6) AS mean FROM c ORDER BY mean ASC, ao, fo LIMIT 1)"""))
def q_best_worst_cell(spark, sf_dir):
    d = _binned(spark, sf_dir).where(F.col("Age_Bin").isNotNull() & F.col("Fare_Bin").isNotNull())
    cells = d.groupBy("Age_Bin", "Fare_Bin").agg(
        F.min("Age_Ord").alias("ao"), F.min("Fare_Ord").alias("fo"), F.count(F.lit(1)).alias("count"),
        F.avg(F.col("Survived").cast("double")).alias("mean"))
    # First in table order on ties: max_by / min_by over (mean, -order).
    key_best = F.struct(F.col("mean"), -F.col("ao"), -F.col("fo"))
    key_worst = F.struct(F.col("mean"), F.col("ao"), F.col("fo"))
    row = F.struct("Age_Bin", "Fare_Bin", "count", "mean")
    r = cells.agg(F.max_by(row, key_best).alias("b"), F.min_by(row, key_worst).alias("w"))
    best = r.select(F.lit("best").alias("kind"), "b.*")
    worst = r.select(F.lit("worst").alias("kind"), "w.*")
    return best.unionByName(worst).withColumn("mean", r6("mean"))


@register("quantile_summary_by_group", with_manifest("""
SELECT Survived, count(*) AS n, round(avg(Age), 6) AS mean, round(quantile_cont(Age, 0.25), 6) AS q1,
       round(quantile_cont(Age, 0.5), 6) AS median, round(quantile_cont(Age, 0.75), 6) AS q3
FROM manifest WHERE Age IS NOT NULL AND Survived IS NOT NULL GROUP BY Survived"""))
def q_quantile_summary(spark, sf_dir):
    return round_doubles(P.quantile_summary(manifest(spark, sf_dir), "Age", "Survived"))


def _box_sql(expr, label):
    return f"""
SELECT '{label}' AS transform, Survived, count(*) AS n, round(min(v), 6) AS min,
  round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low, round(q1, 6) AS q1,
  round(med, 6) AS median, round(q3, 6) AS q3,
  round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high, round(max(v), 6) AS max
FROM (SELECT Survived, {expr} AS v,
        quantile_cont({expr}, 0.25) OVER (PARTITION BY Survived) AS q1,
        quantile_cont({expr}, 0.5) OVER (PARTITION BY Survived) AS med,
        quantile_cont({expr}, 0.75) OVER (PARTITION BY Survived) AS q3
      FROM manifest WHERE Fare IS NOT NULL AND Survived IS NOT NULL)
GROUP BY Survived, q1, med, q3"""


@register("box_stats_by_group", with_manifest(_box_sql("Fare", "none") + " UNION ALL " +
                                              _box_sql("ln(1 + greatest(Fare, 0))", "log1p")))
def q_box_stats(spark, sf_dir):
    m = manifest(spark, sf_dir)
    parts = [P.box_stats(m, "Fare", "Survived", t).withColumn("transform", F.lit(t)) for t in ("none", "log1p")]
    return round_doubles(reduce(DataFrame.unionByName, parts))


_OUT_SQL = """
t AS (SELECT event_type, value,
        quantile_cont(value, 0.25) OVER (PARTITION BY event_type) AS q1,
        quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS median,
        quantile_cont(value, 0.75) OVER (PARTITION BY event_type) AS q3
      FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
s AS (SELECT event_type, count(*) AS n, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low_fence,
        q3 + 1.5 * (q3 - q1) AS high_fence,
        count(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN 1 END) AS n_outliers_low,
        count(CASE WHEN value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers_high,
        count(CASE WHEN value BETWEEN q1 AND q3 THEN 1 END) AS in_box
      FROM t GROUP BY event_type, q1, median, q3)
"""


@register("outlier_stats", """WITH """ + _OUT_SQL + """
SELECT event_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(low_fence, 6) AS low_fence, round(high_fence, 6) AS high_fence, n_outliers_low, n_outliers_high,
  n_outliers_low + n_outliers_high AS n_outliers_total, round(in_box / n, 6) AS pct_in_box,
  round(n_outliers_low / n, 6) AS pct_outliers_low, round(n_outliers_high / n, 6) AS pct_outliers_high,
  round((n_outliers_low + n_outliers_high) / n, 6) AS pct_outliers_total,
  round(100 * n_outliers_high / n, 6) AS outliers_high_per_100 FROM s""")
def q_outlier_stats(spark, sf_dir):
    return round_doubles(P.outlier_stats(events(spark, sf_dir), "value", "event_type"))


@register("rounded_report", """WITH """ + _OUT_SQL + """
SELECT event_type, n, round_even((q1) * 100.0, 0) / 100.0 AS q1, round_even((median) * 100.0, 0) / 100.0 AS median, round_even((q3) * 100.0, 0) / 100.0 AS q3,
  round_even((iqr) * 100.0, 0) / 100.0 AS iqr, round_even((low_fence) * 100.0, 0) / 100.0 AS low_fence, round_even((high_fence) * 100.0, 0) / 100.0 AS high_fence,
  n_outliers_low, n_outliers_high, n_outliers_low + n_outliers_high AS n_outliers_total,
  round_even((in_box / n) * 1000.0, 0) / 1000.0 AS pct_in_box, round_even((n_outliers_low / n) * 1000.0, 0) / 1000.0 AS pct_outliers_low,
  round_even((n_outliers_high / n) * 1000.0, 0) / 1000.0 AS pct_outliers_high,
  round_even(((n_outliers_low + n_outliers_high) / n) * 1000.0, 0) / 1000.0 AS pct_outliers_total,
  round_even((100 * n_outliers_high / n) * 10.0, 0) / 10.0 AS outliers_high_per_100 FROM s""")
def q_rounded_report(spark, sf_dir):
    o = P.outlier_stats(events(spark, sf_dir), "value", "event_type")
    three = {c: 3 for c in ("pct_in_box", "pct_outliers_low", "pct_outliers_high", "pct_outliers_total")}
    return P.rounded(o, {**three, "outliers_high_per_100": 1}, default=2)


_ext_num = ["PassengerId", "Survived", "Pclass", "Age", "SibSp", "Parch", "Fare"]
_ext_str = ["Name", "Sex", "Ticket", "Cabin", "Embarked"]
_ext_sql = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", CAST(max({c}) AS VARCHAR) AS max, CAST(NULL AS VARCHAR) AS most_frequent FROM manifest"
     for c in ["PassengerId", "Survived", "Pclass", "SibSp", "Parch"]]
    + [f"SELECT '{c}' AS \"column\", CAST(CAST(max({c}) AS DECIMAL(12,2)) AS VARCHAR) AS max, "
       f"CAST(NULL AS VARCHAR) AS most_frequent FROM manifest" for c in ["Age", "Fare"]]
    + [f"SELECT '{c}' AS \"column\", max({c}) AS max, (SELECT {c} FROM manifest WHERE {c} IS NOT NULL GROUP BY {c} "
       f"ORDER BY count(*) DESC, {c} LIMIT 1) AS most_frequent FROM manifest" for c in _ext_str])


@register("column_extremes", with_manifest(_ext_sql))
def q_column_extremes(spark, sf_dir):
    m = manifest(spark, sf_dir)
    # Doubles print differently across engines: render maxima as decimals.
    m = m.withColumn("Age", F.col("Age").cast("decimal(12,2)")).withColumn("Fare", F.col("Fare").cast("decimal(12,2)"))
    return P.column_extremes(m)


@register("histogram", """
WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY event_type),
c AS (SELECT e.event_type, CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE least(floor((e.value - b.lo) / ((b.hi - b.lo) / 40)), 39) END AS INT) AS bin,
        count(*) AS cnt
      FROM events e JOIN b ON e.event_type = b.event_type WHERE e.value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT b.*, CAST(r.i AS INT) AS bin FROM b CROSS JOIN range(0, 40) r(i))
SELECT g.event_type, g.bin, round(lo + g.bin * ((hi - lo) / 40), 6) AS bin_lo,
       round(lo + (g.bin + 1) * ((hi - lo) / 40), 6) AS bin_hi, coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.bin = c.bin""")
def q_histogram(spark, sf_dir):
    return round_doubles(P.histogram(events(spark, sf_dir), "value", 40, group="event_type"))


@register("histogram_by_label", with_manifest("""
c AS (SELECT Survived, CAST(least(floor((Age - 0.0) / ((100.0 - 0.0) / 20)), 19) AS INT) AS bin, count(*) AS cnt
      FROM manifest WHERE Age IS NOT NULL AND Survived IS NOT NULL AND Age >= 0 AND Age <= 100 GROUP BY 1, 2),
g AS (SELECT s.Survived, CAST(r.i AS INT) AS bin
      FROM (SELECT DISTINCT Survived FROM manifest WHERE Age IS NOT NULL AND Survived IS NOT NULL AND Age >= 0 AND Age <= 100) s
      CROSS JOIN range(0, 20) r(i))
SELECT g.Survived, g.bin, CAST(round(g.bin * 5.0, 6) AS DOUBLE) AS bin_lo, CAST(round((g.bin + 1) * 5.0, 6) AS DOUBLE) AS bin_hi,
       coalesce(c.cnt, 0) AS count FROM g LEFT JOIN c ON g.Survived = c.Survived AND g.bin = c.bin"""))
def q_histogram_by_label(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    return round_doubles(P.histogram(m, "Age", 20, group="Survived", lo=0.0, hi=100.0))


@register("count_by_category_label", with_manifest("""
w AS (SELECT * FROM manifest WHERE Sex = 'female' AND Survived IS NOT NULL)
SELECT 'Pclass' AS category, CAST(Pclass AS VARCHAR) AS value, Survived, count(*) AS count FROM w GROUP BY 2, 3
UNION ALL SELECT 'Embarked', Embarked, Survived, count(*) FROM w GROUP BY 2, 3
UNION ALL SELECT 'Deck', substr(Cabin, 1, 1), Survived, count(*) FROM w GROUP BY 2, 3"""))
def q_count_by_category_label(spark, sf_dir):
    w = manifest(spark, sf_dir).where((F.col("Sex") == "female") & F.col("Survived").isNotNull())
    w = w.withColumn("Deck", fx.deck("Cabin", missing=None))
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in ("Pclass", "Embarked", "Deck")])
    return w.select("Survived", F.inline(pairs)).groupBy("category", "value", "Survived").agg(F.count(F.lit(1)).alias("count"))


@register("density_on_grid", with_manifest("""
d AS (SELECT Survived, Age FROM manifest WHERE Age IS NOT NULL AND Survived IS NOT NULL),
bw AS (SELECT Survived, count(*) AS n, 0.9 * least(stddev_samp(Age), (quantile_cont(Age, 0.75) - quantile_cont(Age, 0.25)) / 1.34)
                * pow(count(*), -0.2) AS h FROM d GROUP BY Survived),
g AS (SELECT CAST(i AS DOUBLE) AS x FROM range(0, 81) t(i))
SELECT d.Survived, g.x, round(sum(exp(-0.5 * ((g.x - d.Age) / bw.h) * ((g.x - d.Age) / bw.h))) / (bw.n * bw.h * sqrt(2 * pi())), 9) AS density,
       round(bw.h, 9) AS h
FROM d JOIN bw ON d.Survived = bw.Survived CROSS JOIN g GROUP BY d.Survived, g.x, bw.n, bw.h"""))
def q_density_on_grid(spark, sf_dir):
    m = manifest(spark, sf_dir)
    r = P.density_on_grid(m, "Age", "Survived", 0.0, 80.0, 81)
    return r.select("Survived", "x", r6("density", 9).alias("density"), r6("h", 9).alias("h"))


_PLANE_BINS, _PLANE_POINTS = 64, 21


@register("density_on_plane", with_manifest(f"""
d AS (SELECT Survived AS g, CAST(Age AS DOUBLE) AS x, CAST(Fare AS DOUBLE) AS y FROM manifest
      WHERE Age IS NOT NULL AND Fare IS NOT NULL AND Survived IS NOT NULL),
r AS (SELECT min(x) AS x0, (max(x) - min(x)) / {_PLANE_BINS} AS xw, min(y) AS y0, (max(y) - min(y)) / {_PLANE_BINS} AS yw FROM d),
h AS (SELECT g, count(*) AS n, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS hx,
        0.9 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS hy FROM d GROUP BY g),
c AS (SELECT g, x0 + (least(floor((x - x0) / xw), {_PLANE_BINS - 1}) + 0.5) * xw AS cx, y0 + (least(floor((y - y0) / yw), {_PLANE_BINS - 1}) + 0.5) * yw AS cy,
        count(*) AS c FROM d CROSS JOIN r GROUP BY ALL),
p AS (SELECT x0 + {_PLANE_BINS} * xw * a / {_PLANE_POINTS - 1} AS x, y0 + {_PLANE_BINS} * yw * b / {_PLANE_POINTS - 1} AS y
      FROM r CROSS JOIN range(0, {_PLANE_POINTS}) t(a) CROSS JOIN range(0, {_PLANE_POINTS}) u(b))
SELECT c.g AS Survived, round(p.x, 6) AS Age, round(p.y, 6) AS Fare,
  round(sum(c.c * exp(-0.5 * pow((p.x - c.cx) / h.hx, 2)) * exp(-0.5 * pow((p.y - c.cy) / h.hy, 2))) / (any_value(h.n) * any_value(h.hx) * any_value(h.hy) * 2 * pi()), 9) AS density
FROM c JOIN h ON c.g = h.g CROSS JOIN p GROUP BY c.g, p.x, p.y"""))
def q_density_on_plane(spark, sf_dir):
    r = P.density_on_plane(manifest(spark, sf_dir), "Age", "Fare", "Survived", _PLANE_POINTS, _PLANE_BINS)
    return r.select("Survived", r6("Age").alias("Age"), r6("Fare").alias("Fare"), r6("density", 9).alias("density"))


@register("log1p_clipped", "SELECT event_id, round(ln(1 + greatest(value, 0)), 9) AS value_log1p FROM events")
def q_log1p_clipped(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(fx.log1p_clipped("value"), 9).alias("value_log1p"))


_BOYSQL = """
b AS (SELECT Survived, coalesce(Age, (SELECT median(Age) FROM manifest WHERE Survived IS NOT NULL)) AS Age_f,
        CAST(coalesce(lower(Sex) = 'male' AND Age < 18 AND lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master', false) AS INT) AS boy_master,
        CAST(coalesce(lower(Sex) = 'male' AND Age < 18 AND NOT (lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master'), false) AS INT) AS boy_nonmaster,
        CAST(Sex = 'male' AS INT) AS is_male
      FROM manifest WHERE Survived IS NOT NULL)"""
_CORR_COLS = ["Age_f", "boy_master", "boy_nonmaster", "is_male"]


@register("correlation_matrix", with_manifest(_BOYSQL + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM b"
    for a in _CORR_COLS for b in _CORR_COLS)))
def q_correlation_matrix(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    med = P.exact_quantiles(m, "Age", {"__med": 0.5}).select("__med")
    bm, bn = fx.boy_flags()
    d = (m.crossJoin(F.broadcast(med)).withColumn("Age_f", F.coalesce("Age", "__med"))
          .withColumn("boy_master", bm).withColumn("boy_nonmaster", bn)
          .withColumn("is_male", (F.col("Sex") == "male").cast("int")))
    return P.correlation_matrix(d, _CORR_COLS).withColumn("corr", r6("corr"))


def _boys(spark, sf_dir):
    m = manifest(spark, sf_dir).where(F.col("Survived").isNotNull())
    boy = F.coalesce((F.lower("Sex") == "male") & (F.col("Age") < 18), F.lit(False))
    return m.where(boy).withColumn("is_master", F.coalesce(fx.title_raw(lower=True) == "master", F.lit(False)))


_TWO = """
bb AS (SELECT CAST(Survived AS DOUBLE) AS y, coalesce(lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master', false) AS g1
       FROM manifest WHERE Survived IS NOT NULL AND lower(Sex) = 'male' AND Age < 18),
s AS (SELECT count(CASE WHEN g1 THEN 1 END) AS n1, count(CASE WHEN NOT g1 THEN 1 END) AS n2,
        avg(CASE WHEN g1 THEN y END) AS mean1, avg(CASE WHEN NOT g1 THEN y END) AS mean2,
        var_samp(CASE WHEN g1 THEN y END) AS var1, var_samp(CASE WHEN NOT g1 THEN y END) AS var2 FROM bb)"""


@register("two_group_rates", with_manifest(_TWO + """
SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(mean1 - mean2, 6) AS diff FROM s"""))
def q_two_group_rates(spark, sf_dir):
    s = P.two_group_stats(_boys(spark, sf_dir), F.col("is_master"), "Survived")
    return s.select("n1", "n2", r6("mean1").alias("mean1"), r6("mean2").alias("mean2"),
                    r6(F.col("mean1") - F.col("mean2")).alias("diff"))


@register("welch_t", with_manifest(_TWO + """
SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(mean1 - mean2, 6) AS diff,
  round(sqrt(var1 / n1 + var2 / n2), 6) AS sed, round((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2), 6) AS t,
  round(pow(var1 / n1 + var2 / n2, 2) / (pow(var1, 2) / (pow(n1, 2) * (n1 - 1)) + pow(var2, 2) / (pow(n2, 2) * (n2 - 1))), 6) AS df
FROM s"""))
def q_welch_t(spark, sf_dir):
    s = P.two_group_stats(_boys(spark, sf_dir), F.col("is_master"), "Survived")
    return round_doubles(P.welch_t(s))


@register("pooled_t", with_manifest(_TWO + """
SELECT n1, n2, round((mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t,
       CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM s"""))
def q_pooled_t(spark, sf_dir):
    s = P.two_group_stats(_boys(spark, sf_dir), F.col("is_master"), "Survived")
    return round_doubles(P.pooled_t(s))


# The tail of cos(a)^(df - 1) from the test's angle on, by midpoints, as a share of the whole.
_P_STEPS = 200_000


@register("t_p_value", with_manifest(_TWO + f""",
w AS (SELECT *, mean1 - mean2 AS diff, sqrt(var1 / n1 + var2 / n2) AS sed,
        pow(var1 / n1 + var2 / n2, 2) / (pow(var1, 2) / (pow(n1, 2) * (n1 - 1)) + pow(var2, 2) / (pow(n2, 2) * (n2 - 1))) AS df FROM s),
a AS (SELECT *, atan(abs(diff / sed) / sqrt(df)) AS a0 FROM w),
q AS (SELECT sum(pow(cos(a0 + (pi() / 2 - a0) * (i + 0.5) / {_P_STEPS}), df - 1)) * (pi() / 2 - any_value(a0))
             / (sum(pow(cos(pi() / 2 * (i + 0.5) / {_P_STEPS}), df - 1)) * pi() / 2) AS p FROM a, range({_P_STEPS}) t(i))
SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(diff, 6) AS diff, round(sed, 6) AS sed,
       round(diff / sed, 6) AS t, round(df, 6) AS df, round(p, 6) AS p_value FROM a, q"""))
def q_t_p_value(spark, sf_dir):
    s = P.two_group_stats(_boys(spark, sf_dir), F.col("is_master"), "Survived")
    return round_doubles(P.t_p_value(P.welch_t(s)))


@register("cohort_sorted_export", with_manifest("""
SELECT row_number() OVER (ORDER BY Age DESC NULLS LAST, PassengerId) - 1 AS "index", PassengerId, Survived, Pclass, Name,
       CASE Sex WHEN 'male' THEN 'M' WHEN 'female' THEN 'F' WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F'
                WHEN 'MALE' THEN 'M' WHEN 'FEMALE' THEN 'F' ELSE 'Unknown' END AS Sex,
       Age, SibSp, Parch, Fare FROM manifest WHERE Sex = 'female'"""))
def q_cohort_sorted_export(spark, sf_dir):
    d = manifest(spark, sf_dir).where(F.col("Sex") == "female")
    # Global position from the distributed ranking (no single-partition window).
    d = d.withColumn("__age_key", F.coalesce(-F.col("Age"), F.lit(float("inf"))))
    d = ordered.row_number(d, ["__age_key", ID], out="__rn")
    return d.select((F.col("__rn") - 1).alias("index"), ID, "Survived", "Pclass", "Name",
                    fx.recode_sex("Sex").alias("Sex"), "Age", "SibSp", "Parch", "Fare")


@register("drop_columns", with_manifest("""
SELECT PassengerId, Survived, Pclass, Name, Sex, Age, SibSp, Parch, Fare, Embarked FROM manifest"""))
def q_drop_columns(spark, sf_dir):
    return manifest(spark, sf_dir).drop("Ticket", "Cabin")
