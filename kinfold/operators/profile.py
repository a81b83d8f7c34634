"""Profiling and summary operators.

All statistics are one or a few aggregations. Exact quantiles avoid
per-group value buffers and shuffles of rows: brackets of values around the
wanted ranks are narrowed by aggregations, and the two ranks around each quantile
position are picked and linearly interpolated (numpy's default definition).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered
from .joins import join_back, join_null_safe, with_scalar


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


# ---------------------------------------------------------------------------
# Exact quantiles
# ---------------------------------------------------------------------------
#: Groups whose brackets are held by the driver and broadcast; with more, ranks come from running counts.
FEW_GROUPS = 4096
#: Rows of a bracket that are ranked by value; a wider one is narrowed first.
DIRECT = 200_000
#: Quantiles of a bracket's rows that a narrowing looks at.
STEPS = 500


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float],
                    group_cols: list[str] | None = None) -> DataFrame:
    """Per group (a NULL group is one): ``n`` non-null values and each named
    quantile, linear interpolation between the order statistics at
    floor/ceil((n-1)q).

    By range refinement: each wanted rank has a bracket of values, at first all
    of them. While a bracket holds more than ``DIRECT`` rows, one aggregation
    takes ``STEPS`` approximate quantiles of its rows, and it narrows to those
    around the rank. Then rows in a bracket are counted by value, all others by
    where they lie, and the ranks are read off. Rows are only aggregated: none
    is shuffled, sorted or written. An approximate quantile may only widen a
    bracket: counts decide, and a rank outside its bracket widens it again.
    With more than ``FEW_GROUPS`` groups see ``ranked_quantiles``."""
    g = list(group_cols or [])
    nn = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col(value).cast("double").alias("__v"))
    keys = [f"__g{i}" for i in range(len(g))]
    found = nn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).limit(FEW_GROUPS + 1).collect()
    if len(found) > FEW_GROUPS:
        return ranked_quantiles(df, value, qs, g)
    groups = [tuple(r[k] for k in keys) for r in found if r.n]
    size = {tuple(r[k] for k in keys): r.n for r in found}
    ranks = {(k, q): (math.floor((size[k] - 1) * p), math.ceil((size[k] - 1) * p)) for k in groups for q, p in qs.items()}
    full = {tuple(r[k] for k in keys): (r.lo, r.hi, 0, r.n) for r in found}
    brackets = {(k, q): full[k] for k in groups for q in qs}
    while True:
        wide = {kq: b for kq, b in brackets.items() if b[3] > DIRECT and b[0] < b[1]}
        if not wide:
            break
        brackets |= _narrowed(nn, keys, wide, ranks)
    picked = _picked(nn, keys, brackets, ranks)
    names = list(qs)
    rows = [] if g or groups else [(0, *[None] * len(names))]  # without groups there is always a row
    for k in groups:
        out = []
        for q in names:
            lo, hi = picked[k, q]
            out.append(lo + (hi - lo) * ((size[k] - 1) * qs[q] - ranks[k, q][0]))
        rows.append((*k, size[k], *out))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in g), T.StructField("n", T.LongType()),
                           *(T.StructField(q, T.DoubleType()) for q in names)])
    return df.sparkSession.createDataFrame(rows, schema)


def _with_brackets(nn: DataFrame, keys: list[str], brackets: dict) -> DataFrame:
    """Rows with ``__b``: the brackets (lo, hi) of their group, in the order of ``brackets``."""
    by_group: dict = {}
    for (k, q), b in brackets.items():
        by_group.setdefault(k, []).append((q, b[0], b[1]))
    kinds = [T.StructField(c, nn.schema[c].dataType) for c in keys]
    pair = T.StructType([T.StructField("q", T.StringType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    table = nn.sparkSession.createDataFrame([(*k, b) for k, b in by_group.items()], T.StructType([*kinds, T.StructField("__b", T.ArrayType(pair))]))
    # At most FEW_GROUPS rows, each with a bracket for each quantile.
    small = F.broadcast(table)
    return join_null_safe(nn, small, keys) if keys else nn.crossJoin(small)


def _narrowed(nn: DataFrame, keys: list[str], wide: dict, ranks: dict) -> dict:
    """Brackets of fewer rows that hold the same ranks."""
    each = _with_brackets(nn, keys, wide).select(*keys, "__v", F.explode("__b").alias("b"))
    inside = (F.col("__v") >= F.col("b.lo")) & (F.col("__v") <= F.col("b.hi"))
    grid = F.percentile_approx(F.when(inside, F.col("__v")), [i / STEPS for i in range(STEPS + 1)], 20 * STEPS).alias("grid")
    got = each.groupBy(*keys, F.col("b.q").alias("q")).agg(
        F.count(F.when(F.col("__v") < F.col("b.lo"), 1)).alias("below"), F.count(F.when(inside, 1)).alias("m"), grid).collect()
    out = {}
    for r in got:
        kq = (tuple(r[k] for k in keys), r.q)
        lo, hi = ranks[kq]
        first, last = (lo - r.below) / r.m * STEPS, (hi + 1 - r.below) / r.m * STEPS
        a, b = r.grid[max(0, math.floor(first) - 2)], r.grid[min(STEPS, math.ceil(last) + 2)]
        if first < 2:
            a = wide[kq][0]
        if last > STEPS - 2:
            b = wide[kq][1]
        if (a, b) == wide[kq][:2]:  # one value holds most rows
            out[kq] = (a, b, r.below, 0)
        else:
            out[kq] = (a, b, r.below, min(r.m - 1, math.ceil(r.m * (math.ceil(last) - math.floor(first) + 6) / STEPS)))
    return out


def _picked(nn: DataFrame, keys: list[str], brackets: dict, ranks: dict) -> dict:
    """The values at the two ranks of each bracket."""
    rows = _with_brackets(nn, keys, brackets)
    inside = F.exists("__b", lambda b: (F.col("__v") >= b["lo"]) & (F.col("__v") <= b["hi"]))
    where = F.size(F.filter("__b", lambda b: b["hi"] < F.col("__v")))
    counts = rows.groupBy(*keys, where.alias("w"), F.when(inside, F.col("__v")).alias("x")).agg(F.count(F.lit(1)).alias("c"), F.max("__v").alias("top"))
    order = Window.partitionBy(*keys).orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(order))
    want = nn.sparkSession.createDataFrame(
        [(*k, q, end, ranks[k, q][end]) for k, q in brackets for end in (0, 1)],
        T.StructType([*(T.StructField(c, nn.schema[c].dataType) for c in keys), T.StructField("q", T.StringType()),
                      T.StructField("end", T.IntegerType()), T.StructField("r", T.LongType())])) if brackets else None
    if want is None:
        return {}
    hit = (join_null_safe(ranked, F.broadcast(want), keys) if keys else ranked.crossJoin(F.broadcast(want))) \
        .where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c"))).select(*keys, "q", "end", "x").collect()
    got: dict = {}
    missed = set()
    for r in hit:
        kq = (tuple(r[k] for k in keys), r.q)
        got.setdefault(kq, [0.0, 0.0])[r.end] = r.x
        if r.x is None:
            missed.add(kq)
    if missed:  # an approximate bracket was off: take the whole range for these
        ends = {k: (lo, hi) for *k, lo, hi in ((*(r[c] for c in keys), r.lo, r.hi) for r in nn.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).collect()) for k in [tuple(k)]}
        got |= _picked(nn, keys, {kq: (*ends[kq[0]], 0, 0) for kq in missed}, ranks)
    return got


def ranked_quantiles(df: DataFrame, value: str, qs: dict[str, float], g: list[str]) -> DataFrame:
    """The same for any number of groups: values become (value, count) pairs,
    running counts give their ranks, and the pairs that hold a wanted rank are
    picked; no task holds a group's values."""
    nn = df.where(F.col(value).isNotNull())
    v = (nn.groupBy(*g, value)
           .agg(F.count(F.lit(1)).alias("__c")))
    v = ordered.prefix_sums(v, [value], {"__cum": "__c"}, g)
    n = v.groupBy(*g).agg(F.sum("__c").alias("__n"))
    v = join_null_safe(v, n, g) if g else with_scalar(v, n)
    aggs = [F.first("__n").alias("n")]
    for name, q in qs.items():
        pos = (F.col("__n") - 1) * F.lit(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        # The distinct value whose rank span [cum-c, cum) holds rank r.
        at_lo = (F.col("__cum") - F.col("__c") <= lo) & (lo < F.col("__cum"))
        at_hi = (F.col("__cum") - F.col("__c") <= hi) & (hi < F.col("__cum"))
        aggs += [F.max(F.when(at_lo, F.col(value))).alias(f"__lo_{name}"),
                 F.max(F.when(at_hi, F.col(value))).alias(f"__hi_{name}"),
                 F.first(pos - lo).alias(f"__d_{name}")]
    r = v.groupBy(*g).agg(*aggs)
    for name in qs:
        lo_v, hi_v = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        r = r.withColumn(name, lo_v + (hi_v - lo_v) * F.col(f"__d_{name}"))
    return r.select(*g, F.col("n").cast("long").alias("n"), *qs.keys())


def exact_quantiles_by_column(df: DataFrame, cols: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: the columns are stacked
    into (column, value) rows and the column name becomes the group key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in cols]))
    long = df.select(pairs.alias("__p")).select("__p.column", "__p.value")
    return exact_quantiles(long, "value", qs, ["column"])


# ---------------------------------------------------------------------------
# Describe / info / missing
# ---------------------------------------------------------------------------
def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % and max per numeric column
    (long form: one row per column)."""
    cols = cols or _numeric_cols(df)
    moments = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
        F.max(c).cast("double").alias(f"{c}__max"))])
    stack = ", ".join(f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in cols)
    m = moments.selectExpr(f"stack({len(cols)}, {stack}) AS (column, count, mean, std, min, max)")
    q = exact_quantiles_by_column(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = m.join(q.select("column", "q25", "q50", "q75"), "column", "left")
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def mode_table(df: DataFrame, col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Most frequent non-null value per group, ties -> smallest value."""
    g = list(group_cols or [])
    vc = df.where(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("__f"))
    agg = vc.groupBy(*g).agg(
        F.min_by(F.col(col), F.struct((-F.col("__f")).alias("a"), F.col(col).alias("b"))).alias("top"),
        F.max("__f").alias("freq"), F.count(F.lit(1)).alias("unique"), F.sum("__f").alias("count"))
    return agg


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, unique, top (most frequent, ties -> smallest), freq."""
    cols = cols or _string_cols(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
    long = df.select(pairs.alias("__p")).select("__p.column", "__p.v")
    return mode_table(long, "v", ["column"]).select(
        "column", F.col("count").cast("long").alias("count"), F.col("unique").cast("long").alias("unique"),
        "top", F.col("freq").cast("long").alias("freq"))


def table_info(df: DataFrame) -> DataFrame:
    """Per column: position, type and non-null count (one pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"{i + 1}, '{c}', '{df.schema[c].dataType.simpleString()}', c{i}"
                      for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) AS (position, column, dtype, non_null)")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Nulls per column (one pass), sorted by count descending then name."""
    agg = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}")
                   for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(df.columns))
    return agg.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column, n_missing)") \
        .orderBy(F.desc("n_missing"), "column")


def value_counts(df: DataFrame, col: str, include_null: bool = True) -> DataFrame:
    d = df if include_null else df.where(F.col(col).isNotNull())
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def rate_by_group(df: DataFrame, keys: list[str], label: str = "Survived",
                  dropna: bool = True) -> DataFrame:
    """Mean label per key over labelled rows; ``dropna`` drops NULL keys."""
    d = df.where(F.col(label).isNotNull())
    if dropna:
        d = d.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list, label: str = "Survived",
               agg: str = "mean") -> DataFrame:
    """rows x columns table of mean (or count) of the label; the column
    values are given, so the pivot needs no extra distinct pass."""
    d = df.where(F.col(label).isNotNull())
    g = d.groupBy(row).pivot(col, values)
    e = F.avg(F.col(label).cast("double")) if agg == "mean" else F.count(F.lit(1))
    return g.agg(e)


def two_group_stats(df: DataFrame, cond: Column, value: str) -> DataFrame:
    """n, mean and sample variance of ``value`` where cond holds (group 1)
    and where it is false (group 2), in one aggregation."""
    c1 = F.coalesce(cond, F.lit(False))
    v = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull()).agg(
        F.count(F.when(c1, 1)).alias("n1"), F.count(F.when(~c1, 1)).alias("n2"),
        F.avg(F.when(c1, v)).alias("mean1"), F.avg(F.when(~c1, v)).alias("mean2"),
        F.var_samp(F.when(c1, v)).alias("var1"), F.var_samp(F.when(~c1, v)).alias("var2"))


def welch_t(stats: DataFrame) -> DataFrame:
    """SED, t and Welch-Satterthwaite df from two_group_stats."""
    a = F.col("var1") / F.col("n1")
    b = F.col("var2") / F.col("n2")
    sed = F.sqrt(a + b)
    dfw = (a + b) ** 2 / (F.col("var1") ** 2 / (F.col("n1") ** 2 * (F.col("n1") - 1))
                          + F.col("var2") ** 2 / (F.col("n2") ** 2 * (F.col("n2") - 1)))
    return stats.select("n1", "n2", "mean1", "mean2", (F.col("mean1") - F.col("mean2")).alias("diff"),
                        sed.alias("sed"), ((F.col("mean1") - F.col("mean2")) / sed).alias("t"),
                        dfw.alias("df"))


def pooled_t(stats: DataFrame) -> DataFrame:
    """Equal-variance two-sample t."""
    n1, n2 = F.col("n1"), F.col("n2")
    sp2 = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2)
    se = F.sqrt(sp2 * (1 / n1 + 1 / n2))
    return stats.select("n1", "n2", ((F.col("mean1") - F.col("mean2")) / se).alias("t"),
                        (n1 + n2 - 2).cast("double").alias("df"))


#: Range and steps of the quadrature of ``t_p_value``, in standard deviations.
T_RANGE, T_STEPS = 40.0, 4000


def t_p_value(tests: DataFrame, t: str = "t", dof: str = "df") -> DataFrame:
    """Two-sided p of Student's t. With t = sqrt(df) tan(x / sqrt(df)) the
    density becomes cos(x / sqrt(df))^(df - 1), smooth on 0 <= x <= sqrt(df)
    pi / 2; p is its integral from the test's x on, as a share of the one from
    0. Both by Simpson's rule over at most ``T_RANGE``, beyond which nothing
    is left. One row per test, no UDF."""
    root = F.sqrt(F.col(dof))
    start = root * F.atan(F.abs(F.col(t)) / root)
    d = tests.withColumn("__id", F.monotonically_increasing_id()).withColumn("__x0", start)

    def integral(lo: Column) -> Column:
        width = F.least(root * (math.pi / 2) - lo, F.lit(T_RANGE))
        at = (lo + width * F.col("__k") / T_STEPS) / root
        weight = F.when((F.col("__k") == 0) | (F.col("__k") == T_STEPS), 1.0).when(F.col("__k") % 2 == 1, 4.0).otherwise(2.0)
        # At the end of the range rounding can make the cosine negative.
        return F.sum(weight * F.pow(F.greatest(F.cos(at), F.lit(0.0)), F.col(dof) - 1)) * F.first(width)

    g = d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(T_STEPS))))
    agg = g.groupBy("__id").agg(*[F.first(c).alias(c) for c in tests.columns],
                                (integral(F.col("__x0")) / integral(F.lit(0.0))).alias("__p"))
    return agg.select(*tests.columns, F.least(F.col("__p"), F.lit(1.0)).alias("p_value"))



# ---------------------------------------------------------------------------
# Distributions
# ---------------------------------------------------------------------------
def quantile_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group after dropping NULLs: n, mean, q1, median (q2), q3."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = exact_quantiles(d, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group])
    m = d.groupBy(group).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    return q.join(m, group).select(group, "n", "mean", "q1", "median", "q3")


def outlier_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: n, q1, median, q3, iqr, 1.5-IQR fences, strict low/high
    outlier counts, share inside [q1, q3], shares and high per 100."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = exact_quantiles(d, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group])
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("low_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("high_fence", F.col("q3") + 1.5 * F.col("iqr")))
    j = join_back(d.select(group, value), q.select(group, "q1", "q3", "low_fence", "high_fence"), group)
    v = F.col(value)
    c = j.groupBy(group).agg(
        F.count(F.when(v < F.col("low_fence"), 1)).alias("n_outliers_low"),
        F.count(F.when(v > F.col("high_fence"), 1)).alias("n_outliers_high"),
        F.count(F.when((v >= F.col("q1")) & (v <= F.col("q3")), 1)).alias("__in_box"))
    r = q.join(c, group)
    n = F.col("n")
    return r.select(group, "n", "q1", "median", "q3", "iqr", "low_fence", "high_fence",
                    "n_outliers_low", "n_outliers_high",
                    (F.col("n_outliers_low") + F.col("n_outliers_high")).alias("n_outliers_total"),
                    (F.col("__in_box") / n).alias("pct_in_box"),
                    (F.col("n_outliers_low") / n).alias("pct_outliers_low"),
                    (F.col("n_outliers_high") / n).alias("pct_outliers_high"),
                    ((F.col("n_outliers_low") + F.col("n_outliers_high")) / n).alias("pct_outliers_total"),
                    (100 * F.col("n_outliers_high") / n).alias("outliers_high_per_100"))


def box_stats(df: DataFrame, value: str, group: str, transform: str = "none") -> DataFrame:
    """Numbers behind a box plot: quartiles and whisker ends (the most
    extreme values inside the 1.5-IQR fences). ``transform='log1p'``
    uses log1p(max(x, 0))."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    if transform == "log1p":
        d = d.withColumn(value, F.log1p(F.greatest(F.col(value).cast("double"), F.lit(0.0))))
    q = exact_quantiles(d, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group])
    q = q.withColumn("__lf", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("__hf", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = join_back(d.select(group, value), q.select(group, "__lf", "__hf"), group)
    v = F.col(value).cast("double")
    w = j.groupBy(group).agg(F.min(v).alias("min"), F.max(v).alias("max"),
                             F.min(F.when(v >= F.col("__lf"), v)).alias("whisker_low"),
                             F.max(F.when(v <= F.col("__hf"), v)).alias("whisker_high"))
    return q.join(w, group).select(group, "n", "min", "whisker_low", "q1", "median", "q3",
                                   "whisker_high", "max")


def histogram(df: DataFrame, value: str, bins: int, group: str | None = None,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of the non-null values (or a fixed
    [lo, hi] range, values outside dropped); the last bin is closed. Every
    bin is listed (dense), empty ones with count 0."""
    g = [group] if group else []
    d = df.where(F.col(value).isNotNull())
    if lo is not None:
        d = d.where((F.col(value) >= lo) & (F.col(value) <= hi))
        rng = d.select(*g).distinct() if g else None
        bounds = (rng.withColumn("__lo", F.lit(float(lo))).withColumn("__hi", F.lit(float(hi)))
                  if g else d.sparkSession.range(1).select(F.lit(float(lo)).alias("__lo"),
                                                          F.lit(float(hi)).alias("__hi")))
    else:
        bounds = d.groupBy(*g).agg(F.min(F.col(value).cast("double")).alias("__lo"),
                                   F.max(F.col(value).cast("double")).alias("__hi"))
    # One row per group: the bin grid is bins x groups rows.
    j = join_back(d.select(*g, value), bounds, g) if g else with_scalar(d.select(value), bounds)
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(
        F.least(F.floor((F.col(value) - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    counts = j.select(*g, b.alias("bin")).groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select(*g, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, g + ["bin"], "left")
    return out.select(*g, "bin", (F.col("__lo") + F.col("bin") * w).alias("bin_lo"),
                      (F.col("__lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def density_on_grid(df: DataFrame, value: str, group: str, lo: float, hi: float, points: int,
                    bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of ``value`` per group on ``points`` equally
    spaced grid points in [lo, hi]. Bandwidth fixed, or the rule of thumb
    0.9 * min(sd, IQR/1.34) * n^(-1/5) per group. Values are reduced to
    (value, count) pairs before the product with the (fixed-size) grid."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    vc = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    if bandwidth is None:
        q = exact_quantiles(d, value, {"__q1": 0.25, "__q3": 0.75}, [group])
        s = d.groupBy(group).agg(F.stddev_samp(F.col(value).cast("double")).alias("__sd"))
        bw = q.join(s, group).select(group, "n", (0.9 * F.least(F.col("__sd"), (F.col("__q3") - F.col("__q1")) / 1.34)
                                                  * F.pow(F.col("n"), -0.2)).alias("__h"))
    else:
        bw = d.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__h", F.lit(float(bandwidth)))
    step = (hi - lo) / (points - 1)
    # The grid is a fixed sequence exploded per (value, count) row.
    j = join_back(vc, bw, group).withColumn(
        "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * step)))
    z = (F.col("x") - F.col(value)) / F.col("__h")
    k = F.col("__c") * F.exp(-0.5 * z * z)
    agg = j.groupBy(group, "x").agg(F.sum(k).alias("__s"), F.first("n").alias("n"), F.first("__h").alias("h"))
    return agg.select(group, "x", (F.col("__s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi)))
                      .alias("density"), "h")


def density_on_plane(df: DataFrame, x: str, y: str, group: str, points: int = 41, bins: int = 256) -> DataFrame:
    """Gaussian kernel density of the pair (x, y) per group on points x points
    places over the ranges of x and y, with the rule-of-thumb bandwidth of each.

    Rows are binned once: ``bins`` x ``bins`` equal cells a group, a row standing at the
    centre of its cell, so whatever the rows, at most that many counts go on; the
    density differs from that of the rows themselves by the shift of at most
    half a cell. The kernel is a product, so it is summed in two passes, first
    over x and then over y, each over a fixed grid. Groups are few; rows with a
    null in any of the three do not count."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull()) \
        .select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    r = d.groupBy().agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    width = {c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins for c in "xy"}
    cell = {c: F.when(width[c] > 0, F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / width[c]), F.lit(bins - 1))).otherwise(0).cast("int") for c in "xy"}
    cells = with_scalar(d, r).groupBy("g", cell["x"].alias("i"), cell["y"].alias("j")).agg(F.count(F.lit(1)).alias("c"))
    qs = {"q1": 0.25, "q3": 0.75}
    spread = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(c).alias(f"{c}_sd") for c in "xy"])
    for c in "xy":
        q = exact_quantiles(d, c, qs, ["g"]).select("g", (F.col("q3") - F.col("q1")).alias(f"{c}_iqr"))
        spread = spread.join(q, "g")
    h = {c: (0.9 * F.least(F.col(f"{c}_sd"), F.col(f"{c}_iqr") / 1.34) * F.pow(F.col("n"), -0.2)).alias(f"{c}_h") for c in "xy"}
    scale = with_scalar(spread.select("g", "n", *h.values()), r)
    j = join_back(cells, scale, "g")
    at = lambda c, i: F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * i / (points - 1)
    centre = lambda c, i: F.col(f"{c}_lo") + (i + 0.5) * width[c]
    kernel = lambda c, place, i: F.exp(-0.5 * F.pow((at(c, place) - centre(c, i)) / F.col(f"{c}_h"), 2))
    places = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    carried = ["n", *(f"{c}_{n}" for c in "xy" for n in ("lo", "hi", "h"))]
    one = j.withColumn("a", places).groupBy("g", "a", "j").agg(
        F.sum(F.col("c") * kernel("x", F.col("a"), F.col("i"))).alias("s"), *[F.first(c).alias(c) for c in carried])
    two = one.withColumn("b", places).groupBy("g", "a", "b").agg(
        F.sum(F.col("s") * kernel("y", F.col("b"), F.col("j"))).alias("s"), *[F.first(c).alias(c) for c in carried])
    return two.select(F.col("g").alias(group), at("x", F.col("a")).alias(x), at("y", F.col("b")).alias(y),
                      (F.col("s") / (F.col("n") * F.col("x_h") * F.col("y_h") * 2 * math.pi)).alias("density"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in one aggregation (long form)."""
    pairs = [(a, b) for a in cols for b in cols]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs))
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)")


def column_extremes(df: DataFrame) -> DataFrame:
    """Numeric columns: max. String columns: max and most frequent value
    (ties -> smallest). One read: the columns become (column, whole, other,
    text) rows, counted per text and then gathered per column. Columns of one
    other type than whole numbers keep it; of several they are doubles."""
    num, st = _numeric_cols(df), [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    whole = [c for c in num if isinstance(df.schema[c].dataType, T.IntegralType)]
    kinds = {df.schema[c].dataType for c in num if c not in whole}
    kind = kinds.pop() if len(kinds) == 1 else T.DoubleType()
    none = F.lit(None)
    rows = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in whole else none).cast("long").alias("w"),
                     (F.col(c) if c in num and c not in whole else none).cast(kind).alias("x"),
                     (F.col(c) if c in st else none).cast("string").alias("v")) for c in num + st]
    long = df.select(F.inline(F.array(*rows)))
    counts = long.groupBy("column", "v").agg(F.max("w").alias("w"), F.max("x").alias("x"), F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    return counts.groupBy("column").agg(
        F.coalesce(F.max("w").cast("string"), F.max("x").cast("string"), F.max("v")).alias("max"),
        F.min_by(F.when(known, F.col("v")), F.when(known, F.struct((-F.col("n")).alias("a"), F.col("v").alias("b")))).alias("most_frequent"))


def round_half_even(c, digits: int) -> Column:
    """numpy's rounding: scale by 10^d, round half to even, scale back
    (ties are decided on the scaled binary value, as numpy does)."""
    k = float(10 ** digits)
    return F.bround(_c(c).cast("double") * k, 0) / k


def rounded(df: DataFrame, digits: dict[str, int], default: int = 2) -> DataFrame:
    """Round half-to-even: named columns to their digits, other double
    columns to ``default``."""
    out = []
    for f in df.schema.fields:
        if f.name in digits:
            out.append(round_half_even(f.name, digits[f.name]).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_even(f.name, default).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
