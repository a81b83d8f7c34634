"""Queries: voting ensembles and prediction diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prediction_files as PF
from ..operators import rules as R
from ..operators import votes as V
from ..sources import files
from . import cascades as C
from .q_cascades import OVERRIDES, VOTE_COLS, scored
from .registry import R_FRAME_CTES, SCORE_MULTIPLIERS, register, with_manifest

ID = "PassengerId"
MODELS = [f"m{m}" for m in SCORE_MULTIPLIERS]


def vote_long(d: DataFrame) -> DataFrame:
    """(id, model, vote) from the score columns of the test rows, read once."""
    votes = F.array(*[F.struct(F.lit(f"m{m}").alias("model"), (F.col(f"p{m}") >= 0.5).cast("int").alias("vote"))
                      for m in SCORE_MULTIPLIERS])
    return d.select(ID, F.inline(votes))


def test_frame(spark, sf_dir):
    d = C.test_rows(C.r_frame(scored(spark, sf_dir)))
    return d.withColumn("gender", R.baseline_gender())


_VS = " + ".join(f"CAST(p{m} >= 0.5 AS INT)" for m in SCORE_MULTIPLIERS)
_V0 = f"""
v0 AS (SELECT *, CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS gender, {_VS} AS vote_sum FROM rf WHERE split = 'test')"""


@register("vote_k_of_n", with_manifest(R_FRAME_CTES + "," + _V0 + """,
v AS (SELECT *, CASE WHEN GroupDecided THEN gender WHEN gender = 0 AND vote_sum > 2.5 THEN 1
                     WHEN gender = 1 AND vote_sum < 2.5 THEN 0 ELSE gender END AS vote_pred FROM v0)
SELECT PassengerId, vote_sum, vote_pred, vote_pred <> gender AS changed FROM v"""))
def q_vote_k_of_n(spark, sf_dir):
    d = test_frame(spark, sf_dir)
    r = V.apply_vote(d, vote_long(d), ID, "gender", "GroupDecided", 2.5, 2.5)
    return r.select(ID, "vote_sum", "vote_pred", "changed")


_ANY = """
v AS (SELECT *, CASE WHEN gender = 0 AND vote_sum > 0.5 THEN 1 WHEN gender = 1 AND vote_sum < 4.5 THEN 0
                     ELSE gender END AS vote_pred FROM v0)"""


def _any_dissent(spark, sf_dir):
    d = test_frame(spark, sf_dir).withColumn("__none", F.lit(False))
    return V.apply_vote(d, vote_long(d), ID, "gender", "__none", 0.5, 4.5)


@register("vote_any_dissent", with_manifest(R_FRAME_CTES + "," + _V0 + "," + _ANY + """
SELECT PassengerId, vote_sum, vote_pred, vote_pred <> gender AS changed FROM v"""))
def q_vote_any_dissent(spark, sf_dir):
    return _any_dissent(spark, sf_dir).select(ID, "vote_sum", "vote_pred", "changed")


@register("vote_histogram", with_manifest(R_FRAME_CTES + "," + _V0 + "," + _ANY + """,
c AS (SELECT *, (GroupSurvival = 0 AND Sex = 'female') OR (GroupSurvival = 1 AND Sex = 'male') AS InWCG FROM v
      WHERE vote_pred <> gender)
SELECT Title, InWCG, CASE WHEN Title = 'woman' THEN 5 - vote_sum ELSE vote_sum END AS votes, count(*) AS count
FROM c GROUP BY 1, 2, 3"""))
def q_vote_histogram(spark, sf_dir):
    d = _any_dissent(spark, sf_dir).where(F.col("changed"))
    in_wcg = ((F.col("GroupSurvival") == 0) & (F.col("Sex") == "female")) | \
             ((F.col("GroupSurvival") == 1) & (F.col("Sex") == "male"))
    r = V.vote_histogram(d.withColumn("InWCG", in_wcg))
    return r.select("Title", "InWCG", F.col("votes").cast("int").alias("votes"), "count")


_VL = "vl AS (" + " UNION ALL ".join(
    f"SELECT PassengerId, Title, 'm{m}' AS model, CAST(p{m} >= 0.5 AS INT) AS vote FROM rf WHERE split = 'test'"
    for m in SCORE_MULTIPLIERS) + ")"


@register("vote_model_profile", with_manifest(R_FRAME_CTES + "," + _VL + """
SELECT model, CAST(sum(CASE WHEN Title = 'man' THEN vote ELSE 0 END) AS BIGINT) AS men_1,
       CAST(sum(CASE WHEN Title = 'woman' THEN 1 - vote ELSE 0 END) AS BIGINT) AS women_0,
       CAST(sum(CASE WHEN Title = 'boy' THEN vote ELSE 0 END) AS BIGINT) AS boys_1,
       CAST(sum(CASE WHEN Title = 'man' THEN vote ELSE 0 END) + sum(CASE WHEN Title = 'woman' THEN 1 - vote ELSE 0 END)
            + sum(CASE WHEN Title = 'boy' THEN vote ELSE 0 END) AS BIGINT) AS total
FROM vl GROUP BY ROLLUP (model)"""))
def q_vote_model_profile(spark, sf_dir):
    d = test_frame(spark, sf_dir)
    return V.model_profile(vote_long(d), d, ID)


_MEMB_COLS = ", ".join(f"CAST(p{m} >= 0.5 AS INT) AS m{m}" for m in SCORE_MULTIPLIERS)


@register("vote_membership", with_manifest(R_FRAME_CTES + "," + _V0 + f""",
c AS (SELECT *, CASE WHEN Title = 'man' AND p37 >= 0.9 THEN 'maleLive'
                     WHEN Title = 'woman' AND FamilySize = 1 AND NOT GroupDecided AND p101 <= 0.08 THEN 'femalePerish' END AS kind
      FROM v0)
SELECT PassengerId, kind, CASE WHEN (kind = 'maleLive' AND vote_sum > 2.5) OR (kind = 'femalePerish' AND vote_sum < 2.5)
                               THEN 'YES' ELSE 'NO' END AS in_mega, {_MEMB_COLS}
FROM c WHERE kind IS NOT NULL"""))
def q_vote_membership(spark, sf_dir):
    d = test_frame(spark, sf_dir)
    kind = (F.when((F.col("Title") == "man") & (F.col("p37") >= C.MEN_THRESHOLD), "maleLive")
             .when((F.col("Title") == "woman") & (F.col("FamilySize") == 1) & ~F.col("GroupDecided")
                   & (F.col("p101") <= C.WOMEN_THRESHOLD), "femalePerish"))
    rows = d.withColumn("kind", kind).where(F.col("kind").isNotNull())
    votes = vote_long(rows)
    wide = votes.groupBy(ID).pivot("model", MODELS).agg(F.first("vote"))
    sums = V.vote_sums(votes, ID)
    r = rows.select(ID, "kind").join(sums, ID).join(wide, ID)
    yes = ((F.col("kind") == "maleLive") & (F.col("vote_sum") > 2.5)) | \
          ((F.col("kind") == "femalePerish") & (F.col("vote_sum") < 2.5))
    return r.select(ID, "kind", F.when(yes, "YES").otherwise("NO").alias("in_mega"), *MODELS)


_GP = ("CASE WHEN Title = 'boy' AND GroupSurvival = 1 THEN 1 WHEN Title = 'woman' AND GroupSurvival = 0 THEN 0 "
       "WHEN Sex = 'female' THEN 1 ELSE 0 END")


@register("diff_vs_baseline", with_manifest(R_FRAME_CTES + f""",
p AS (SELECT Sex, {_GP} AS prediction, CASE WHEN Sex = 'female' THEN 1 ELSE 0 END AS base FROM rf WHERE split = 'test')
SELECT Sex, CASE WHEN prediction = 1 THEN 'to_1' ELSE 'to_0' END AS direction, count(*) AS count
FROM p WHERE prediction <> base GROUP BY 1, 2"""))
def q_diff_vs_baseline(spark, sf_dir):
    d = C.test_rows(C.r_frame(scored(spark, sf_dir)))
    p = R.run_cascade(d, R.baseline_gender(), [R.group_flip()]).withColumn("base", R.baseline_gender())
    diff = p.where(F.col("prediction") != F.col("base"))
    return diff.groupBy("Sex", F.when(F.col("prediction") == 1, "to_1").otherwise("to_0").alias("direction")) \
        .agg(F.count(F.lit(1)).alias("count"))


@register("prediction_profile", with_manifest(R_FRAME_CTES + f""",
p AS (SELECT *, {_GP} AS prediction FROM rf WHERE split = 'test'),
seg AS (SELECT Title AS segment, prediction FROM p
        UNION ALL SELECT 'solo_female', prediction FROM p WHERE Title = 'woman' AND FamilySize = 1
        UNION ALL SELECT 'group_handled', prediction FROM p WHERE InKnownGroup
        UNION ALL SELECT 'overall', prediction FROM p)
SELECT segment, count(*) AS n, CAST(sum(prediction) AS BIGINT) AS positives, round(avg(prediction), 6) AS rate
FROM seg GROUP BY segment"""))
def q_prediction_profile(spark, sf_dir):
    d = C.test_rows(C.r_frame(scored(spark, sf_dir)))
    p = R.run_cascade(d, R.baseline_gender(), [R.group_flip()])
    segs = {"man": F.col("Title") == "man", "woman": F.col("Title") == "woman", "boy": F.col("Title") == "boy",
            "solo_female": (F.col("Title") == "woman") & (F.col("FamilySize") == 1),
            "group_handled": F.col("InKnownGroup"), "overall": F.lit(True)}
    aggs = []
    for k, c in segs.items():
        aggs += [F.count(F.when(c, 1)).alias(f"n_{k}"), F.sum(F.when(c, F.col("prediction"))).alias(f"p_{k}")]
    a = p.agg(*aggs)
    stack = ", ".join(f"'{k}', n_{k}, p_{k}" for k in segs)
    r = a.selectExpr(f"stack({len(segs)}, {stack}) AS (segment, n, positives)").where(F.col("n") > 0)
    return r.select("segment", "n", F.col("positives").cast("long").alias("positives"),
                    F.round(F.col("positives") / F.col("n"), 6).alias("rate"))


_SETS = ["gender", "group", "mega", "group_models_vote", "solo_female"]


_SETS_CTES = R_FRAME_CTES + "," + _V0 + f""",
v AS (SELECT *, CASE WHEN gender = 0 AND vote_sum > 2.5 THEN 1 WHEN gender = 1 AND vote_sum < 2.5 THEN 0
                     ELSE gender END AS vote_pred, {_GP} AS group_pred,
        CASE WHEN regexp_matches(Name, ',\\s*([^.]+)\\.') THEN lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) END AS t FROM v0),
w AS (SELECT PassengerId, gender, group_pred AS "group",
        CASE WHEN PassengerId = 893 THEN 1 WHEN NOT GroupDecided AND vote_pred <> gender THEN vote_pred
             WHEN GroupDecided THEN group_pred ELSE gender END AS mega,
        CASE WHEN NOT GroupDecided AND vote_pred <> gender THEN 0
             WHEN Title = 'woman' AND FamilySize = 1 AND NOT GroupDecided THEN CAST(p101 > 0.08 AS INT)
             WHEN Title = 'man' THEN CAST(p37 >= 0.9 AS INT) ELSE group_pred END AS group_models_vote,
        CASE WHEN (CASE WHEN t IN ('miss', 'mrs', 'ms', 'mme', 'mlle', 'lady', 'the countess') THEN 'woman' ELSE t END) = 'woman'
                  AND FamilySize = 1 THEN CAST(p101 > 0.25 AS INT) ELSE 1 END AS solo_female FROM v)"""


def _pairs_sql(names: list[str], table: str) -> str:
    return "\n" + " UNION ALL ".join(
        f"SELECT '{a}' AS set_a, '{b}' AS set_b, count(*) AS n, count(CASE WHEN \"{a}\" <> \"{b}\" THEN 1 END) AS n_diff, "
        f"round(1 - count(CASE WHEN \"{a}\" <> \"{b}\" THEN 1 END) / count(*), 6) AS agreement, "
        f"count(CASE WHEN \"{a}\" <> \"{b}\" THEN 1 END) = 0 AS identical FROM {table}"
        for i, a in enumerate(names) for b in names[i + 1:])


def _prediction_columns(spark, sf_dir):
    ov = spark.createDataFrame(OVERRIDES, "id long, value int")
    return C.prediction_sets(C.r_frame(scored(spark, sf_dir)), VOTE_COLS, ov)


@register("compare_prediction_sets", with_manifest(_SETS_CTES + _pairs_sql(_SETS, "w")))
def q_compare_prediction_sets(spark, sf_dir):
    r = V.agreement_of_columns(_prediction_columns(spark, sf_dir), _SETS)
    return r.withColumn("agreement", F.round("agreement", 6))


def _stored_sets(spark, sf_dir):
    """The five sets, and the first once more, written as files and read back."""
    named = [(n, n) for n in _SETS] + [("gender_again", "gender")]
    long = _prediction_columns(spark, sf_dir).select(
        ID, F.inline(F.array(*[F.struct(F.lit(n).alias("set"), F.col(f"`{c}`").cast("int").alias("Survived")) for n, c in named])))
    return PF.read_sets(spark, PF.write_sets(long, files.shared_path(spark, "prediction-sets")))


_STORED = sorted([*_SETS, "gender_again"])
_STORED_CTES = _SETS_CTES + ",\nst AS (SELECT *, gender AS gender_again FROM w)"


@register("compare_prediction_files", with_manifest(_STORED_CTES + _pairs_sql(_STORED, "st")))
def q_compare_prediction_files(spark, sf_dir):
    """Pairwise agreement of stored prediction files, read as rows."""
    return PF.agreement(_stored_sets(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6))


@register("duplicate_prediction_files", with_manifest(_STORED_CTES + ",\nl AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"set\", PassengerId, CAST(\"{n}\" AS INT) AS v FROM st" for n in _STORED) + """),
d AS (SELECT "set", count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS positives,
        string_agg(PassengerId || ':' || v, ',' ORDER BY PassengerId) AS content FROM l GROUP BY 1)
SELECT "set", n_rows, positives, min("set") OVER (PARTITION BY content) AS first_set,
       count(*) OVER (PARTITION BY content) AS n_equal FROM d"""))
def q_duplicate_prediction_files(spark, sf_dir):
    """Stored prediction files with the first file of equal content."""
    return PF.digests(_stored_sets(spark, sf_dir)).drop("digest")
