"""Queries: grouping, linkage and the group model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import groups as G
from ..operators import ordered, rules as R
from ..operators.joins import join_back
from ..sources.manifest import manifest
from .registry import WCG_CTES, register, with_manifest

ID = "PassengerId"
# Fixed override list of the reference: 893 takes the group of 775, and
# 893's group outcome is set to 1.
LINK_PAIRS = [(893, 775)]
OUTCOME_OVERRIDES = [(893, 1.0)]


def wcg(spark, sf_dir, attach="first_row", scope="combined", link=False, ungrouped="own_mean"):
    """Woman-child-group frame with group rates (combined scope)."""
    m = manifest(spark, sf_dir)
    pairs = spark.createDataFrame(LINK_PAIRS, "id long, source_id long") if link else None
    d = G.wcg_frame(m, scope=scope, attach=attach, link_pairs=pairs, recount=False)
    d = G.annotate_groups(d, ungrouped=ungrouped)
    return d.withColumn("FamilySize", fx.family_size())


def cascade_group_frame(spark, sf_dir):
    d = wcg(spark, sf_dir)
    return R.run_cascade(d, R.baseline_gender(), [R.group_flip()])


# ---------------------------------------------------------------------------
@register("group_key", with_manifest(WCG_CTES + "SELECT PassengerId, gid0 AS GroupId FROM k"))
def q_group_key(spark, sf_dir):
    d = G.engineer_keys(manifest(spark, sf_dir))
    return G.add_group_key(d).select(ID, "GroupId")


@register("group_size_filter", with_manifest(WCG_CTES + """
SELECT PassengerId, gid1 AS GroupId,
       CASE WHEN gid1 IS NOT NULL THEN count(*) OVER (PARTITION BY gid1) END AS GroupFreq FROM s"""))
def q_group_size_filter(spark, sf_dir):
    d = G.add_group_key(G.engineer_keys(manifest(spark, sf_dir)))
    return G.filter_group_size(d).select(ID, "GroupId", F.col("GroupFreq").cast("long"))


@register("ticket_key", with_manifest(WCG_CTES + "SELECT PassengerId, TicketId FROM k"))
def q_ticket_key(spark, sf_dir):
    d = G.engineer_keys(manifest(spark, sf_dir))
    return G.add_ticket_key(d).select(ID, "TicketId")


def _attached(spark, sf_dir, form, exact=False):
    d = G.add_group_key(G.engineer_keys(manifest(spark, sf_dir)))
    d = G.filter_group_size(d)
    if exact:
        d = G.add_exact_ticket_key(d)
    else:
        d = G.add_ticket_key(d)
    return G.attach_relatives(d, form=form).select(ID, "GroupId", "Attached")


@register("attach_relatives_first_grouped", with_manifest(WCG_CTES + """,
fg AS (SELECT *, first_value(gid1 IGNORE NULLS) OVER (PARTITION BY TicketId ORDER BY PassengerId
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fgid FROM s)
SELECT PassengerId, CASE WHEN Title <> 'man' AND gid1 IS NULL THEN fgid ELSE gid1 END AS GroupId,
       (Title <> 'man' AND gid1 IS NULL AND fgid IS NOT NULL) AS Attached FROM fg"""))
def q_attach_first_grouped(spark, sf_dir):
    return _attached(spark, sf_dir, "first_grouped")


@register("attach_relatives_first_row", with_manifest(WCG_CTES + "SELECT PassengerId, GroupId, Attached FROM g"))
def q_attach_first_row(spark, sf_dir):
    return _attached(spark, sf_dir, "first_row")


@register("attach_relatives_not_self", with_manifest(WCG_CTES + """,
ns AS (SELECT *, (Title <> 'man' AND gid1 IS NULL) AS cand,
         row_number() OVER (PARTITION BY TicketId ORDER BY PassengerId) AS rn,
         first_value(gid1) OVER w AS g1,
         nth_value(gid1, 2) OVER w AS g2,
         first_value(Title <> 'man' AND gid1 IS NULL) OVER w AS c1
       FROM s WINDOW w AS (PARTITION BY TicketId ORDER BY PassengerId
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
nv AS (SELECT *, CASE WHEN rn = 1 THEN g2 WHEN c1 THEN g2 ELSE g1 END AS newg FROM ns)
SELECT PassengerId, CASE WHEN cand THEN newg ELSE gid1 END AS GroupId,
       (cand AND newg IS NOT NULL) AS Attached FROM nv"""))
def q_attach_not_self(spark, sf_dir):
    return _attached(spark, sf_dir, "not_self")


@register("attach_relatives_exact", with_manifest(WCG_CTES + """,
ex AS (SELECT *, Ticket || '-' || CAST(Pclass AS VARCHAR) || '-' || CAST(CAST(Fare AS DECIMAL(12,2)) AS VARCHAR) || '-'
               || coalesce(Embarked, 'S') AS TX FROM s),
fx AS (SELECT *, first_value(gid1 IGNORE NULLS) OVER (PARTITION BY TX ORDER BY PassengerId
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fgid FROM ex)
SELECT PassengerId, CASE WHEN Title <> 'man' AND gid1 IS NULL THEN CASE WHEN TX IS NOT NULL THEN fgid END ELSE gid1 END AS GroupId,
       (Title <> 'man' AND gid1 IS NULL AND TX IS NOT NULL AND fgid IS NOT NULL) AS Attached FROM fx"""))
def q_attach_exact(spark, sf_dir):
    return _attached(spark, sf_dir, "exact", exact=True)


@register("link_override", with_manifest(WCG_CTES.replace(
    "s AS (SELECT *, CASE WHEN gid0",
    "lk AS (SELECT * REPLACE (CASE WHEN PassengerId = 893 AND EXISTS (SELECT 1 FROM k k2 WHERE k2.PassengerId = 775) "
    "THEN (SELECT k2.gid0 FROM k k2 WHERE k2.PassengerId = 775) ELSE gid0 END AS gid0) FROM k),\n"
    "s AS (SELECT *, CASE WHEN gid0").replace("END AS gid1\n      FROM k)", "END AS gid1\n      FROM lk)")
    + "SELECT PassengerId, GroupId FROM g"))
def q_link_override(spark, sf_dir):
    m = manifest(spark, sf_dir)
    pairs = spark.createDataFrame(LINK_PAIRS, "id long, source_id long")
    d = G.add_group_key(G.engineer_keys(m))
    d = G.link_override(d, pairs)
    d = G.add_ticket_key(G.filter_group_size(d))
    return G.attach_relatives(d, form="first_row").select(ID, "GroupId")


@register("outcome_override", with_manifest(WCG_CTES + """
SELECT PassengerId, round(CASE WHEN PassengerId = 893 THEN 1.0 ELSE GroupSurvival END, 6) AS GroupSurvival FROM gs"""))
def q_outcome_override(spark, sf_dir):
    d = wcg(spark, sf_dir)
    ov = spark.createDataFrame(OUTCOME_OVERRIDES, "id long, value double")
    d = G.outcome_override(d, ov, "GroupSurvival")
    return d.select(ID, F.round("GroupSurvival", 6).alias("GroupSurvival"))


_REG_SQL = """
SELECT GroupId, count(*) AS n_members, count(Survived) AS n_labelled, round(avg(Survived), 6) AS rate
FROM g WHERE GroupId IS NOT NULL GROUP BY GroupId"""


def _registry(spark, sf_dir, min_labelled=1):
    d = G.wcg_frame(manifest(spark, sf_dir), recount=False)
    return G.group_registry(d, min_labelled=min_labelled)


@register("group_outcome_rate", with_manifest(WCG_CTES + _REG_SQL + " HAVING count(Survived) >= 1"))
def q_group_outcome_rate(spark, sf_dir):
    return _registry(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@register("group_outcome_definitive", with_manifest(WCG_CTES + ", reg AS (" + _REG_SQL + """)
SELECT GroupId, n_members, n_labelled, rate, CAST(rate AS INT) AS outcome FROM reg
WHERE n_labelled >= 2 AND rate IN (0, 1)"""))
def q_group_outcome_definitive(spark, sf_dir):
    return G.outcome_definitive(_registry(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@register("group_outcome_majority", with_manifest(WCG_CTES + ", reg AS (" + _REG_SQL.replace(
    "round(avg(Survived), 6)", "avg(Survived)") + """)
SELECT GroupId, n_members, n_labelled, round(rate, 6) AS rate,
       CASE WHEN rate >= 0.75 THEN 1 WHEN rate <= 0.25 THEN 0 END AS outcome FROM reg
WHERE n_labelled >= 2 AND (rate >= 0.75 OR rate <= 0.25)"""))
def q_group_outcome_majority(spark, sf_dir):
    return G.outcome_majority(_registry(spark, sf_dir), 0.75, 0.25).withColumn("rate", F.round("rate", 6))


@register("group_outcome_with_fallback", with_manifest(WCG_CTES + """
SELECT PassengerId, GroupId, round(GroupSurvival, 6) AS GroupSurvival FROM gs"""))
def q_group_outcome_with_fallback(spark, sf_dir):
    return wcg(spark, sf_dir).select(ID, "GroupId", F.round("GroupSurvival", 6).alias("GroupSurvival"))


@register("family_unanimity", with_manifest("""
f AS (SELECT lower(trim(split_part(Name, ',', 1))) || '_' ||
             CAST(coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS VARCHAR) AS FamilyID,
             (lower(Sex) = 'female' OR lower(trim(regexp_extract(Name, ',\\s*([^.]+)\\.', 1))) = 'master') AS fb,
             Survived AS y
      FROM manifest WHERE Survived IS NOT NULL)
SELECT FamilyID, bool_or(fb) AS has_fb,
       coalesce(bool_and(CASE WHEN fb THEN y = 1 END), false) AS all_fb_live,
       coalesce(bool_and(CASE WHEN fb THEN y = 0 END), false) AS all_fb_die
FROM f GROUP BY FamilyID"""))
def q_family_unanimity(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("FamilyID", fx.family_id("Name"))
    return G.family_unanimity(m)


@register("extend_to_adult_men", with_manifest(WCG_CTES + """,
dead AS (SELECT GroupId FROM r WHERE grate = 0)
SELECT PassengerId, round(CASE WHEN Title = 'man' AND EXISTS (SELECT 1 FROM dead WHERE dead.GroupId =
         coalesce(Surname, 'NA') || '-' || CAST(Pclass AS VARCHAR) || '-' || coalesce(TicketMod, 'NA') || '-'
         || FareTxt || '-' || coalesce(Embarked, 'NA')) THEN 0.0 ELSE GroupSurvival END, 6) AS GroupSurvival
FROM gs"""))
def q_extend_to_adult_men(spark, sf_dir):
    d = wcg(spark, sf_dir)
    d = G.add_group_key(d, out="GroupId2", mask_men=False)
    reg = G.group_registry(d)
    d = G.extend_to_adult_men(d, reg)
    return d.select(ID, F.round("GroupSurvival", 6).alias("GroupSurvival"))


@register("group_name", with_manifest(WCG_CTES + """
SELECT PassengerId, split_part(GroupId, '-', 1) AS GroupName FROM g WHERE GroupId IS NOT NULL"""))
def q_group_name(spark, sf_dir):
    d = G.wcg_frame(manifest(spark, sf_dir), recount=False).where(F.col("GroupId").isNotNull())
    return d.select(ID, G.group_name().alias("GroupName"))


@register("group_roster", with_manifest(WCG_CTES + """
SELECT GroupId, PassengerId, split_part(GroupId, '-', 1) AS GroupName, Title,
  CASE WHEN Attached AND Survived IS NULL THEN 5 WHEN Attached AND Survived = 0 THEN -1
       WHEN Attached AND Survived = 1 THEN 2 WHEN Survived = 0 THEN 0 WHEN Survived = 1 THEN 1
       WHEN Title = 'woman' THEN 3 WHEN Title = 'boy' THEN 4 END AS status,
  CAST((dense_rank() OVER (ORDER BY GroupId) - 1) // 27 + 1 AS BIGINT) AS page
FROM g WHERE GroupId IS NOT NULL"""))
def q_group_roster(spark, sf_dir):
    d = G.wcg_frame(manifest(spark, sf_dir), recount=False).where(F.col("GroupId").isNotNull())
    ranks = ordered.dense_rank_distinct(d, "GroupId", "grank")
    d = join_back(d, ranks, "GroupId")
    return d.select("GroupId", ID, G.group_name().alias("GroupName"), "Title",
                    G.roster_status().alias("status"),
                    (F.floor((F.col("grank") - 1) / 27) + 1).cast("long").alias("page"))


@register("group_census", with_manifest(WCG_CTES + """,
gr AS (SELECT GroupId, count(Survived) AS nl FROM g WHERE GroupId IS NOT NULL GROUP BY GroupId)
SELECT (SELECT count(*) FROM gr) AS n_groups,
       (SELECT count(*) FROM g WHERE GroupId IS NOT NULL) AS n_members,
       (SELECT count(*) FROM g WHERE Attached) AS n_attached,
       (SELECT count(*) FROM gr WHERE nl = 0) AS n_unlabelled_groups"""))
def q_group_census(spark, sf_dir):
    d = G.wcg_frame(manifest(spark, sf_dir), recount=False)
    per_group = (d.where(F.col("GroupId").isNotNull()).groupBy("GroupId")
                  .agg(F.count(F.lit(1)).alias("n"), F.count("Survived").alias("nl"),
                       F.sum(F.col("Attached").cast("int")).alias("na")))
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").cast("long").alias("n_members"),
                         F.sum("na").cast("long").alias("n_attached"),
                         F.count(F.when(F.col("nl") == 0, 1)).alias("n_unlabelled_groups"))
