"""Queries: feature derivation and missing values (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import groups as G
from ..operators import impute as I
from ..operators.joins import add_key_count, join_back
from ..sources.manifest import manifest
from .registry import register, with_manifest

ID = "PassengerId"
T_RAW = r"trim(regexp_extract(Name, ',\s*([^.]+)\.', 1))"
T_HIT = r"regexp_matches(Name, ',\s*([^.]+)\.')"
FS = "(coalesce(SibSp, 0) + coalesce(Parch, 0) + 1)"


def _simple(key: str, cols: list[tuple[str, object, str]]):
    """Register a row-wise feature query: (name, spark column, SQL expr)."""
    sql = with_manifest("SELECT PassengerId, " + ", ".join(f'{s} AS "{n}"' for n, _, s in cols)
                        + " FROM manifest")

    def q(spark, sf_dir):
        return manifest(spark, sf_dir).select(ID, *[c().alias(n) for n, c, _ in cols])
    q.__name__ = f"q_{key}"
    q.__doc__ = "Row-wise column expressions: " + ", ".join(n for n, _, _ in cols) + "."
    register(key, sql)(q)


_simple("feat_title_raw", [
    ("title_unknown", lambda: fx.title_raw(missing="Unknown"), f"CASE WHEN {T_HIT} THEN {T_RAW} ELSE 'Unknown' END"),
    ("title_empty", lambda: fx.title_raw(missing=""), f"CASE WHEN {T_HIT} THEN {T_RAW} ELSE '' END"),
    ("title_null", lambda: fx.title_raw(missing=None), f"CASE WHEN {T_HIT} THEN {T_RAW} END"),
    ("title_lower", lambda: fx.title_raw(missing=None, lower=True), f"CASE WHEN {T_HIT} THEN lower({T_RAW}) END"),
])

_NORM_SQL = ("CASE lower(" + T_RAW + ") WHEN 'ms' THEN 'miss' WHEN 'mlle' THEN 'miss' WHEN 'mme' THEN 'mrs' "
             "WHEN 'lady' THEN 'rare' WHEN 'the countess' THEN 'rare' WHEN 'jonkheer' THEN 'rare' "
             "WHEN 'sir' THEN 'rare' WHEN 'don' THEN 'rare' WHEN 'dona' THEN 'rare' WHEN 'dr' THEN 'rare' "
             "WHEN 'rev' THEN 'rare' WHEN 'major' THEN 'rare' WHEN 'col' THEN 'rare' WHEN 'capt' THEN 'rare' "
             "ELSE lower(" + T_RAW + ") END")
_simple("feat_title_normalized", [("title_norm", lambda: fx.title_normalized(), _NORM_SQL)])
_simple("feat_title_woman_map", [(
    "title_w", lambda: fx.title_woman_map(),
    f"CASE WHEN NOT {T_HIT} THEN NULL WHEN lower({T_RAW}) IN ('miss', 'mrs', 'ms', 'mme', 'mlle', 'lady', "
    f"'the countess') THEN 'woman' ELSE lower({T_RAW}) END")])
_simple("feat_person_type", [
    ("type_master_wins", lambda: fx.person_type(precedence="master"),
     "CASE WHEN Name LIKE '%Master%' THEN 'boy' WHEN Sex = 'female' THEN 'woman' ELSE 'man' END"),
    ("type_female_wins", lambda: fx.person_type(precedence="female"),
     "CASE WHEN Sex = 'female' THEN 'woman' WHEN Name LIKE '%Master%' THEN 'boy' ELSE 'man' END"),
])
_simple("feat_is_boy_is_female", [
    ("IsBoy", lambda: fx.is_boy(), f"coalesce(({_NORM_SQL}) = 'master', false)"),
    ("IsFemale", lambda: fx.is_female(), "coalesce(lower(Sex) = 'female', false)"),
])
_BOY = "coalesce(lower(Sex) = 'male' AND Age < 18, false)"
_MAS = f"coalesce({T_HIT} AND lower({T_RAW}) = 'master', false)"
_simple("feat_boy_flags", [
    ("boy_master", lambda: fx.boy_flags()[0], f"CAST({_BOY} AND {_MAS} AS INT)"),
    ("boy_nonmaster", lambda: fx.boy_flags()[1], f"CAST({_BOY} AND NOT {_MAS} AS INT)"),
])
_simple("feat_surname", [
    ("Surname", lambda: fx.surname(), "regexp_extract(Name, '^([^,]*),', 1)"),
    ("SurnameWhole", lambda: fx.surname(no_comma="whole"), "split_part(Name, ',', 1)"),
])
_simple("feat_display_name", [(
    "DisplayName", lambda: fx.display_name(),
    "CASE WHEN Name IS NULL THEN 'Unknown' WHEN len(string_split(Name, ', ')) < 2 THEN Name "
    "WHEN strpos(trim(string_split(Name, ', ')[2]), '.') > 0 THEN "
    "trim(split_part(trim(string_split(Name, ', ')[2]), '.', 1)) || '. ' || trim(string_split(Name, ', ')[1]) "
    "ELSE 'No Title ' || trim(string_split(Name, ', ')[1]) END")])
_simple("feat_recode_default", [(
    "SexCode", lambda: fx.recode_sex(),
    "CASE Sex WHEN 'male' THEN 'M' WHEN 'female' THEN 'F' WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' "
    "WHEN 'MALE' THEN 'M' WHEN 'FEMALE' THEN 'F' ELSE 'Unknown' END")])
_simple("feat_family_size", [
    ("FamilySize", lambda: fx.family_size(fill_nulls=True), FS),
    ("FamilySizeStrict", lambda: fx.family_size(fill_nulls=False), "SibSp + Parch + 1"),
])
_simple("feat_is_alone", [("IsAlone", lambda: fx.is_alone(fx.family_size()), f"CAST({FS} = 1 AS INT)")])
_simple("feat_fare_per_person", [(
    "FarePerPerson", lambda: F.round(fx.fare_per_person(), 9),
    f"round(coalesce(Fare, 0.0) / CASE WHEN {FS} = 0 THEN 1 ELSE {FS} END, 9)")])
_simple("feat_has_cabin", [("HasCabin", lambda: fx.has_cabin(), "Cabin IS NOT NULL")])
_simple("feat_deck", [
    ("Deck", lambda: fx.deck(missing="U"), "coalesce(substr(Cabin, 1, 1), 'U')"),
    ("DeckOrNull", lambda: fx.deck(missing=None), "substr(Cabin, 1, 1)"),
])
_simple("feat_ticket_prefix", [(
    "TicketPrefix", lambda: fx.ticket_prefix(),
    "CASE WHEN regexp_replace(coalesce(Ticket, 'NA'), '[^A-Za-z]', '', 'g') = '' THEN 'NONE' "
    "ELSE regexp_replace(coalesce(Ticket, 'NA'), '[^A-Za-z]', '', 'g') END")])
_simple("feat_ticket_mod", [
    ("TicketMod", lambda: fx.ticket_mod(), "regexp_replace(Ticket, '.$', 'X')"),
    ("TicketModDot", lambda: fx.ticket_mod(variant="dot"), "replace(Ticket, '.', 'X')"),
])
_simple("feat_family_id", [(
    "FamilyID", lambda: fx.family_id(), f"lower(trim(split_part(Name, ',', 1))) || '_' || CAST({FS} AS VARCHAR)")])
_FB = [0, 1, 2, 4, 8, 20]
_FB_L = ["1", "2", "3-4", "5-8", "9+"]


def _rc_sql(x, edges, labels):
    return "CASE " + " ".join(f"WHEN {x} > {a} AND {x} <= {b} THEN '{lab}'"
                              for (a, b), lab in zip(zip(edges, edges[1:]), labels)) + " END"


def _lc_sql(x, edges, labels):
    parts = []
    for (a, b), lab in zip(zip(edges, edges[1:]), labels):
        parts.append(f"WHEN {x} >= {a}" + ("" if b is None else f" AND {x} < {b}") + f" THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


_simple("feat_bin_right_closed", [
    ("FamilyBin", lambda: fx.bin_right_closed(fx.family_size(fill_nulls=False), _FB, _FB_L), _rc_sql("SibSp + Parch + 1", _FB, _FB_L)),
    ("AgeGroup2", lambda: fx.bin_right_closed("Age", [0, 16, 100], ["Child", "Adult"]), _rc_sql("Age", [0, 16, 100], ["Child", "Adult"])),
    ("AgeGroup4", lambda: fx.bin_right_closed("Age", [0, 16, 30, 50, 100], ["Child", "Young", "Middle", "Old"]),
     _rc_sql("Age", [0, 16, 30, 50, 100], ["Child", "Young", "Middle", "Old"])),
])
_AGE_E, _AGE_L = [0, 20, 36, 51, None], ["Kids and Teens", "Adults", "Middle-Aged", "Seniors"]
_FARE_E, _FARE_L = [0, 8, 15, 30, 60, None], ["$", "$$", "$$$", "$$$$", "$$$$$"]
_simple("feat_bin_left_closed", [
    ("Age_Bin", lambda: fx.bin_left_closed("Age", _AGE_E, _AGE_L), _lc_sql("Age", _AGE_E, _AGE_L)),
    ("Fare_Bin", lambda: fx.bin_left_closed("Fare", _FARE_E, _FARE_L), _lc_sql("Fare", _FARE_E, _FARE_L)),
])
_simple("feat_dummies", [
    ("Sex_male", lambda: (F.col("Sex") == "male").cast("int"), "CAST(Sex = 'male' AS INT)"),
    ("Embarked_Q", lambda: F.coalesce((F.col("Embarked") == "Q").cast("int"), F.lit(0)), "coalesce(CAST(Embarked = 'Q' AS INT), 0)"),
    ("Embarked_S", lambda: F.coalesce((F.col("Embarked") == "S").cast("int"), F.lit(0)), "coalesce(CAST(Embarked = 'S' AS INT), 0)"),
    ("Title_boy", lambda: (fx.person_type(precedence="female") == "boy").cast("int"),
     "CAST(Sex <> 'female' AND Name LIKE '%Master%' AS INT)"),
    ("Title_woman", lambda: (fx.person_type(precedence="female") == "woman").cast("int"), "CAST(Sex = 'female' AS INT)"),
])


# --- features that need a per-key count or a scalar ------------------------
@register("feat_ticket_freq", with_manifest("""
SELECT PassengerId,
  CASE WHEN Ticket IS NOT NULL THEN count(*) OVER (PARTITION BY Ticket) END AS TicketFreq,
  CASE WHEN Ticket IS NOT NULL THEN count(*) OVER (PARTITION BY Survived IS NULL, Ticket) END AS TicketFreqSplit
FROM manifest"""))
def q_feat_ticket_freq(spark, sf_dir):
    d = G.with_split(manifest(spark, sf_dir))
    d = add_key_count(d, ["Ticket"], "TicketFreq", spread_on=ID)
    d = add_key_count(d, ["split", "Ticket"], "TicketFreqSplit", spread_on=ID)
    return d.select(ID, "TicketFreq", "TicketFreqSplit")


@register("feat_fare_adj", with_manifest("""
SELECT PassengerId, round(Fare / count(*) OVER (PARTITION BY Ticket), 9) AS FareAdj FROM manifest"""))
def q_feat_fare_adj(spark, sf_dir):
    d = add_key_count(manifest(spark, sf_dir), ["Ticket"], "TicketFreq", spread_on=ID)
    return d.select(ID, F.round(F.col("Fare") / F.col("TicketFreq"), 9).alias("FareAdj"))


@register("feat_male_xy", with_manifest(f"""
SELECT PassengerId, round(Fare / (count(*) OVER (PARTITION BY Ticket) * 10), 9) AS x1,
       round({FS} + Age / 70, 9) AS x2 FROM manifest"""))
def q_feat_male_xy(spark, sf_dir):
    d = add_key_count(manifest(spark, sf_dir), ["Ticket"], "TicketFreq", spread_on=ID)
    d = d.withColumn("FamilySize", fx.family_size())
    x1, x2 = fx.male_xy()
    return d.select(ID, F.round(x1, 9).alias("x1"), F.round(x2, 9).alias("x2"))


@register("feat_female_xy", with_manifest("""
SELECT PassengerId, round(Fare / count(*) OVER (PARTITION BY Ticket) / 10, 9) AS x1,
       round(Age / 15, 9) AS x2 FROM manifest"""))
def q_feat_female_xy(spark, sf_dir):
    d = add_key_count(manifest(spark, sf_dir), ["Ticket"], "TicketFreq", spread_on=ID)
    x1, x2 = fx.female_xy(F.col("Fare") / F.col("TicketFreq"))
    return d.select(ID, F.round(x1, 9).alias("x1"), F.round(x2, 9).alias("x2"))


@register("feat_products", with_manifest("""
SELECT PassengerId, round(coalesce(Fare, 0) * coalesce(Pclass, 0), 9) AS FareTimesClass,
       round(coalesce(Age, (SELECT median(Age) FROM manifest)) * coalesce(Pclass, 0), 9) AS AgeClass FROM manifest"""))
def q_feat_products(spark, sf_dir):
    m = manifest(spark, sf_dir)
    d = I.impute_median(m, ["Age"], suffix="_f")
    return d.select(ID, F.round(F.coalesce("Fare", F.lit(0.0)) * F.coalesce("Pclass", F.lit(0)), 9).alias("FareTimesClass"),
                    F.round(F.col("Age_f") * F.coalesce("Pclass", F.lit(0)), 9).alias("AgeClass"))


@register("feat_age_sex_interaction", with_manifest("""
SELECT PassengerId, round(coalesce(Age, (SELECT median(Age) FROM manifest)) * CAST(Sex = 'male' AS INT), 9)
       AS Age_Sex_interaction FROM manifest"""))
def q_feat_age_sex(spark, sf_dir):
    d = I.impute_median(manifest(spark, sf_dir), ["Age"], suffix="_f")
    return d.select(ID, F.round(F.col("Age_f") * (F.col("Sex") == "male").cast("int"), 9).alias("Age_Sex_interaction"))


def _ew_sql(c):
    lo, hi = f"(SELECT min({c}) FROM manifest)", f"(SELECT max({c}) FROM manifest)"
    w = f"(({hi} - {lo}) / 5)"
    return (f"CAST(CASE WHEN {c} IS NULL THEN NULL WHEN {w} = 0 THEN 0 "
            f"ELSE least(greatest(ceil(({c} - {lo}) / {w}) - 1, 0), 4) END AS INT)")


@register("feat_equal_width_bin", with_manifest(
    f"SELECT PassengerId, {_ew_sql('Fare')} AS FareBin, {_ew_sql('Age')} AS AgeBin FROM manifest"))
def q_feat_equal_width_bin(spark, sf_dir):
    m = manifest(spark, sf_dir)
    b = m.agg(F.min("Fare").alias("flo"), F.max("Fare").alias("fhi"), F.min("Age").alias("alo"), F.max("Age").alias("ahi"))
    d = m.crossJoin(F.broadcast(b))
    return d.select(ID, fx.equal_width_code("Fare", F.col("flo"), F.col("fhi")).alias("FareBin"),
                    fx.equal_width_code("Age", F.col("alo"), F.col("ahi")).alias("AgeBin"))


@register("feat_label_encode", with_manifest("""
SELECT PassengerId, CAST(dense_rank() OVER (ORDER BY Embarked) - 1 AS BIGINT) AS Embarked_code,
       CAST(dense_rank() OVER (ORDER BY Sex) - 1 AS BIGINT) AS Sex_code
FROM (SELECT PassengerId, Sex, coalesce(Embarked, (SELECT Embarked FROM manifest WHERE Embarked IS NOT NULL
      GROUP BY Embarked ORDER BY count(*) DESC, Embarked LIMIT 1)) AS Embarked FROM manifest)"""))
def q_feat_label_encode(spark, sf_dir):
    d = I.impute_mode(manifest(spark, sf_dir), ["Embarked"])
    d = I.label_encode(d, "Embarked", "Embarked_code")
    d = I.label_encode(d, "Sex", "Sex_code")
    return d.select(ID, "Embarked_code", "Sex_code")


# --- 2.4 missing values ---------------------------------------------------
@register("impute_constant", with_manifest("""
SELECT PassengerId, coalesce(Embarked, 'S') AS Embarked, coalesce(Age, 0.0) AS Age, coalesce(Fare, 0.0) AS Fare
FROM manifest"""))
def q_impute_constant(spark, sf_dir):
    d = I.impute_constant(manifest(spark, sf_dir), {"Embarked": "S", "Age": 0.0, "Fare": 0.0})
    return d.select(ID, "Embarked", "Age", "Fare")


@register("impute_median", with_manifest("""
SELECT PassengerId, round(coalesce(Age, (SELECT median(Age) FROM manifest)), 9) AS Age,
       round(coalesce(Fare, (SELECT median(Fare) FROM manifest)), 9) AS Fare,
       round(coalesce(Age, median(Age) OVER (PARTITION BY Survived IS NULL)), 9) AS AgeSplit FROM manifest"""))
def q_impute_median(spark, sf_dir):
    m = G.with_split(manifest(spark, sf_dir))
    d = I.impute_median(m, ["Age", "Fare"])
    s = I.impute_median(m.select(ID, "split", F.col("Age").alias("AgeSplit")), ["AgeSplit"], group_cols=["split"])
    out = d.select(ID, "Age", "Fare").join(s.select(ID, "AgeSplit"), ID)
    return out.select(ID, *[F.round(c, 9).alias(c) for c in ("Age", "Fare", "AgeSplit")])


@register("impute_mode", with_manifest("""
SELECT PassengerId, coalesce(Embarked, (SELECT Embarked FROM manifest WHERE Embarked IS NOT NULL GROUP BY Embarked
       ORDER BY count(*) DESC, Embarked LIMIT 1)) AS Embarked,
       coalesce(Cabin, (SELECT Cabin FROM manifest WHERE Cabin IS NOT NULL GROUP BY Cabin
       ORDER BY count(*) DESC, Cabin LIMIT 1)) AS Cabin FROM manifest"""))
def q_impute_mode(spark, sf_dir):
    return I.impute_mode(manifest(spark, sf_dir), ["Embarked", "Cabin"]).select(ID, "Embarked", "Cabin")
