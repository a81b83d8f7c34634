"""Grouping and linkage: woman-child groups by composite keys.

The "no group" bucket is represented as NULL (it holds most rows: every
adult man), so it is never a shuffle key; sizes and rates are computed over
non-NULL ids only and joined back with NULL-key spreading.

``scope`` selects what frequencies and group sizes are counted over:
``"combined"`` (labelled and scoring rows together) or ``"per_split"``
(each split on its own: the split column joins the partition keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..session import materialize
from .joins import add_key_count, join_back, with_scalar

ID = "PassengerId"


def _scope_keys(scope: str, split_col: str = "split") -> list[str]:
    if scope == "combined":
        return []
    if scope == "per_split":
        return [split_col]
    raise ValueError(scope)


def with_split(df: DataFrame, label: str = "Survived", out: str = "split") -> DataFrame:
    """Tag 'train' (label present) / 'test' rows when no tag exists."""
    if out in df.columns:
        return df
    return df.withColumn(out, F.when(F.col(label).isNull(), "test").otherwise("train"))


def key_text(c: str, fill: str = "NA"):
    """Key component as text; NULL written as ``fill`` (R's paste writes NA)."""
    if c == "Fare":
        return F.coalesce(fx.fare_text("Fare"), F.lit(fill))
    return F.coalesce(F.col(c).cast("string"), F.lit(fill))


def engineer_keys(df: DataFrame, precedence: str = "master", ticket_variant: str = "last_char",
                  no_comma: str = "empty") -> DataFrame:
    """Title (person type), Surname, TicketMod and the raw key texts."""
    return (df.withColumn("Title", fx.person_type("Sex", "Name", precedence))
              .withColumn("Surname", fx.surname("Name", no_comma))
              .withColumn("TicketMod", fx.ticket_mod("Ticket", ticket_variant)))


def add_group_key(df: DataFrame, out: str = "GroupId", mask_men: bool = True,
                  embarked_fill: str = "NA") -> DataFrame:
    """Surname-Pclass-TicketMod-Fare-Embarked; adult men get NULL."""
    key = F.concat_ws("-", key_text("Surname"), key_text("Pclass"), key_text("TicketMod"),
                      key_text("Fare"), key_text("Embarked", embarked_fill))
    if mask_men:
        key = F.when(F.col("Title") != "man", key)
    return df.withColumn(out, key)


def add_ticket_key(df: DataFrame, out: str = "TicketId", embarked_fill: str = "NA") -> DataFrame:
    """Pclass-TicketMod-Fare-Embarked."""
    return df.withColumn(out, F.concat_ws("-", key_text("Pclass"), key_text("TicketMod"),
                                          key_text("Fare"), key_text("Embarked", embarked_fill)))


def add_exact_ticket_key(df: DataFrame, out: str = "TicketId") -> DataFrame:
    """Ticket-Pclass-Fare-Embarked as they stand. A missing Ticket, Pclass or
    Fare matches nothing (NULL key); a missing Embarked is taken as 'S'."""
    return df.withColumn(out, F.concat(F.col("Ticket"), F.lit("-"), F.col("Pclass").cast("string"), F.lit("-"),
                                       fx.fare_text("Fare"), F.lit("-"), key_text("Embarked", "S")))


def filter_group_size(df: DataFrame, gid: str = "GroupId", min_size: int = 2,
                      scope: str = "combined", size_col: str = "GroupFreq") -> DataFrame:
    """Groups with fewer than ``min_size`` rows become NULL (no group)."""
    keys = _scope_keys(scope) + [gid]
    counted = add_key_count(df, keys, "__n", spread_on=ID)
    return (counted.withColumn(gid, F.when(F.col("__n") >= min_size, F.col(gid)))
                   .withColumn(size_col, F.when(F.col(gid).isNotNull(), F.col("__n")))
                   .drop("__n"))


def recount_group_size(df: DataFrame, gid: str = "GroupId", scope: str = "combined",
                       size_col: str = "GroupFreq") -> DataFrame:
    keys = _scope_keys(scope) + [gid]
    return add_key_count(df.drop(size_col), keys, size_col, spread_on=ID)


def attach_relatives(df: DataFrame, form: str = "first_grouped", gid: str = "GroupId",
                     ticket: str = "TicketId", scope: str = "combined",
                     person: str = "Title", order: str = ID) -> DataFrame:
    """Ungrouped women and boys join a group through their ticket key.

    ``first_grouped``: group of the first *grouped* row (by ``order``) on
    the key; ``first_row``: group of the first row on the key, grouped or
    not; ``not_self``: group of the first *other* row, where the first row
    takes the second row's group and later rows the first row's updated
    group. ``exact`` is ``first_grouped`` over the caller's exact-ticket key.

    Closed forms of the sequential reference loops: a per-key aggregate
    (``min_by``, partial-aggregated) joined back, no window on the key.
    """
    keys = _scope_keys(scope) + [ticket]
    candidate = (F.col(person) != "man") & F.col(gid).isNull()
    if form in ("first_grouped", "exact"):
        reg = (df.where(F.col(gid).isNotNull() & F.col(ticket).isNotNull())
                 .groupBy(*keys).agg(F.min_by(F.col(gid), F.col(order)).alias("__att")))
    elif form == "first_row":
        reg = (df.where(F.col(ticket).isNotNull())
                 .groupBy(*keys).agg(F.min_by(F.col(gid), F.col(order)).alias("__att")))
    elif form == "not_self":
        return _attach_not_self(df, gid, keys, candidate, order)
    else:
        raise ValueError(form)
    out = join_back(df, reg, keys, spread_on=order)
    return (out.withColumn("Attached", candidate & F.col("__att").isNotNull())
               .withColumn(gid, F.when(candidate, F.col("__att")).otherwise(F.col(gid)))
               .drop("__att"))


def _attach_not_self(df, gid, keys, candidate, order):
    # Per key: first row (its order value, group, whether it is a
    # candidate), then the second row's group from a second aggregate.
    first = (df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys)
               .agg(F.min(order).alias("__o1"),
                    F.min_by(F.col(gid), F.col(order)).alias("__g1"),
                    F.min_by(candidate, F.col(order)).alias("__c1")))
    j = join_back(df, first, keys, spread_on=order)
    second = (j.where(F.col(order) > F.col("__o1")).groupBy(*keys)
                .agg(F.min_by(F.col(gid), F.col(order)).alias("__g2")))
    j = join_back(j, second, keys, spread_on=order)
    # The first row takes the second row's group; later rows take the first
    # row's group as updated by the loop (the second row's group when the
    # first row was itself a candidate).
    first_updated = F.when(F.col("__c1"), F.col("__g2")).otherwise(F.col("__g1"))
    new_gid = F.when(F.col(order) == F.col("__o1"), F.col("__g2")).otherwise(first_updated)
    return (j.withColumn("Attached", candidate & new_gid.isNotNull())
             .withColumn(gid, F.when(candidate, new_gid).otherwise(F.col(gid)))
             .drop("__o1", "__g1", "__g2", "__c1"))


def link_override(df: DataFrame, pairs: DataFrame, gid: str = "GroupId") -> DataFrame:
    """Copy the group of ``source_id`` onto ``id`` for a table of pairs (its
    measured size decides how it is joined)."""
    src = (df.select(F.col(ID).alias("source_id"), F.col(gid).alias("__src_gid"))
             .join(pairs, "source_id", "left_semi"))
    mapping = (pairs.join(src, "source_id")
                    .select(F.col("id").alias(ID), "__src_gid", F.lit(True).alias("__linked")))
    out = df.join(mapping, ID, "left")
    return (out.withColumn(gid, F.when(F.col("__linked"), F.col("__src_gid")).otherwise(F.col(gid)))
               .drop("__src_gid", "__linked"))


def outcome_override(df: DataFrame, overrides: DataFrame, col: str) -> DataFrame:
    """Set ``col`` for explicit ids from an override table (id, value)."""
    ov = overrides.select(F.col("id").alias(ID), F.col("value").alias("__ov"))
    out = df.join(ov, ID, "left")
    return out.withColumn(col, F.coalesce(F.col("__ov").cast(df.schema[col].dataType), F.col(col))) \
        .drop("__ov")


def group_registry(df: DataFrame, gid: str = "GroupId", label: str = "Survived",
                   min_labelled: int = 1, scope_keys: list[str] | None = None) -> DataFrame:
    """Per group over labelled rows: members, labelled members, rate."""
    keys = (scope_keys or []) + [gid]
    reg = (df.where(F.col(gid).isNotNull()).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n_members"),
                  F.count(F.col(label)).alias("n_labelled"),
                  F.avg(F.col(label).cast("double")).alias("rate")))
    return reg.where(F.col("n_labelled") >= min_labelled)


def outcome_definitive(reg: DataFrame, min_labelled: int = 2) -> DataFrame:
    """Groups whose labelled members all share one outcome."""
    return (reg.where((F.col("n_labelled") >= min_labelled) & F.col("rate").isin(0.0, 1.0))
               .withColumn("outcome", F.col("rate").cast("int")))


def outcome_majority(reg: DataFrame, hi: float = 0.75, lo: float = 0.25,
                     min_labelled: int = 2) -> DataFrame:
    """>= hi -> 1, <= lo -> 0, otherwise undecided (dropped)."""
    out = reg.where(F.col("n_labelled") >= min_labelled).withColumn(
        "outcome", F.when(F.col("rate") >= hi, 1).when(F.col("rate") <= lo, 0))
    return out.where(F.col("outcome").isNotNull())


def with_group_rate(df: DataFrame, gid: str = "GroupId", label: str = "Survived",
                    fallback: str = "class", ungrouped: str = "own_mean",
                    pclass: str = "Pclass", out: str = "GroupSurvival",
                    scope_keys: list[str] | None = None) -> DataFrame:
    """Labelled group rate for every member.

    Groups without a labelled member fall back to class (class 3 -> 0,
    else 1). Ungrouped rows keep the mean of the labelled ungrouped rows
    (``ungrouped='own_mean'``) or take the class fallback too
    (``'fallback'``), or stay NULL (``'null'``).
    """
    reg = group_registry(df, gid, label, 1, scope_keys).select(*(scope_keys or []), gid,
                                                               F.col("rate").alias("__rate"))
    res = join_back(df, reg, (scope_keys or []) + [gid], spread_on=ID)
    class_fb = F.when(F.col(pclass) == 3, F.lit(0.0)).otherwise(F.lit(1.0))
    if ungrouped == "own_mean":
        um = df.where(F.col(gid).isNull()).agg(F.avg(F.col(label).cast("double")).alias("__umean"))
        res = with_scalar(res, um)
        ung = F.coalesce(F.col("__umean"), class_fb)
    elif ungrouped == "fallback":
        ung = class_fb
    else:
        ung = F.lit(None).cast("double")
    rate = F.when(F.col(gid).isNull(), ung).otherwise(
        F.coalesce(F.col("__rate"), class_fb) if fallback == "class" else F.col("__rate"))
    res = res.withColumn(out, rate)
    return res.drop("__rate", "__umean") if "__umean" in res.columns else res.drop("__rate")


def family_unanimity(df: DataFrame, family: str = "FamilyID", label: str = "Survived") -> DataFrame:
    """Per family: has a woman-or-boy member; all of them lived; all died.
    Families without one get false/false. Labelled rows only."""
    fb = fx.is_female("Sex") | fx.is_boy("Name")
    t = df.where(F.col(label).isNotNull()).select(family, fb.alias("fb"), F.col(label).alias("y"))
    return (t.groupBy(family)
             .agg(F.bool_or("fb").alias("has_fb"),
                  F.coalesce(F.bool_and(F.when(F.col("fb"), F.col("y") == 1)), F.lit(False)).alias("all_fb_live"),
                  F.coalesce(F.bool_and(F.when(F.col("fb"), F.col("y") == 0)), F.lit(False)).alias("all_fb_die")))


def extend_to_adult_men(df: DataFrame, reg_rate: DataFrame, gid_all: str = "GroupId2",
                        rate_col: str = "GroupSurvival", gid: str = "GroupId") -> DataFrame:
    """A man whose own key (built without the man mask) names a known group
    with rate 0 takes rate 0."""
    dead = reg_rate.where(F.col("rate") == 0).select(F.col(gid).alias(gid_all), F.lit(True).alias("__dead"))
    out = join_back(df, dead, gid_all, spread_on=ID)
    return out.withColumn(rate_col, F.when((F.col("Title") == "man") & F.col("__dead"), F.lit(0.0))
                          .otherwise(F.col(rate_col))).drop("__dead")


def group_name(gid: str = "GroupId"):
    return F.substring_index(F.col(gid), "-", 1)


def roster_status(label: str = "Survived", attached: str = "Attached", person: str = "Title"):
    """-1 attached & died, 0 died, 1 lived, 2 attached & lived, 3 unknown
    woman, 4 unknown boy, 5 attached unknown."""
    att = F.coalesce(F.col(attached), F.lit(False))
    return (F.when(att & F.col(label).isNull(), 5)
             .when(att & (F.col(label) == 0), -1)
             .when(att & (F.col(label) == 1), 2)
             .when(F.col(label) == 0, 0)
             .when(F.col(label) == 1, 1)
             .when(F.col(person) == "woman", 3)
             .when(F.col(person) == "boy", 4))


def wcg_frame(df: DataFrame, scope: str = "combined", attach: str = "first_row",
              precedence: str = "master", min_size: int = 2, embarked_fill: str = "NA",
              ticket_variant: str = "last_char", link_pairs: DataFrame | None = None,
              recount: bool = True, no_comma: str = "empty", keep: list[str] | None = None) -> DataFrame:
    """Person type, group key, size filter, ticket key and attach, in the
    order the group model uses them. With ``keep`` the result has these columns
    only, and the steps carry no others than they need."""
    d = with_split(df)
    d = engineer_keys(d, precedence, ticket_variant, no_comma)
    d = add_group_key(d, embarked_fill=embarked_fill)
    d = add_ticket_key(d, embarked_fill=embarked_fill)
    if link_pairs is not None:
        d = link_override(d, link_pairs)
    # Each step below aggregates its input and joins the result back, so
    # the input is read twice: the key table is materialized once; the size
    # filter is a join with a small registry and is simply read twice by
    # the attach step; the attached frame is materialized for the callers.
    if keep is not None:
        d = d.select(*dict.fromkeys([*(c for c in keep if c in d.columns), ID, "split", "Title", "GroupId", "TicketId"]))
    d = materialize(d)
    d = filter_group_size(d, min_size=min_size, scope=scope)
    d = attach_relatives(d, form=attach, scope=scope)
    if keep is not None:
        d = d.select(*[c for c in d.columns if c in keep])
    if not recount:
        return materialize(d)
    return materialize(recount_group_size(d, scope=scope))


def annotate_groups(df: DataFrame, gid: str = "GroupId", label: str = "Survived", pclass: str = "Pclass",
                    scope: str = "combined", ungrouped: str = "own_mean",
                    out: str = "GroupSurvival") -> DataFrame:
    """Group size, labelled rate, known-group flag and the rate with class
    fallback, from one aggregate per group joined back once (plus a
    one-row aggregate for the ungrouped bucket)."""
    keys = _scope_keys(scope) + [gid]
    y = F.col(label).cast("double")
    reg = (df.where(F.col(gid).isNotNull()).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("GroupFreq"), F.count(y).alias("__nl"), F.avg(y).alias("__rate")))
    res = join_back(df.drop("GroupFreq"), reg, keys, spread_on=ID)
    class_fb = F.when(F.col(pclass) == 3, F.lit(0.0)).otherwise(F.lit(1.0))
    if ungrouped == "own_mean":
        # One row (or one per scope value): the mean of the labelled ungrouped rows.
        sk = _scope_keys(scope)
        um = df.where(F.col(gid).isNull()).groupBy(*sk).agg(F.avg(y).alias("__umean"))
        res = join_back(res, um, sk, bounded=True) if sk else with_scalar(res, um)
        ung = F.coalesce(F.col("__umean"), class_fb)
    elif ungrouped == "fallback":
        ung = class_fb
    else:
        ung = F.lit(None).cast("double")
    rate = F.when(F.col(gid).isNull(), ung).otherwise(F.coalesce(F.col("__rate"), class_fb))
    res = (res.withColumn(out, rate)
              .withColumn("InKnownGroup", F.coalesce(F.col("__nl") > 0, F.lit(False))))
    return res.drop("__nl", "__rate", *(["__umean"] if ungrouped == "own_mean" else []))
