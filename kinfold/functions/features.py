"""Column expressions for feature derivation.

Every function returns a ``Column`` built from Spark SQL built-ins, so it
stays inside whole-stage codegen; nothing here runs Python per row.
Functions take column names as parameters; defaults are the manifest's.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lookup tables)
# ---------------------------------------------------------------------------
# Title pattern: text after the comma up to the first dot.
TITLE_PATTERN = r",\s*([^.]+)\."
# Rare-title collapsing map (lower-cased raw title -> normalized title).
TITLE_NORMALIZE = {
    "ms": "miss", "mlle": "miss", "mme": "mrs",
    "lady": "rare", "the countess": "rare", "jonkheer": "rare", "sir": "rare",
    "don": "rare", "dona": "rare", "dr": "rare", "rev": "rare", "major": "rare",
    "col": "rare", "capt": "rare",
}
# Titles read as "woman" by the solo-female model (others keep their title).
TITLE_WOMAN = {
    "miss": "woman", "mrs": "woman", "ms": "woman", "mme": "woman",
    "mlle": "woman", "lady": "woman", "the countess": "woman",
}
# Grouped titles of the recorded title-count summary.
TITLE_GROUPS = {
    "Mr": "Mr", "Miss": "Miss", "Mrs": "Mrs", "Master": "Master", "Dr": "Dr",
    "Rev": "Clergy", "Col": "Military", "Major": "Military", "Capt": "Military",
    "Mlle": "Miss", "Ms": "Miss", "Mme": "Mrs",
    "Lady": "Royalty", "Sir": "Royalty", "Don": "Royalty", "Jonkheer": "Royalty",
    "the Countess": "the Countess",
}
# Sex recode for display.
SEX_RECODE = {"male": "M", "female": "F", "Male": "M", "Female": "F", "MALE": "M", "FEMALE": "F"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    """A literal ``map<string,string>`` (a constant, folded by Catalyst)."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


# ---------------------------------------------------------------------------
# Titles, names
# ---------------------------------------------------------------------------
def title_raw(name="Name", missing: str | None = None, lower: bool = False) -> Column:
    """Group 1 of ``,\\s*([^.]+)\\.``, trimmed. No match gives ``missing``
    (None -> NULL, "" -> empty string, "Unknown" ...)."""
    t = F.trim(F.regexp_extract(_col(name), TITLE_PATTERN, 1))
    if lower:
        t = F.lower(t)
    matched = F.regexp_extract(_col(name), TITLE_PATTERN, 0) != F.lit("")
    return F.when(matched, t).otherwise(F.lit(missing))


def title_normalized(name="Name") -> Column:
    """Lower-cased title with rare titles collapsed; no match -> ''."""
    t = title_raw(name, missing="", lower=True)
    return F.coalesce(F.element_at(literal_map(TITLE_NORMALIZE), t), t)


def title_woman_map(name="Name") -> Column:
    """Lower-cased title, female titles mapped to 'woman'; no match -> NULL."""
    t = title_raw(name, missing=None, lower=True)
    return F.coalesce(F.element_at(literal_map(TITLE_WOMAN), t), t)


def title_group(name="Name") -> Column:
    """Raw title mapped onto the grouped title set (unmapped titles kept)."""
    t = title_raw(name, missing=None)
    return F.coalesce(F.element_at(literal_map(TITLE_GROUPS), t), t)


def person_type(sex="Sex", name="Name", precedence: str = "master") -> Column:
    """'man' / 'woman' / 'boy'. ``precedence='master'``: a name containing
    'Master' makes a boy even when female; ``'female'``: female wins."""
    is_master = F.coalesce(_col(name).contains("Master"), F.lit(False))
    is_female = F.coalesce(_col(sex) == "female", F.lit(False))
    if precedence == "master":
        return F.when(is_master, "boy").when(is_female, "woman").otherwise("man")
    if precedence == "female":
        return F.when(is_female, "woman").when(is_master, "boy").otherwise("man")
    raise ValueError(precedence)


def is_boy(name="Name") -> Column:
    return F.coalesce(title_normalized(name) == "master", F.lit(False))


def is_female(sex="Sex") -> Column:
    return F.coalesce(F.lower(_col(sex)) == "female", F.lit(False))


def boy_flags(sex="Sex", age="Age", name="Name") -> tuple[Column, Column]:
    """(boy_master, boy_nonmaster): male, age < 18, title is / is not
    'master'; unknown age gives 0."""
    boy = F.coalesce((F.lower(_col(sex)) == "male") & (_col(age) < 18), F.lit(False))
    master = F.coalesce(title_raw(name, lower=True) == "master", F.lit(False))
    return (boy & master).cast("int"), (boy & ~master).cast("int")


def surname(name="Name", no_comma: str = "empty") -> Column:
    """Text before the first comma. Without a comma: '' (``no_comma='empty'``,
    the notebooks' pattern) or the whole text (``'whole'``, a split at the comma)."""
    if no_comma == "whole":
        return F.substring_index(_col(name), ",", 1)
    return F.regexp_extract(_col(name), r"^([^,]*),", 1)


def display_name(name="Name") -> Column:
    """"Surname, Title. Rest" -> "Title. Surname"; NULL -> 'Unknown';
    no ', ' -> unchanged; no dot -> 'No Title Surname'."""
    parts = F.split(_col(name), ", ")
    last = F.trim(parts.getItem(0))
    rest = F.trim(parts.getItem(1))
    return (F.when(_col(name).isNull(), F.lit("Unknown"))
            .when(F.size(parts) < 2, _col(name))
            .when(F.instr(rest, ".") > 0,
                  F.concat(F.trim(F.substring_index(rest, ".", 1)), F.lit(". "), last))
            .otherwise(F.concat(F.lit("No Title "), last)))


def recode_sex(sex="Sex") -> Column:
    return F.coalesce(F.element_at(literal_map(SEX_RECODE), _col(sex)), F.lit("Unknown"))


# ---------------------------------------------------------------------------
# Family, fare, cabin, ticket
# ---------------------------------------------------------------------------
def family_size(sibsp="SibSp", parch="Parch", fill_nulls: bool = True) -> Column:
    if fill_nulls:
        return F.coalesce(_col(sibsp), F.lit(0)) + F.coalesce(_col(parch), F.lit(0)) + 1
    return _col(sibsp) + _col(parch) + 1


def is_alone(fsize: Column) -> Column:
    return (fsize == 1).cast("int")


def fare_per_person(fare="Fare", fsize: Column | None = None) -> Column:
    fs = fsize if fsize is not None else family_size()
    return F.coalesce(_col(fare), F.lit(0.0)) / F.when(fs == 0, F.lit(1)).otherwise(fs)


def has_cabin(cabin="Cabin") -> Column:
    return _col(cabin).isNotNull()


def deck(cabin="Cabin", missing: str | None = "U") -> Column:
    d = F.substring(_col(cabin), 1, 1)
    return F.coalesce(d, F.lit(missing)) if missing is not None else d


def ticket_prefix(ticket="Ticket") -> Column:
    p = F.regexp_replace(F.coalesce(_col(ticket), F.lit("NA")), "[^A-Za-z]", "")
    return F.when(p == "", F.lit("NONE")).otherwise(p)


def ticket_mod(ticket="Ticket", variant: str = "last_char") -> Column:
    """Last character replaced by 'X' (``variant='dot'``: literal dots)."""
    if variant == "dot":
        return F.replace(_col(ticket), F.lit("."), F.lit("X"))
    return F.regexp_replace(_col(ticket), ".$", "X")


def fare_text(fare="Fare") -> Column:
    """Fare as key text, pinned to two decimals (engine-independent)."""
    return F.col(fare).cast("decimal(12,2)").cast("string") if isinstance(fare, str) \
        else fare.cast("decimal(12,2)").cast("string")


def male_xy(fare="Fare", ticket_freq="TicketFreq", fsize="FamilySize", age="Age"):
    x1 = _col(fare) / (_col(ticket_freq) * 10)
    x2 = _col(fsize) + _col(age) / 70
    return x1, x2


def female_xy(fare_adj="FareAdj", age="Age"):
    return _col(fare_adj) / 10, _col(age) / 15


def family_id(name="Name", fsize: Column | None = None) -> Column:
    fs = fsize if fsize is not None else family_size()
    sn = F.lower(F.trim(F.split(_col(name), ",").getItem(0)))
    return F.concat_ws("_", sn, fs.cast("string"))


# ---------------------------------------------------------------------------
# Binning
# ---------------------------------------------------------------------------
def equal_width_code(x, lo: Column, hi: Column, bins: int = 5) -> Column:
    """Equal-width right-closed bin codes 0..bins-1 over [lo, hi]
    (the lowest value falls in bin 0)."""
    w = (hi - lo) / bins
    code = F.ceil((_col(x) - lo) / w) - 1
    return F.when(_col(x).isNull(), F.lit(None)).when(w == 0, F.lit(0)) \
        .otherwise(F.least(F.greatest(code, F.lit(0)), F.lit(bins - 1))).cast("int")


def bin_right_closed(x, edges: list, labels: list | None = None) -> Column:
    """(a,b] bins; values outside (edges[0], edges[-1]] give NULL."""
    labels = labels or [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    expr = None
    for (a, b), lab in zip(zip(edges, edges[1:]), labels):
        cond = (_col(x) > a) & (_col(x) <= b)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def bin_left_closed(x, edges: list, labels: list) -> Column:
    """[a,b) bins; ``None`` as the last edge means unbounded."""
    expr = None
    for (a, b), lab in zip(zip(edges, edges[1:]), labels):
        cond = _col(x) >= a if b is None else (_col(x) >= a) & (_col(x) < b)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def bin_ordinal(x, edges: list, right_closed: bool = True) -> Column:
    """Ordinal (1-based) of the bin a value falls in, for sorting labels."""
    expr = None
    for i, (a, b) in enumerate(zip(edges, edges[1:]), start=1):
        if right_closed:
            cond = (_col(x) > a) & (_col(x) <= b)
        else:
            cond = _col(x) >= a if b is None else (_col(x) >= a) & (_col(x) < b)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def log1p_clipped(x) -> Column:
    return F.log1p(F.greatest(_col(x), F.lit(0.0)))
