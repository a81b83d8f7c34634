"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``; its oracle (when the
result is deterministic) is an independent, naive SQL formulation over the
same driver tables, prefixed by the shared manifest view.
"""

from __future__ import annotations

from collections.abc import Callable

from ..sources.manifest import manifest_sql_for_duckdb

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_manifest(body: str) -> str:
    """``WITH manifest AS (...)`` followed by more CTEs or a SELECT."""
    head = f"WITH manifest AS ({manifest_sql_for_duckdb()})"
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"{head}\n{body}"
    return f"{head},\n{body}"


# Naive SQL of the woman-child-group frame (combined scope, Master wins,
# first-row attach), shared by several oracles.
WCG_CTES = """
t AS (SELECT *,
        CASE WHEN Name LIKE '%Master%' THEN 'boy' WHEN Sex = 'female' THEN 'woman' ELSE 'man' END AS Title,
        regexp_extract(Name, '^([^,]*),', 1) AS Surname,
        regexp_replace(Ticket, '.$', 'X') AS TicketMod,
        coalesce(CAST(CAST(Fare AS DECIMAL(12,2)) AS VARCHAR), 'NA') AS FareTxt,
        CASE WHEN Survived IS NULL THEN 'test' ELSE 'train' END AS split
      FROM manifest),
k AS (SELECT *,
        CASE WHEN Title <> 'man' THEN coalesce(Surname, 'NA') || '-' || CAST(Pclass AS VARCHAR) || '-'
             || coalesce(TicketMod, 'NA') || '-' || FareTxt || '-' || coalesce(Embarked, 'NA') END AS gid0,
        CAST(Pclass AS VARCHAR) || '-' || coalesce(TicketMod, 'NA') || '-' || FareTxt || '-'
             || coalesce(Embarked, 'NA') AS TicketId
      FROM t),
s AS (SELECT *, CASE WHEN gid0 IS NOT NULL AND count(*) OVER (PARTITION BY gid0) >= 2 THEN gid0 END AS gid1
      FROM k),
a AS (SELECT *, first_value(gid1) OVER (PARTITION BY TicketId ORDER BY PassengerId) AS first_gid FROM s),
g AS (SELECT *, CASE WHEN Title <> 'man' AND gid1 IS NULL THEN first_gid ELSE gid1 END AS GroupId,
             (Title <> 'man' AND gid1 IS NULL AND first_gid IS NOT NULL) AS Attached
      FROM a),
r AS (SELECT GroupId, avg(Survived) AS grate FROM g
      WHERE GroupId IS NOT NULL AND Survived IS NOT NULL GROUP BY GroupId),
u AS (SELECT avg(Survived) AS urate FROM g WHERE GroupId IS NULL),
gs AS (SELECT g.*, r.grate IS NOT NULL AS InKnownGroup,
         CASE WHEN g.GroupId IS NULL THEN coalesce(u.urate, CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END)
              ELSE coalesce(r.grate, CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END) END AS GroupSurvival
       FROM g LEFT JOIN r ON g.GroupId = r.GroupId CROSS JOIN u)
"""

# Deterministic stand-in model scores (FIXTURES): ((id * m) % 1000) / 1000.
SCORE_MULTIPLIERS = [37, 101, 211, 307, 401]
SCORES_SQL = ", ".join(f"CAST((PassengerId * {m}) % 1000 AS DOUBLE) / 1000.0 AS p{m}"
                       for m in SCORE_MULTIPLIERS)

# R-style frame over gs: family size, ticket frequency, fare per ticket,
# decided flag and scores.
R_FRAME_CTES = WCG_CTES + """,
rf0 AS (SELECT *, coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS FamilySize,
          CASE WHEN Ticket IS NOT NULL THEN count(*) OVER (PARTITION BY Ticket) END AS TicketFreq,
          coalesce(GroupSurvival IN (0, 1), false) AS GroupDecided, """ + SCORES_SQL + """
        FROM gs),
rf AS (SELECT *, Fare / TicketFreq AS FareAdj FROM rf0)
"""

# Python-style frame: per split, female wins, first grouped attach, 'S' fill.
PY_FRAME_CTES = """
pt AS (SELECT *,
        CASE WHEN Sex = 'female' THEN 'woman' WHEN Name LIKE '%Master%' THEN 'boy' ELSE 'man' END AS Title,
        split_part(Name, ',', 1) AS Surname,
        regexp_replace(Ticket, '.$', 'X') AS TicketMod,
        coalesce(CAST(CAST(Fare AS DECIMAL(12,2)) AS VARCHAR), 'NA') AS FareTxt,
        CASE WHEN Survived IS NULL THEN 'test' ELSE 'train' END AS split
      FROM manifest),
pk AS (SELECT *,
        CASE WHEN Title <> 'man' THEN coalesce(Surname, 'NA') || '-' || CAST(Pclass AS VARCHAR) || '-'
             || coalesce(TicketMod, 'NA') || '-' || FareTxt || '-' || coalesce(Embarked, 'S') END AS gid0,
        CAST(Pclass AS VARCHAR) || '-' || coalesce(TicketMod, 'NA') || '-' || FareTxt || '-'
             || coalesce(Embarked, 'S') AS TicketId
      FROM pt),
ps AS (SELECT *, CASE WHEN gid0 IS NOT NULL AND count(*) OVER (PARTITION BY split, gid0) >= 2 THEN gid0 END AS gid1
       FROM pk),
pa AS (SELECT *, first_value(gid1 IGNORE NULLS) OVER (PARTITION BY split, TicketId ORDER BY PassengerId
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fgid FROM ps),
pg AS (SELECT *, CASE WHEN Title <> 'man' AND gid1 IS NULL THEN fgid ELSE gid1 END AS GroupId FROM pa),
pf0 AS (SELECT *, coalesce(SibSp, 0) + coalesce(Parch, 0) + 1 AS FamilySize,
          CASE WHEN Ticket IS NOT NULL THEN count(*) OVER (PARTITION BY split, Ticket) END AS TicketFreq,
          """ + SCORES_SQL + """
        FROM pg),
pf AS (SELECT *, Fare / TicketFreq AS FareAdj FROM pf0),
preg AS (SELECT GroupId, count(*) AS n_members, count(Survived) AS n_labelled, avg(Survived) AS rate
         FROM pg WHERE split = 'train' AND GroupId IS NOT NULL GROUP BY GroupId)
"""


def wcg_fallback_ctes() -> str:
    """WCG frame where ungrouped rows also take the class fallback."""
    return WCG_CTES.replace("coalesce(u.urate, CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END)",
                            "CASE WHEN Pclass = 3 THEN 0.0 ELSE 1.0 END")
