"""The fitted cascades share what they read."""

from dataclasses import replace

from conftest import SF_SMALL
from kinfold.operators import groups as G
from kinfold.plans import cascades as C
from kinfold.plans import q_fitted, q_models


def test_frames_are_grouped_once_and_narrow(spark, monkeypatch):
    made, frame, registries, registry = [], G.wcg_frame, [], G.group_registry
    monkeypatch.setattr(q_models, "GENERAL", replace(q_models.GENERAL, rounds=2))
    monkeypatch.setattr(q_models, "SUB", replace(q_models.SUB, rounds=2))
    monkeypatch.setattr(G, "wcg_frame", lambda *a, **k: made.append(frame(*a, **k)) or made[-1])
    monkeypatch.setattr(G, "group_registry", lambda *a, **k: registries.append(1) or registry(*a, **k))
    d = q_fitted.q_cascades_fitted(spark, SF_SMALL)
    # The sub-models' frame, and one in the style of either family of models.
    assert len(made) == 3
    assert all("Name" not in x.columns and "TicketId" not in x.columns for x in made)
    assert len(registries) == 2       # the shared one, and the clone's own groups
    rows = d.groupBy("cascade").count().collect()
    assert len(rows) == 11 and len({r["count"] for r in rows}) == 1


def test_shared_registry_gives_the_same_rows(spark):
    from kinfold.plans.q_cascades import scored
    py = C.py_frame(scored(spark, SF_SMALL))
    narrow = C.py_frame(scored(spark, SF_SMALL), keep=C.RULE_COLUMNS)
    known = C.py_registry(narrow)
    for cascade in (C.cascade_complete_r, C.cascade_faithful, C.cascade_enhanced, C.cascade_static):
        assert sorted(map(tuple, cascade(narrow, known).collect())) == sorted(map(tuple, cascade(py).collect()))
