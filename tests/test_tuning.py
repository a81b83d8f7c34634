"""The tuning queries run over the whole lists, rounds and both cohorts."""

from kinfold.operators import boosting as B
from kinfold.plans import q_models

SF = "/root/testdata/sf0.001"


def asked_cells(monkeypatch):
    """Cells that the queries ask for, which are then fitted with few rounds."""
    asked, fit = [], B.fit

    def few(table, cells, local_rows=None):
        asked.extend(cells)
        return fit(table, [B.Cell(c.key, B.with_rounds(c.params, 3), c.group, c.without, c.valid, c.patience) for c in cells])
    monkeypatch.setattr(B, "fit", few)
    return asked


def test_whole_lists():
    assert q_models.SWEEP == (50, 100, 200, 300, 500, 800, 1000)
    assert (q_models.STOP_ROUNDS, q_models.PATIENCE) == (2000, 50)
    assert q_models.SUB.rounds == q_models.GENERAL.rounds == 500
    assert q_models.GRID_THRESHOLDS == {"women": (0.08, 0.10, 0.25, 0.50), "men": (0.50, 0.75, 0.90, 0.92)}


def test_tune_grid_has_both_cohorts(spark, monkeypatch):
    asked = asked_cells(monkeypatch)
    got = q_models.q_tune_grid(spark, SF).collect()
    assert {(c.group, c.params.depth, c.without) for c in asked} == {
        (g, d, (f,)) for g in ("men", "women") for d in (3, 4, 5, 6) for f in range(5)}
    assert {c.params.rounds for c in asked} == {500} and len(asked) == 40
    assert {(r.cohort, r.depth) for r in got} == {(c, d) for c in ("men", "women") for d in (3, 4, 5, 6)}
    for r in got:
        held = {float(c): v for c, v in r.asDict().items() if c not in ("cohort", "depth") and v is not None}
        assert set(held) == set(q_models.GRID_THRESHOLDS[r.cohort]) and all(0 <= v <= 1 for v in held.values())


def test_rounds_of_early_stopping(spark, monkeypatch):
    asked = asked_cells(monkeypatch)
    got = q_models.q_model_gbt_early_stop(spark, SF).collect()
    first, final = asked
    assert (first.params.rounds, first.patience, first.valid, first.without) == (2000, 50, 1, (1,))
    assert {r.n_rounds for r in got} == {final.params.rounds} and final.without == () and 1 <= final.params.rounds <= 3


def test_sweep(spark):
    got = q_models.q_tune_rounds(spark, SF).collect()
    assert sorted(r.rounds for r in got) == list(q_models.SWEEP)
    assert all(0 <= r.auc <= 1 and 0 <= r.accuracy <= 1 and 0 <= r.f1 <= 1 for r in got)
    best = max(r.auc for r in got)
    assert [r.rounds for r in got if r.chosen] == [min(r.rounds for r in got if r.auc == best)]
