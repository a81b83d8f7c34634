"""Stored prediction files: names, digests and agreement against plain code."""

import random
from collections import Counter
from itertools import combinations

from kinfold.operators import prediction_files as PF
from kinfold.sources import files

SCHEMA = "set string, PassengerId long, Survived int"


def plain_agreement(rows):
    sets = {}
    for s, i, v in rows:
        if i is not None and v is not None:
            at = sets.setdefault(s, {})
            at[i] = min(v, at.get(i, v))
    out = {}
    for a, b in combinations(sorted(sets), 2):
        both = sets[a].keys() & sets[b].keys()
        if both:
            diff = sum(sets[a][i] != sets[b][i] for i in both)
            out[a, b] = (len(both), diff, 1 - diff / len(both), diff == 0)
    return out


def drawn(n=40, seed=3):
    rng = random.Random(seed)
    rows = [(f"s{k}", i, rng.randint(0, 1)) for k in range(6) for i in range(n) if rng.random() < 0.8]
    rows += [("s0", 1, None), ("s1", None, 1), ("s2", 5, 0), ("s2", 5, 1), ("far", 1000, 1), ("holes", None, None)]
    return rows + [("copy of s3", i, v) for s, i, v in reversed(rows) if s == "s3"]


def test_agreement_by_plain_code(spark):
    rows = drawn()
    got = {(r.set_a, r.set_b): tuple(r)[2:] for r in PF.agreement(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_agreement(rows)
    assert got["copy of s3", "s3"][3]


def test_digests_are_of_the_rows_in_any_order(spark):
    rows = drawn()
    got = {r["set"]: r for r in PF.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    content = {}
    for s, i, v in rows:
        content.setdefault(s, Counter())[i, v] += 1
    for s, c in content.items():
        same = [t for t in content if content[t] == c]
        assert (got[s].n_rows, got[s].positives, got[s].first_set, got[s].n_equal) == \
            (c.total(), sum(n for (_, v), n in c.items() if v), min(same), len(same))
    twice = PF.digests(spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 1, 0), ("c", 1, None), ("d", 0, 1)], SCHEMA))
    assert {r["set"]: r.n_equal for r in twice.collect()} == dict.fromkeys("abcd", 1)


def test_files_and_folders_by_name(spark, tmp_path):
    """Single files, a folder of the sink and folders of ``write_sets`` in one scan."""
    (tmp_path / "plus+ one.csv").write_text("PassengerId,Survived\n892,0\n893,1\n")
    (tmp_path / "empty.csv").write_text("PassengerId,Survived\n")
    (tmp_path / "notes.txt").write_text("not a set")
    rows = [("a b", 892, 0), ("a b", 893, 1), ("é/x=1", 892, 1)]
    sets = spark.createDataFrame(rows, SCHEMA)
    files.sink_predictions(sets.where("set = 'a b'"), "PassengerId", "Survived", "t", base=str(tmp_path / "sunk"))
    PF.write_sets(sets, str(tmp_path / "written"))
    got = sorted(tuple(r) for r in PF.read_sets(spark, str(tmp_path)).collect())
    assert got == sorted(rows + [("plus+ one", 892, 0), ("plus+ one", 893, 1), ("sunk", 892, 0), ("sunk", 893, 1)])
    same = {r["set"]: r.first_set for r in PF.digests(PF.read_sets(spark, str(tmp_path))).collect()}
    assert same == {"a b": "a b", "plus+ one": "a b", "sunk": "a b", "é/x=1": "é/x=1"}


def test_no_sets(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert PF.agreement(none).count() == 0 and PF.digests(none).count() == 0


def test_no_column_a_file(spark):
    """300 sets are rows of one scan."""
    rows = [(f"s{k:03}", i, int(i % (k % 7 + 2) == 0)) for k in range(300) for i in range(20)]
    want = plain_agreement(rows)
    assert len(want) == 300 * 299 // 2
    assert {(r.set_a, r.set_b): tuple(r)[2:] for r in PF.agreement(spark.createDataFrame(rows, SCHEMA)).collect()} == want
