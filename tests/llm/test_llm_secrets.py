"""Secret spans against Python's re, and the ledger's increments."""

import hashlib
import re

from llm_tables import none_of, odd_documents
from oracle_check import compare, duck
from pyspark.sql import functions as F

from kinfold.llm import secrets
from kinfold.llm.queries import ORACLES, QUERIES

TEXTS = [
    (1, 'token = "abcdef123456" and PASSWORD: hunter22, api_key=abc api-key=abcdefg'), (2, "secret=token:abcdefgh token=secret=longer"),
    (3, "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIAAKIA" + "C1" * 9), (4, "deadbeef" * 3 + " " + "0" * 23 + "g" + "f" * 24 + "é" + "1" * 30),
    (5, "\U0001f600é Token:\"AKIA" + "Z" * 20 + "\" passwd  =  '" + "0123456789abcdef" * 2 + "'"), (6, None), (7, ""), (8, "no such thing"),
    (9, "-----BEGIN RSA PRIVATE KEY-----\nabc"), (1, "a second version of path 1: secret: zzzzzz"), (10, "no such thing"), (10, "no such thing"),
    (None, "token=nullnull"), (11, "ſecret=abcdefgh toKen=kelvin K"), (12, "token=abcdef " * 3000)]


def spans(text):
    out = []
    for i, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII if i else re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)


def digest(text):
    s = spans(text)
    base = ",".join(f"{k}:{a}:{b}" for a, i, k, b in s if i < 3)
    n = [sum(k == r.kind for _, _, k, _ in s) for r in secrets.BASE_RULES]
    return (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, k, b in s))


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "b", 1, "x") for i, t in rows], "doc_id long, text string, blob string, version int, rule string")


def test_report(spark):
    got = sorted((tuple(r) for r in secrets.report(frame(spark)).collect()), key=str)
    plain = [(i, t) for i, t in TEXTS if i != 11]
    want = sorted(((i, *digest(t)) for i, t in plain), key=str)
    assert [r for r in got if r[0] != 11] == want
    eleven = next(r for r in got if r[0] == 11)  # only A-Z and a-z have another case
    assert eleven[1] == 1 and eleven[5] == "assign:16:28"


def test_query_equals_sql(spark):
    r = compare(spark, duck("/root/testdata/sf0.01"), "op5", QUERIES["op5_secret_ledger"], ORACLES["op5_secret_ledger"], "/root/testdata/sf0.01")
    assert r["status"] == "ok", r


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = frame(spark, TEXTS[:4])
    secrets.scan_into(first, path)
    pairs = 4 * len(secrets.RULES)
    assert secrets.read_ledger(spark, path).count() == pairs
    # The same texts on other paths: nothing to scan, all findings there.
    moved = first.withColumn("doc_id", F.col("doc_id") + 100)
    assert secrets.scan(moved, secrets.read_ledger(spark, path)).count() == 0
    got = {r.doc_id: r.spans for r in secrets.report(moved, path).collect()}
    assert got == {i + 100: digest(t)[-1] for i, t in TEXTS[:4]}
    # One new blob, and one rule in a new version.
    more = frame(spark, TEXTS[:5])
    new = secrets.scan(more, secrets.read_ledger(spark, path))
    assert new.count() == len(secrets.RULES) and new.select("blob").distinct().count() == 1
    rules = tuple(r._replace(version=2, least=2) if r.kind == "hex" else r for r in secrets.RULES)
    new = secrets.scan(first, secrets.read_ledger(spark, path), rules)
    assert new.select("rule", "version").distinct().collect() == [("hex", 2)] and new.count() == 4


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = secrets.report(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert secrets.report(none_of(docs)).collect() == []


def test_no_python_on_the_path(spark):
    plan = secrets.report(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
