"""Viterbi in segments against all paths, and recovered roles."""

from itertools import product

import numpy as np
from llm_tables import none_of, table
from pyspark.sql import functions as F

from kinfold.llm import transcripts
from kinfold.llm.queries import QUERIES


def some_model(seed, roles=2):
    rng = np.random.default_rng(seed)
    n = 2 * roles
    draw = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1]) if len(s) > 1 else rng.dirichlet(np.ones(s[0])))
    emit = [{k: np.log(rng.random(n)) for k in ("\0", *ks)} for ks in (("", "user", "bot"), ("1", "2", "3?"), ("line", "item"))]
    return transcripts.Model([f"r{i}" for i in range(roles)], draw(n + 1, n), emit)


TEXTS = ["User: a", "bot> yes?", "- it", "", "plain words", "a", "User: abc?"]


def best_path(model, texts):
    n = 2 * len(model.roles)
    e = [model.scores(t) for t in texts]
    def score(p):
        return model.move[n][p[0]] + sum(model.move[a][b] for a, b in zip(p, p[1:])) + sum(x[s] for x, s in zip(e, p))
    return max(product(range(n), repeat=len(texts)), key=score)


def in_segments(model, texts, size):
    parts = [texts[i:i + size] for i in range(0, len(texts), size)]
    ends = transcripts.between([transcripts.segment_matrix(model, p) for p in parts])
    return tuple(s for p, (a, b) in zip(parts, ends) for s in transcripts.decode(model, p, a, b))


def test_segments_give_the_best_path():
    for seed in range(12):
        rng = np.random.default_rng(seed + 100)
        model, texts = some_model(seed), [TEXTS[i] for i in rng.integers(0, len(TEXTS), 6)]
        want = best_path(model, texts)
        assert all(in_segments(model, texts, k) == want for k in (1, 2, 4, 6))


def frame(spark, rows):
    return spark.createDataFrame([(c, p, i, t, "x", 9) for c, p, i, t in rows], "conv_id long, part long, line long, text string, seg string, turn long")


def test_job_gives_the_same_for_every_segment_size(spark):
    model = some_model(7)
    rng = np.random.default_rng(1)
    rows = [(c, p, i, TEXTS[rng.integers(0, len(TEXTS))]) for c in range(5) for p in range(9) for i in range(int(rng.integers(1, 4)))]
    want = {}
    for c in range(5):
        own = sorted(r for r in rows if r[0] == c)
        states = in_segments(model, [r[3] for r in own], len(own))
        turn = np.cumsum([s % 2 == 0 for s in states])
        want |= {r[:3]: (model.roles[s // 2], t) for r, s, t in zip(own, states, turn.tolist())}
    for size in (1, 4, 256):
        got = {(r.conv_id, r.part, r.line): (r.role, r.turn) for r in transcripts.parse(frame(spark, rows), model, size).collect()}
        assert got == want


def test_roles_of_held_out_conversations(spark):
    lines = transcripts.as_transcripts(table(spark, "conversations", "sf0.01"))
    model = transcripts.fit(lines.where(transcripts.trained_on()))
    held = lines.where(~transcripts.trained_on())
    got = transcripts.parse(held.drop("role"), model).alias("g").join(held.alias("h"), ["conv_id", "part", "line"])
    marked = got.withColumn("ok", (F.col("g.role") == F.col("h.role")).cast("int"))
    assert got.count() == held.count()
    assert marked.agg(F.avg("ok")).first()[0] > 0.8
    assert marked.where(F.col("h.text").rlike("^(User|Assistant|System|Q|A|Note): ")).agg(F.avg("ok")).first()[0] > 0.98


def test_query_renders_all_lines(spark):
    rows = QUERIES["op8_chat_transcripts"](spark, "/root/testdata/sf0.001").collect()
    lines = transcripts.as_transcripts(table(spark, "conversations"))
    assert sum(r.n_lines for r in rows) == lines.count()
    assert {r.conv_id for r in rows} == {r.conv_id for r in lines.select("conv_id").distinct().collect()}
    for r in rows:
        assert r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>")
    turns = {(r.conv_id, r.turn) for r in rows}
    assert len(turns) == len(rows)


def test_rendering(spark):
    rows = [(1, 0, 0, "User:  hello", "user", 1), (1, 0, 1, "more", "user", 1), (1, 1, 0, "fine", "bot", 2)]
    got = transcripts.render(spark.createDataFrame(rows, "conv_id long, part long, line long, text string, role string, turn long")).orderBy("turn").collect()
    assert [(r.role, r.n_lines, r.rendered) for r in got] == [("user", 2, "<|user|>\nhello\nmore\n<|end|>"), ("bot", 1, "<|bot|>\nfine\n<|end|>")]


def test_odd_rows(spark):
    model = some_model(3)
    rows = [(1, 0, 0, None), (1, None, None, "User: x"), (None, 0, 0, "a"), (None, 5, 1, "b"), (2, 0, 0, ""), (2, 0, 0, ""), (3, 10**12, 0, "far " * 20000)]
    got = transcripts.parse(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and {r.conv_id for r in got} == {None, 1, 2, 3}
    assert sum(r.n_lines for r in transcripts.render(transcripts.parse(frame(spark, rows), model)).collect()) == len(rows)
    assert transcripts.parse(none_of(frame(spark, rows)), model).collect() == []


def test_rare_markers_count_as_one(spark):
    """Lines of markers beyond the list count in their states: every line does."""
    rare = transcripts.MARKERS + 200
    often = [(i, "often: b", "bot") for i in range(rare, rare + 300)]
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    rows = [(i, 0, 0, f"{name(i)}: a", "user") for i in range(rare)] + [(i, 0, 0, t, r) for i, t, r in often]
    model = transcripts.fit(spark.createDataFrame(rows, "conv_id long, part long, line long, text string, role string"))
    emit = model.emit[0]
    assert len(emit) == transcripts.MARKERS + 1 and model.roles == ["bot", "user"]
    shares = {v: np.exp(x) for v, x in emit.items()}
    others = rare - (transcripts.MARKERS - 1)  # one place of the list is that of "often"
    assert np.allclose(shares["\0"], [1 / (300 + len(emit)), 1 / len(emit), (others + 1) / (rare + len(emit)), 1 / len(emit)])
    assert np.allclose(sum(shares.values()), 1)
    state = model.scores("unheard: c") - model.scores("often: c")
    assert state[2] > 0 > state[0]


def test_untaught(spark):
    talk = spark.createDataFrame([(1, 0, None, "a\nb"), (1, 1, None, "c")], "conv_id long, turn long, role string, text string")
    lines = transcripts.as_transcripts(talk)
    model = transcripts.fit(lines)
    assert model.roles == []
    assert [(r.role, r.turn, r.n_lines) for r in transcripts.render(transcripts.parse(lines, model)).collect()] == [("unknown", 1, 3)]


def test_one_conversation_of_all_rows_is_many_segments(spark):
    """Null conv_id, null and repeated parts: segments are cut by lines, whatever the turn numbers."""
    rows = [(None, None if i % 2 else 3, 0, f"line {i % 500}") for i in range(3000)]
    df = frame(spark, rows).repartition(8)
    cut = transcripts.segments(df, 64).groupBy("seg").agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert sum(r.n for r in cut) == 3000 and all(r.n <= 64 and (r.a, r.b) == (0, r.n - 1) for r in cut)
    assert len({r.seg >> 32 for r in cut}) > 1  # in more than one task
    model = some_model(3)
    order = sorted(transcripts.parse(df, model, 64).collect(), key=lambda r: (r.seg, r.at))
    # The same lines in the order of their places, in one piece.
    assert [(r.part is not None, r.text[:64]) for r in order] == sorted((r[1] is not None, r[3]) for r in rows)
    states = transcripts.decode(model, [r.text for r in order], *transcripts.between([transcripts.segment_matrix(model, [r.text for r in order])])[0])
    firsts = np.cumsum([s % 2 == 0 for s in states])
    assert [(r.role, r.turn) for r in order] == [(model.roles[s // 2], t) for s, t in zip(states, firsts)]


def test_a_long_turn_comes_in_pieces(spark):
    rows = [(1, seg, at, f"l{seg}-{at}", "user", 1) for seg in range(7) for at in range(3)] + [(2, 9, 0, "User: short", "user", 1)]
    df = spark.createDataFrame(rows, "conv_id long, seg long, at int, text string, role string, turn long")
    got = transcripts.render(df, turn_lines=10, piece_segments=2).orderBy("conv_id", "piece").collect()
    assert [(r.conv_id, r.piece, r.n_lines) for r in got] == [(1, 0, 6), (1, 1, 6), (1, 2, 6), (1, 3, 3), (2, 0, 1)]
    whole = "<|user|>\n" + "\n".join(f"l{s}-{a}" for s in range(7) for a in range(3)) + "\n<|end|>"
    assert "\n".join(r.rendered for r in got if r.conv_id == 1) == whole
    assert got[-1].rendered == "<|user|>\nshort\n<|end|>"
    assert [r.n_lines for r in transcripts.render(df).orderBy("conv_id").collect()] == [21, 1]


def test_roles_without_any_marker(spark):
    lines = transcripts.as_transcripts(table(spark, "conversations", "sf0.01"))
    model = transcripts.fit(lines.where(transcripts.trained_on()))
    bare = lines.where(~transcripts.trained_on() & (F.pmod(F.xxhash64(F.lit("manner"), "conv_id"), F.lit(4)) == 3))
    got = transcripts.parse(bare.drop("role"), model).alias("g").join(bare.alias("h"), ["conv_id", "part", "line"])
    assert got.agg(F.avg((F.col("g.role") == F.col("h.role")).cast("int"))).first()[0] > 0.55


def test_many_roles_become_other(spark):
    rows = [(i, 0, 0, "x", f"r{i:03d}") for i in range(100)] + [(i, 1, 0, "y", "r000") for i in range(5)]
    model = transcripts.fit(spark.createDataFrame(rows, "conv_id long, part long, line long, text string, role string"))
    assert len(model.roles) == transcripts.ROLES and "other" in model.roles and "r000" in model.roles
