"""Chat formatting: roles of transcript lines by a hidden Markov model, and
turns in one canonical form.

A transcript is lines in parts: (conv_id, part, line, text), ordered by part,
then line. States are a role's first line of a turn and its further lines.
A line shows its speaker marker (``Name:`` or ``Name>`` at its start), its
length, its ending and whether it is a list item. The model counts starts,
transitions and features in labelled turns, with one added to each count.

Lines are dealt by ranges of their place (conversation, part, line) and each
task cuts its own into segments of at most ``SEGMENT`` lines, so a conversation
of most rows is many segments in many tasks, however its parts are numbered.
Viterbi runs over segments: the best score from each state before a segment to
each state at its end is a small matrix. The matrices of a conversation in one
task are multiplied to one; those of all tasks give the states between the
tasks, these the states between the segments, and then each segment is decoded
between its two states. No step holds more than a segment's lines, the matrices
of one task's segments, or a matrix for each task.

A turn is one row, unless it has more than ``TURN_LINES`` lines: then it comes in
pieces, the first with the opening mark and the last with the closing one.

Defined results: a null text is an empty line; a null part or line comes first;
rows of null conv_id are one conversation; repeated lines are lines; lines of
equal place are in the order of the first 64 characters of their texts, then of
their digests; without training rows all lines are one turn of role ``unknown``
each conversation; roles beyond the ``ROLES`` most frequent are one role,
``other``; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, drop_tables, runs, write_table

SEGMENT = 256
#: Segments of one task that make a piece of a long turn, and the lines above which a turn is one.
PIECE_SEGMENTS, TURN_LINES = 256, 100_000
#: Roles that the model tells apart.
ROLES = 64
#: Marker words that the model tells apart, the most frequent; others are one.
MARKERS = 1000

_MARKER = re.compile(r"^[\s#*<\[(|]*([^\W\d_][\w .-]{0,30}?)[\s\])|*]*[:>]+\s*")
_ITEM = re.compile(r"^\s*([-*•]|\d+[.)])\s")


def marker(text: str) -> str:
    m = _MARKER.match(text)
    return m[1].strip().lower() if m else ""


def features(text: str) -> tuple[str, str, str]:
    """Marker, length and ending, kind of start."""
    body = text.strip()
    return marker(text), f"{min(len(body), 1 << 12).bit_length()}{body[-1:] if body[-1:] in '?!:.,;' else ''}", "item" if _ITEM.match(text) else "line"


class Model(NamedTuple):
    """Log probabilities. States 2r and 2r + 1 are the first and the further
    lines of role r; the last row of ``move`` is the start."""
    roles: list[str]
    move: np.ndarray
    emit: list[dict[str, np.ndarray]]

    def scores(self, text: str) -> np.ndarray:
        """Of a line in each state."""
        return sum(e.get(v, e["\0"]) for e, v in zip(self.emit, features(text), strict=True))


def _log_share(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(lines: DataFrame) -> Model:
    """From (conv_id, part, line, text, role), a part being a turn. All rows
    count; the driver gets counts of states and feature values only."""
    arrow_limits(lines.sparkSession)

    def shown(batches):
        for batch in batches:
            got = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("role", "first")), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))],
                                             names=["role", "first", "f0", "f1", "f2"])
    known = lines.where("role IS NOT NULL")
    often = [r[0] for r in known.groupBy("role").count().orderBy(F.col("count").desc(), "role").limit(ROLES + 1).collect()]
    if len(often) > ROLES:
        known = known.withColumn("role", F.when(F.col("role").isin(often[:ROLES - 1]), F.col("role")).otherwise("other"))
    each, at = write_table(known.select("role", (F.col("line") == 0).alias("first"), "text")
                           .mapInArrow(shown, "role string, first boolean, f0 string, f1 string, f2 string"), "chat-features")
    roles = sorted(r[0] for r in each.select("role").distinct().collect())
    n = 2 * len(roles)
    state = {(r, f): 2 * i + (not f) for i, r in enumerate(roles) for f in (True, False)}
    emit = []
    for c in ("f0", "f1", "f2"):
        top = each.groupBy(c).count().orderBy(F.col("count").desc(), c).limit(MARKERS).select(c, F.lit(True).alias("told"))
        value = F.when(F.col("told"), F.col(c)).otherwise(F.lit("\0"))  # lines of the others count as those of one value
        seen = each.join(F.broadcast(top), c, "left").groupBy("role", "first", value.alias(c)).count().collect()
        table = {v: np.ones(n) for v in ["\0", *sorted({r[c] for r in seen})]}
        for r in seen:
            table[r[c]][state[r["role"], bool(r["first"])]] += r["count"]
        total = sum(table.values(), np.zeros(n))
        emit.append({v: np.log(x / total) for v, x in table.items()})
    drop_tables(lines.sparkSession, [at])
    # One row for each turn, then pairs of turns that follow each other.
    turns = known.groupBy("conv_id", "part").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n"))
    then = turns.select("conv_id", (F.col("part") - 1).alias("part"), F.col("role").alias("next"))
    before = turns.select("conv_id", (F.col("part") + 1).alias("part"), F.lit(1).alias("has"))
    steps = turns.join(then, ["conv_id", "part"], "left").join(before, ["conv_id", "part"], "left") \
        .groupBy("role", "next", (F.col("n") > 1).alias("long"), F.col("has").isNull().alias("start")) \
        .agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("n")).collect()
    move = np.ones((n + 1, n))
    for r in steps:
        a = state[r["role"], True]
        last = a + 1 if r["long"] else a
        if r["long"]:
            move[a, a + 1] += r["turns"]
            move[a + 1, a + 1] += r["n"] - 2 * r["turns"]
        if r["next"] is not None:
            move[last, state[r["next"], True]] += r["turns"]
        if r["start"]:
            move[n, a] += r["turns"]
    for i in range(n + 1):  # a further line follows a line of its role only
        for j in range(1, n, 2):
            if i // 2 != j // 2 or i == n:
                move[i, j] = 1e-9
    return Model(roles, _log_share(move) if n else move, emit)


def segment_matrix(model: Model, texts: list[str]) -> np.ndarray:
    """Best score from each state before (the last: the start) to each at the end."""
    best = model.move + model.scores(texts[0])
    step = model.move[:-1]
    for t in texts[1:]:
        best = (best[:, :, None] + step[None]).max(axis=1) + model.scores(t)
    return best


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of segments that follow each other."""
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None, :-1]).max(axis=1)
    return best


def between(matrices: list[np.ndarray], before: int | None = None, end: int | None = None) -> list[tuple[int, int]]:
    """State before and at the end of each matrix's lines, from the state
    ``before`` (or the start) to the state ``end`` (or the best)."""
    n = matrices[0].shape[1]
    before = n if before is None else before
    score, back = matrices[0][before], []
    for m in matrices[1:]:
        to = score[:, None] + m[:-1]
        back.append(to.argmax(axis=0))
        score = to.max(axis=0)
    ends = [int(score.argmax()) if end is None else end]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([before, *ends], ends, strict=False))


def decode(model: Model, texts: list[str], before: int, end: int) -> list[int]:
    """States of a segment's lines between two states."""
    score, back = model.move[before] + model.scores(texts[0]), []
    for t in texts[1:]:
        to = score[:, None] + model.move[:-1]
        back.append(to.argmax(axis=0))
        score = to.max(axis=0) + model.scores(t)
    out = [end]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


_LINES = "conv_id long, seg long, at int, part long, line long, text string"


def segments(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Lines in the order of their place with seg and at: segments of at most
    ``segment`` lines of one conversation, their numbers ascending with the place."""
    place = ("conv_id", "part", "line", "__start", "__md5", "__row")
    text = F.coalesce("text", F.lit(""))
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The keys after the line let the ranges split a place that many rows share.
    dealt = (lines.select(*[F.col(c).cast("long").alias(c) for c in place[:3]], text.alias("text"))
             .withColumns({"__start": F.substring("text", 1, 64), "__md5": F.md5("text"), "__row": F.monotonically_increasing_id()})
             .repartitionByRange(n, *place).sortWithinPartitions(*place).select("conv_id", "part", "line", "text"))

    def cut(batches):
        conv, seg, at, begun = None, TaskContext.get().partitionId() << 32, 0, False
        for batch in batches:
            segs, ats = [], []
            for c in batch.column("conv_id").to_pylist():
                if begun and (c != conv or at == segment):
                    seg, at = seg + 1, 0
                conv, begun = c, True
                segs.append(seg)
                ats.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(segs, pa.int64()), pa.array(ats, pa.int32()), *(batch.column(c) for c in ("part", "line", "text"))],
                names=["conv_id", "seg", "at", "part", "line", "text"])
    return dealt.mapInArrow(cut, _LINES)


def _task() -> F.Column:
    return F.shiftright("seg", 32).alias("task")


def parse(lines: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """Per line: conv_id, seg and at (its place), part, line, text, role and turn
    (numbered from 1; lines before the first turn's first line have turn 0)."""
    spark = lines.sparkSession
    arrow_limits(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, at_rows = write_table(segments(lines, segment), "chat-lines")
    if not model.roles:
        return rows.select("*", F.lit("unknown").alias("role"), F.lit(1).cast("long").alias("turn"))
    size = 2 * len(model.roles)
    flat = pa.list_(pa.float64())

    def matrix(batches):
        for (conv, seg), held in runs(batches, ("conv_id", "seg"), ("text",)):
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "seg": pa.array([seg], pa.int64()),
                                              "m": pa.array([segment_matrix(model, [h[0] for h in held]).ravel().tolist()], flat)})

    def unfold(ms):
        return [np.array(m).reshape(size + 1, size) for m in ms]

    def folded(batches):
        for (conv, task), held in runs(batches, ("conv_id", "task"), ("m",)):
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "task": pa.array([task], pa.int64()),
                                              "m": pa.array([product(unfold(h[0] for h in held)).ravel().tolist()], flat)})

    def over_tasks(batches):
        for (conv,), held in runs(batches, ("conv_id",), ("task", "m")):
            got = between(unfold(h[1] for h in held))
            yield pa.RecordBatch.from_pydict({"__conv": pa.array([conv] * len(held), pa.int64()), "__task": pa.array([h[0] for h in held], pa.int64()),
                                              "before": pa.array([g[0] for g in got], pa.int32()), "end": pa.array([g[1] for g in got], pa.int32())})

    def over_segments(batches):
        for (_, _, before, end), held in runs(batches, ("conv_id", "task", "before", "end"), ("seg", "m")):
            got = between(unfold(h[1] for h in held), before, end)
            yield pa.RecordBatch.from_pydict({"seg": pa.array([h[0] for h in held], pa.int64()),
                                              "before": pa.array([g[0] for g in got], pa.int32()), "end": pa.array([g[1] for g in got], pa.int32())})

    def states(batches):
        for (conv, seg, before, end), held in runs(batches, ("conv_id", "seg", "before", "end"), ("at", "part", "line", "text")):
            got = decode(model, [h[3] for h in held], before, end)
            firsts = np.cumsum([s % 2 == 0 for s in got])
            k = len(held)
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv] * k, pa.int64()), "seg": pa.array([seg] * k, pa.int64()), "at": pa.array([h[0] for h in held], pa.int32()),
                "part": pa.array([h[1] for h in held], pa.int64()), "line": pa.array([h[2] for h in held], pa.int64()),
                "text": pa.array([h[3] for h in held], pa.string()), "role": pa.array([model.roles[s // 2] for s in got]), "turn": pa.array(firsts, pa.int64())})

    by_seg = rows.repartition(n, "seg")
    matrices, at_m = write_table(by_seg.sortWithinPartitions("seg", "at").select("conv_id", "seg", "text")
                                 .mapInArrow(matrix, "conv_id long, seg long, m array<double>"), "chat-matrices")
    tasks = matrices.withColumn("task", _task())
    wholes = (tasks.repartition(n, "conv_id", "task").sortWithinPartitions("conv_id", "task", "seg").select("conv_id", "task", "m")
              .mapInArrow(folded, "conv_id long, task long, m array<double>"))
    outer = (wholes.repartition(n, "conv_id").sortWithinPartitions("conv_id", "task")
             .mapInArrow(over_tasks, "__conv long, __task long, before int, end int"))
    known, at_k = write_table(
        tasks.join(outer, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("task") == F.col("__task"))).drop("__conv", "__task")
        .repartition(n, "conv_id", "task").sortWithinPartitions("conv_id", "task", "seg")
        .mapInArrow(over_segments, "seg long, before int, end int"), "chat-segments")
    decoded, _ = write_table(by_seg.join(known, "seg").repartition(n, "seg").sortWithinPartitions("seg", "at")
                             .mapInArrow(states, _LINES + ", role string, turn long"), "chat-decoded")
    drop_tables(spark, [at_rows, at_m, at_k])
    # A turn's number: turns begun in the tasks before, in the segments before, and in this one.
    begun = decoded.groupBy("conv_id", "seg").agg(F.max("turn").alias("n")).withColumn("task", _task())
    sums = begun.groupBy("conv_id", "task").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = sums.select(F.col("conv_id").alias("__conv"), F.col("task").alias("__task"), before(Window.partitionBy("conv_id").orderBy("task")).alias("tasks"))
    offset = begun.join(earlier, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("task") == F.col("__task"))) \
        .select("seg", (F.col("tasks") + before(Window.partitionBy("conv_id", "task").orderBy("seg"))).alias("offset"))
    return decoded.join(offset, "seg").withColumn("turn", F.col("turn") + F.col("offset")) \
        .select("conv_id", "seg", "at", "part", "line", "text", "role", "turn")


def render(parsed: DataFrame, turn_lines: int = TURN_LINES, piece_segments: int = PIECE_SEGMENTS) -> DataFrame:
    """One row per recovered turn: conv_id, turn, piece (0), role, n_lines and
    rendered, ``<|role|>``, the lines without the speaker marker, and ``<|end|>``.
    A turn of more than ``turn_lines`` lines has a row for each piece."""
    if "seg" not in parsed.columns:  # lines whose place is their part and line
        parsed = parsed.withColumns({"seg": F.lit(0).cast("long"), "at": F.lit(0)})
    order = F.struct("seg", "at", *[c for c in ("part", "line") if c in parsed.columns], "text")
    block = F.struct(_task(), F.expr(f"(seg & 4294967295) div {piece_segments}").alias("i"))
    blocks = parsed.groupBy("conv_id", "turn", block.alias("block")).agg(
        F.max("role").alias("role"), F.count(F.lit(1)).alias("n"), F.collect_list(order).alias("ls"))
    turn = Window.partitionBy("conv_id", "turn")
    long = F.sum("n").over(turn) > turn_lines
    piece = F.when(long, F.row_number().over(turn.orderBy("block")) - 1).otherwise(0)
    pieces = blocks.withColumn("piece", piece).groupBy("conv_id", "turn", "piece").agg(
        F.max("role").alias("role"), F.sum("n").alias("n_lines"), F.flatten(F.collect_list("ls")).alias("ls"))
    lines = F.transform(F.array_sort("ls"), lambda x: x["text"])
    rows = pieces.withColumn("last", F.col("piece") == F.max("piece").over(turn)).select("conv_id", "turn", "piece", "role", "n_lines", "last", lines.alias("lines"))
    arrow_limits(parsed.sparkSession)

    def text(batches):
        for batch in batches:
            out = []
            for piece, role, last, held in zip(*(batch.column(c).to_pylist() for c in ("piece", "role", "last", "lines")), strict=True):
                if not piece and marker(held[0]):
                    held[0] = _MARKER.sub("", held[0], count=1)
                body = "\n".join(held)
                body = body.strip() if not piece and last else body.lstrip() if not piece else body.rstrip() if last else body
                out.append((f"<|{role}|>\n" if not piece else "") + body + ("\n<|end|>" if last else ""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "piece", "role", "n_lines")), pa.array(out, pa.string())],
                                             names=["conv_id", "turn", "piece", "role", "n_lines", "rendered"])
    return rows.mapInArrow(text, "conv_id long, turn long, piece int, role string, n_lines long, rendered string")


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as lines of transcripts with the role beside
    them: by conversation in one of four manners of speaker markers, the last
    without any. Makes input only; ``parse`` is not given the role."""
    manner = F.pmod(F.xxhash64(F.lit("manner"), "conv_id"), F.lit(4))
    named = F.create_map(*[F.lit(x) for x in (
        "0user", "User: ", "0assistant", "Assistant: ", "0system", "System: ", "1user", "Q: ", "1assistant", "A: ", "1system", "Note: ",
        "2user", "[human]> ", "2assistant", "[bot]> ", "2system", "[setup]> ")])
    marked = F.concat(F.coalesce(named[F.concat(manner.cast("string"), "role")], F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("part"), "role",
                                F.posexplode(F.split(marked, "\n")).alias("line", "text")) \
        .select("conv_id", "part", F.col("line").cast("long").alias("line"), "text", "role")


def trained_on() -> F.Column:
    """Conversations that the query's model is fitted on; the others are held out."""
    return F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
