"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is a run of documents of one task, closed at ``SHARD_WORDS`` words. Its
words become symbols: one for each distinct word of the benchmark block, and 0
for all others, which no phrase holds (0s in a row are one). The index of the
shard is searched backwards for all test phrases at once through its wavelet
matrix, the occurrences are located by sampled suffix positions, and the words
they cover are merged into removal spans.

The benchmark is a stated query set and goes against all documents in blocks:
items are cut into pieces (that overlap by a window less one word) and dealt
into blocks of about ``BLOCK_BYTES``, equal pieces as one; only one block is
broadcast at a time, and the documents carry what they have gathered from block
to block. No shuffle touches the documents, and the phrases that most documents
hold cost no more than their occurrences.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window
is ``WINDOW`` consecutive words of an item; an item of fewer words, but not
none, is one window.

Defined results: a null or empty text has no words and no hits; an item that
is null or has no words gives no window; items of equal item_id count as one,
a null item_id counts as the empty string; every row of the documents gives a
row, repeated ones too; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, drop_tables, text_bytes, whole_row, word_spans, words, write_table
from .fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
#: Words of one piece of an item.
PIECE_WORDS = 4096

_GATHERED = [T.StructField("__n_words", T.LongType()), T.StructField("__hits", T.ArrayType(T.LongType())),
             T.StructField("__items", T.ArrayType(T.StringType()))]


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id as text, words joined by a space) of at most PIECE_WORDS words;
    each window of an item is in exactly one piece."""
    arrow_limits(benchmark.sparkSession)

    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch), strict=True):
                ws = words(text)
                for i in range(0, max(1, len(ws) - window + 1) if ws else 0, PIECE_WORDS - window + 1):
                    ids.append(item or "")
                    out.append(b" ".join(ws[i:i + PIECE_WORDS]).decode())
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "words": pa.array(out, pa.string())})
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, words string")


class Phrases:
    """The windows of one benchmark block as symbols."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in rows:
            ws = text.encode().split(b" ")
            for i in range(max(1, len(ws) - window + 1)):
                found.setdefault(tuple(ws[i:i + window]), set()).add(item)
        self.symbol: dict[bytes, int] = {}
        for phrase in found:
            for w in phrase:
                self.symbol.setdefault(w, len(self.symbol) + 1)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.patterns = np.zeros((len(found), max(map(len, found), default=0)), np.int64)
        for row, phrase in zip(self.patterns, found, strict=True):
            row[len(row) - len(phrase):] = [self.symbol[w] for w in phrase]


class Shard:
    """The documents of one index, gathered word by word."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.counts, self.n = phrases, [], [], 0
        self.symbol_of = phrases.symbol.get

    def add(self, text: bytes | None) -> None:
        ws = words(text)
        self.counts.append(len(ws))
        self.parts.append(np.fromiter(map(self.symbol_of, ws, _ZEROS), np.int32, len(ws)))
        self.n += len(ws)

    def hits(self) -> list[tuple[list[int], list[str]]]:
        """Per document: the word spans covered, as start and end in turn, and the items found."""
        out: list[tuple[list[int], list[str]]] = [([], []) for _ in self.counts]
        starts = np.cumsum([0, *self.counts])
        # Each document is closed by a 0; the 0s in a row become one.
        raw = np.zeros(self.n + len(self.parts), np.int32)
        place = np.arange(self.n) + np.repeat(np.arange(len(self.parts)), self.counts)
        raw[place] = np.concatenate([*self.parts, np.empty(0, np.int32)])
        kept = np.flatnonzero((raw != 0) | np.concatenate(([True], raw[:-1] != 0)))
        symbols = np.concatenate((raw[kept], [0]))
        index = FMIndex(symbols.astype(np.int64), len(self.phrases.symbol) + 1)
        lo, hi = index.search(self.phrases.patterns, self.phrases.lengths)
        n = hi - lo
        if not n.sum():
            return out
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        at = kept[index.locate(rows)]
        word = np.searchsorted(place, at)  # of the shard
        doc = np.searchsorted(starts, word, "right") - 1
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + self.phrases.lengths[which], -1)
        covered = np.cumsum(edge[:-1]) > 0
        for d in np.unique(doc).tolist():
            own = np.concatenate(([False], covered[starts[d]:starts[d + 1]], [False]))
            out[d] = (np.flatnonzero(own[1:] != own[:-1]).tolist(), [])
        for d, p in np.unique(np.stack((doc, which), axis=1), axis=0).tolist():
            out[d][1].extend(self.phrases.items[p])
        return out


class _Endless:
    """0, 0, 0, ..."""

    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Endless()


def merge_spans(flat: list[int]) -> list[int]:
    """Spans given as start and end in turn, merged where they touch."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(rows: list[tuple[str, str]], window: int, first: bool):
    """mapInArrow function that adds one block's hits to what the documents have gathered."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(rows, window)
        held: list[pa.RecordBatch] = []
        shard = Shard(phrases)

        def close():
            got, i = shard.hits(), 0
            for batch in held:
                own, counts = got[i:i + batch.num_rows], shard.counts[i:i + batch.num_rows]
                i += batch.num_rows
                if first:
                    base = batch.columns
                    before = [([], [])] * batch.num_rows
                else:
                    base = batch.columns[:-3]
                    before = list(zip(batch.column("__hits").to_pylist(), batch.column("__items").to_pylist(), strict=True))
                hits = [merge_spans(a[0] + b[0]) if b[0] else a[0] for a, b in zip(before, own, strict=True)]
                items = [sorted({*a[1], *b[1]}) if b[1] else a[1] for a, b in zip(before, own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*base, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=[*batch.schema.names[:len(base)], *(f.name for f in _GATHERED)])

        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                for text in text_bytes(batch):
                    shard.add(text)
                held.append(batch)
                if shard.n >= SHARD_WORDS:
                    yield from close()
                    held, shard = [], Shard(phrases)
        if held:
            yield from close()
    return search


def gather(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (with a ``text``) and __n_words, __hits (word spans,
    start and end in turn) and __items of all benchmark blocks."""
    spark = docs.sparkSession
    arrow_limits(spark)
    cut, at = write_table(pieces(benchmark, window).distinct(), "benchmark-pieces")
    total = cut.agg(F.sum(F.length("words") + F.length("item_id"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    out = docs
    for b in range(blocks):
        if b:
            out, _ = write_table(out, "decontaminated")
        rows = [tuple(r) for r in cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).select("item_id", "words").collect()]
        schema = T.StructType([*docs.schema.fields, *_GATHERED])
        out = out.mapInArrow(_search(rows, window, b == 0), schema)
    drop_tables(spark, [at])
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and removal_spans (word spans [start, end) as start:end)."""
    def digest(batches):
        for batch in batches:
            hits, items = batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()
            n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__n_words"), pa.array(n_hit, pa.int64()),
                 pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                 pa.array([x > 0 for x in n_hit]),
                 pa.array([",".join(f"{a}:{b}" for a, b in zip(h[::2], h[1::2], strict=True)) for h in hits])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "removal_spans"])
    return gather(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window).drop("text").mapInArrow(
        digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, removal_spans string")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the removal spans cut out of their texts, from
    the first character of a span's first word to the last of its last."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")

    def cut(batches):
        for batch in batches:
            out = []
            for text, hits in zip(text_bytes(batch), batch.column("__hits").to_pylist(), strict=True):
                if hits:
                    spans = word_spans(text)
                    ends = [0, *(e for a, b in zip(hits[::2], hits[1::2], strict=True) for e in (spans[a][0], spans[b - 1][1])), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append(text)
            i = batch.schema.get_field_index("text")
            cleaned = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if j == i else c for j, c in enumerate(batch.columns[:-3])], names=batch.schema.names[:-3])
    return gather(plain, benchmark, window).mapInArrow(cut, plain.schema).toDF(*docs.columns)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, unchanged."""
    inner = docs.select(whole_row(docs).alias("row"), "text")
    return gather(inner, benchmark, window).where(F.size("__hits") == 0).select("row.*").toDF(*docs.columns)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + {WINDOW} - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
gram AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM pos, sizes WHERE i + n - 1 <= len(w)),
occ AS (SELECT gram.r, gram.i, gram.n, win.item_id FROM gram JOIN win ON gram.g = win.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r),
mark AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM occ),
run AS (SELECT r, min(p) - 1 AS a, max(p) AS b FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM mark) GROUP BY r, k),
spans AS (SELECT r, string_agg(a || ':' || b, ',' ORDER BY a) AS s FROM run GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(s, '') AS removal_spans
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN spans USING (r)
"""
