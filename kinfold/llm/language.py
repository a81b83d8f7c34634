"""Language identification by rank-order profiles of character n-grams.

Training counts the n-grams (1 to 3 characters, inside words with a mark at
both ends) of all training texts per language and keeps each language's most
frequent ones in order: its profile. A document's own most frequent n-grams
are ranked the same way, and the out-of-place distance to a profile is the sum
over them of how far each one's rank lies from its rank there, ``PROFILE`` at
most and for n-grams that the profile lacks. The language of least distance
wins; the score is one minus that distance as a share of the greatest possible.

Letters are those of Unicode category L, lower-cased one by one; all else ends
a word. Ties in frequency go to the n-gram of smaller code, ties in distance
to the smaller language name.

Defined results: a text that is null or has no letter is ``und`` with score
0; with no training text every prediction is ``und``; rows with a null lang
or a null text teach nothing; a null doc_id is not held out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, kept, whole_row

#: n-grams of a profile and of a document that are ranked.
PROFILE = 400
#: n-grams that a training task holds before it passes its counts on.
HELD = 500_000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for all that is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1-, 2- and 3-grams of a text and their counts. A gram is its
    code points in 21 bits each, 0 for the edge of a word, and bit 42 (2-grams)
    or the sign (3-grams) for its length."""
    cp = kept(("language",), _letters)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cp = np.concatenate(([0], cp, [0])).astype(np.int64)
    cp = cp[np.concatenate(([True], (cp[1:] > 0) | (cp[:-1] > 0)))]  # one edge between two words
    if len(cp) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (cp[:-1] << 21) | cp[1:]
    three = (two[:-1] << 21) | cp[2:] | np.int64(-1 << 63)
    return np.unique(np.concatenate((cp[cp > 0], two | (1 << 42), three[cp[1:-1] > 0])), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The most frequent grams in order."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:n]


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from all rows of ``docs`` (text, lang). What reaches the
    driver is the profiles: PROFILE n-grams for each language."""
    arrow_limits(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                held[lang] = [(g, n)]

        def out():
            for lang, [(g, n)] in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g)), "gram": pa.array(g.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                g, n = ngrams(text)
                if len(g):
                    held.setdefault(lang, []).append((g, n))
                    size += len(g)
                if size > HELD:
                    merged()
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = {}, 0
        merged()
        yield from out()

    grams = (docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
             .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {}
    for lang, gram, rank in best.select("lang", "gram", "rank").collect():
        profiles.setdefault(lang, []).append((rank, gram))
    return {lang: np.array([g for _, g in sorted(profiles[lang])], np.int64) for lang in sorted(profiles)}


def classifier(profiles: dict[str, np.ndarray]):
    """text -> (language, score)."""
    langs = list(profiles)
    vocabulary = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
    ranks = np.full((len(vocabulary), len(langs)), PROFILE, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(vocabulary, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        own = top(*ngrams(text)) if text else ()
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(vocabulary, own).clip(max=len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == own)
        there = ranks[at[known]]
        away = np.where(there == PROFILE, PROFILE, np.abs(there - known[:, None]))
        distance = away.sum(axis=0) + PROFILE * (len(own) - len(known))
        j = int(distance.argmin())
        return langs[j], 1.0 - float(distance[j]) / (PROFILE * len(own))
    return predict


def held_out() -> F.Column:
    """crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; the prediction reads
    nothing but the text. Columns of these names in ``docs`` are replaced."""
    arrow_limits(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")

    def label(batches):
        of = classifier(profiles)
        for batch in batches:
            got = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(label, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and predict all of
    ``docs``: doc_id, held_out, lang_pred, score."""
    profiles = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles) \
        .select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that are in some language, or in one of ``languages``
    where they are given: the others go, ``und`` always. A null lang becomes the
    predicted one; all else stays as it is."""
    profiles = train(docs.where(~held_out()))
    inner = docs.select(whole_row(docs).alias("row"), "text")
    kept = F.col("lang_pred") != UNKNOWN
    if languages is not None:
        kept &= F.col("lang_pred").isin(*languages)
    named = F.coalesce("row.lang", F.col("lang_pred")).alias("lang")
    return predict(inner, profiles).where(kept).select(
        *[named if c == "lang" else F.col("row.`" + c.replace("`", "``") + "`") for c in docs.columns]).toDF(*docs.columns)
