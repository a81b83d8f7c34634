"""Token ids in fixed-width bit-packed blocks.

Documents are dealt by ranges of ``doc_id`` and sorted, tokenized once, and
written as a table of blocks: a block holds the ids of whole documents, each
id in the fewest bits that the vocabulary needs, packed without gaps. A block
row knows its shard, its number, the ids before it in the shard (its offset)
and the documents in it with their lengths, so a reader finds any id by
arithmetic and unpacks a block with numpy. Blocks are rows of Parquet files:
they live in any store that Spark reads, a lost task is written again through
Spark's commit protocol, and a filter on the offsets prunes row groups.

Defined results: a null text is the empty text (only its end id); null
``doc_id`` sorts first; rows of one ``doc_id`` are in the order of the first
64 characters of their texts (nulls first), then of their hashes, and each is a
document; an empty table gives no block.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, kept, scratch_path, text_bytes

#: Ids after which a block is closed (at the end of a document).
BLOCK_IDS = 1 << 16
#: Bytes that a worker spends on remembered words and on remembered chunks, in the new and in the old half each.
CACHE_BYTES = 80 << 20
#: What a remembered word takes besides its letters and ids.
_ENTRY = 150
#: Longer words are not remembered.
LONG_WORD = 256
#: Bytes of the texts that are looked up together.
TOGETHER = 1 << 18
#: Characters by which rows of one doc_id are ordered before their digest.
TIE_CHARS = 64
_ORDER = ("doc_id", "__start", "__hash", "__row")

BLOCK_SCHEMA = ("shard int, block int, offset long, n_ids long, bits int, ids binary, "
                "doc_ids array<long>, doc_lengths array<long>")


def width_for(vocabulary: int) -> int:
    """Bits of an id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    part = lambda x: np.packbits(((x[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little")
    return b"".join(part(ids[i:i + 4096]).tobytes() for i in range(0, len(ids), 4096))  # 4096 ids end on a byte


def unpack(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a packed block; reads only their bytes."""
    first = start * bits
    raw = np.frombuffer(data, np.uint8, (first + n * bits + 7) // 8 - first // 8, first // 8)
    if bits == 16 and first % 8 == 0:
        return raw.view("<u2").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little")[first % 8:first % 8 + n * bits].reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Remembered:
    """word -> its ids (little-endian 32-bit) in two halves: when the new one is
    full it becomes the old one, and what is still in use comes back from there."""

    def __init__(self, bound: int):
        self.new: dict = {}
        self.old: dict = {}
        self.spent, self.bound = 0, bound

    def missing(self, words: set) -> set:
        """Those that neither half holds; the others are in the new half now."""
        want = words.difference(self.new)
        back = {w: self.old[w] for w in want if w in self.old}
        self.learn(back)
        return want.difference(back)

    def learn(self, got: dict) -> None:
        self.new |= got
        self.spent += len(got) * _ENTRY + sum(map(len, got)) + sum(map(len, got.values()))

    def settle(self, learned: set) -> None:
        """Forget the long ones of ``learned``, and the old half when the new one is full."""
        for w in learned:
            if len(w) > LONG_WORD:
                self.spent -= _ENTRY + len(w) + len(self.new.pop(w))
        if self.spent >= self.bound:
            self.old, self.new, self.spent = self.new, {}, 0


class TextIds:
    """Ids of texts by the ids of their words.

    A word ends at ASCII white space, where every piece of the pre-tokenizer
    ends; a new word is cut into chunks, before an ASCII sign or digit that
    follows a Latin or Cyrillic letter. The pre-tokenizer always ends a piece
    there, no normalization reaches across, and no cut is made before a character
    that a special token holds past its first, so the ids of the chunks in a row
    are the ids of the text. (U+0130 is no such letter: it is lower-cased to a
    letter and a mark, and the mark goes with what follows.)

    Where the tokenizer lower-cases all text, A-Z are lower-cased first, unless
    that would make a special token. New chunks are encoded together: those of
    letters alone by lines, as each is one piece and only its last id ends a
    word; the others with a special token between them, which the library takes
    out of a text before all else.
    """

    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af\u0400-\u0481\u048a-\u052f"

    def __init__(self, path: str, cache_bytes: int | None = None):
        bound = CACHE_BYTES if cache_bytes is None else cache_bytes
        self.words, self.parts = Remembered(bound), Remembered(bound)
        # A task has one core: no threads of the library beside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        held = {c for t in added.values() for c in t.content[1:]}
        cuts = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) not in held)
        t, other = f"[{self.LETTERS}]+", f"[^{self.LETTERS}\t-\r ]"
        more = f"(?:{t}(?:(?![{cuts}]){other}+)?)"  # letters, and what follows them uncut
        self.chunks = re.compile(f"{more}+|{other}+{more}*").findall
        self.letters = re.compile(t).fullmatch
        # A token that starts like no other token's middle, and takes nothing beside it.
        self.between = next(((i, t.content) for i, t in added.items() if t.content[0] not in held
                             and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)").search
        spec = json.loads(self.tokenizer.to_str())
        steps = spec["normalizer"] or {}
        self.folds = any(n["type"] == "Lowercase" for n in steps.get("normalizers", [steps]) if n)
        self.marks = [t.content.lower().encode() for t in added.values()]
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str, cache_bytes: int | None = None) -> TextIds:
        """One for each worker and tokenizer file; kept between tasks of this operator."""
        return kept(("tokens", path, cache_bytes), lambda: cls(path, cache_bytes))

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        got: dict[str, bytes] = {}

        def split(texts: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
            raw = ids.tobytes()
            got.update((c, raw[4 * a:4 * b]) for c, a, b in zip(texts, starts, ends, strict=True))
        plain = [c for c in chunks if self.letters(c)]
        for i in range(0, len(plain), 64):
            some = plain[i:i + 64]
            ids = self._encoded("\n".join(some))
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):
                split(some, ids, [0, *ends[:-1]], ends)
        rest = [c for c in chunks if c not in got]
        if self.between:
            mark, token = self.between
            joined = [c for c in rest if not self.special(c)]
            for i in range(0, len(joined), 64):
                some = joined[i:i + 64]
                ids = self._encoded(token.join(some))
                ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
                split(some, ids, [0, *(e + 1 for e in ends[:-1])], ends)
        return got | {c: self._encoded(c).tobytes() for c in rest if c not in got}

    def _word_ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        cut = {w: self.chunks(w.decode()) for w in words}
        new = self.parts.missing(set().union(*cut.values()))
        self.parts.learn(self._chunk_ids(new))
        ids = self.parts.new.__getitem__
        out = {w: b"".join(map(ids, c)) for w, c in cut.items()}
        self.parts.settle(new)
        return out

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text in UTF-8; none for null."""
        cut = []
        for t in texts:
            low = (t or b"").lower() if self.folds else t or b""
            cut.append((t if any(m in low for m in self.marks) else low).split())
        # The distinct words of these texts are a small table that stays near the core.
        near = list(set().union(*cut))
        held = dict(zip(near, map(self.words.new.get, near), strict=True))
        new = self.words.missing({w for w, ids in held.items() if ids is None})
        self.words.learn(self._word_ids(new))
        held.update((w, self.words.new[w]) for w, ids in held.items() if ids is None)
        ids = held.__getitem__
        out = [b"".join(map(ids, c)) for c in cut]
        self.words.settle(new)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0]


def _together(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``TOGETHER`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or b"")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def write_blocks(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS,
                 cache_bytes: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the
    blocks in ascending ``doc_id`` order to ``path``. ``cache_bytes`` bounds what
    a worker remembers (None: ``CACHE_BYTES``); the ids do not depend on it."""
    arrow_limits(docs.sparkSession)
    bits = width_for(max(vocabulary_size(tokenizer), end_id + 1))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The keys after doc_id let the ranges split an id that many rows share.
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .withColumns({"__start": F.substring("text", 1, TIE_CHARS), "__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
             .repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).select("doc_id", "text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, made, offset, held, docs_in, lengths = TaskContext.get().partitionId(), 0, 0, [], [], []
        ids, end = TextIds.of(tokenizer, cache_bytes), np.array([end_id], "<u4").tobytes()

        def close():
            got = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([made], pa.int32()),
                "offset": pa.array([offset], pa.int64()), "n_ids": pa.array([len(got)], pa.int64()),
                "bits": pa.array([bits], pa.int32()), "ids": pa.array([pack(got, bits)], pa.binary()),
                "doc_ids": pa.array([docs_in], pa.list_(pa.int64())),
                "doc_lengths": pa.array([lengths], pa.list_(pa.int64()))}), len(got)

        size = 0
        for batch in batches:
            encoded = (got for some in _together(text_bytes(batch)) for got in ids.encode_all(some))
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                got += end
                held.append(got)
                docs_in.append(doc_id)
                lengths.append(len(got) // 4)
                size += len(got) // 4
                if size >= block_ids:
                    out, k = close()
                    yield out
                    made, offset, held, docs_in, lengths, size = made + 1, offset + k, [], [], [], 0
        if docs_in:
            yield close()[0]

    dealt.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def with_start(blocks: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all shards before and of the blocks before in
    the shard. The window is over one row for each shard, as many as the
    write had tasks, and so is what is broadcast."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return (blocks.join(F.broadcast(at), "shard")
            .withColumn("start", F.col("shard_start") + F.col("offset")).drop("shard_start"))


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """Random access: ids ``start`` to ``start + n`` of the whole corpus as
    (position, id); only blocks that overlap are read past their offsets."""
    hit = with_start(read_blocks(spark, path)).where(
        (F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).select("start", "n_ids", "bits", "ids")

    def take(batches):
        for batch in batches:
            for at, k, bits, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                lo, hi = max(start, at), min(start + n, at + k)
                yield pa.RecordBatch.from_pydict({"position": pa.array(range(lo, hi), pa.int64()),
                                                  "id": pa.array(unpack(data, bits, lo - at, hi - lo).astype(np.int64))})
    return hit.mapInArrow(take, "position long, id long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the blocks at ``path``: doc_id, start, n_tokens and
    ids_crc32, the checksum of its ids as little-endian 32-bit integers."""
    arrow_limits(spark)

    def per_doc(batches):
        for batch in batches:
            for at, bits, data, doc_ids, lengths in zip(*(batch.column(c).to_pylist() for c in ("start", "bits", "ids", "doc_ids", "doc_lengths")), strict=True):
                n = np.array(lengths, np.int64)
                ids = unpack(data, bits, 0, int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(at + ends - n),
                    "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})
    return with_start(read_blocks(spark, path)).select("start", "bits", "ids", "doc_ids", "doc_lengths") \
        .mapInArrow(per_doc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, cache_bytes: int | None = None) -> DataFrame:
    """Write ``docs`` as blocks in the shared folder and return the digests
    read back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_blocks(docs, tokenizer, path, end_id, cache_bytes=cache_bytes)
    return digests(spark, path)
