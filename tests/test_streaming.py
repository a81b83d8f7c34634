"""A fitted group model scores a stream the same way as a batch."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from kinfold.sources.manifest import manifest
from kinfold.streaming import score_stream as SS


def test_stream_equals_batch(spark):
    m = manifest(spark, SF_SMALL)
    reg = SS.fit_registry(m.where(F.col("Survived").isNotNull()))
    new = m.where(F.col("Survived").isNull())
    src = tempfile.mkdtemp(prefix="kinfold-stream-src-")
    new.write.mode("overwrite").parquet(src)
    out = SS.run_to_memory(spark, src, new.schema, reg, "kinfold_stream_test",
                           tempfile.mkdtemp(prefix="kinfold-stream-ckpt-"))
    batch = SS.score_rows(new, reg)
    cols = ["PassengerId", "prediction", "decided_by"]
    assert out.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert out.count() == batch.count() == new.count()
