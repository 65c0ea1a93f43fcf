"""What a Python worker holds doesn't grow with the rows it is given."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stylomill.llm import media
from stylomill.operators import linear, ngrams


def peak_of(found) -> int:
    """The most bytes that Python and numpy hold while an iterator is read."""
    tracemalloc.start()
    try:
        for _ in found:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_mining_holds_no_more_for_longer_batches():
    """Four times the tokens in a batch don't take more memory (F12)."""

    class Sent:
        value = []

    def batch(n):
        return pa.RecordBatch.from_arrays([pa.array([[f"w{(i * j) % 997}" for j in range(512)] for i in range(n)])], ["tokens"])

    small, large = (peak_of(ngrams._counted(range(1, 2), Sent, ngrams.SLICE_TOKENS)(iter([b]))) for b in (batch(512), batch(2048)))
    assert large < 1.5 * small


def test_a_solvers_blocks_are_small_and_kept_packed(spark):
    """A step holds one block of 2 ** 18 entries at most, and sums over them are whole (F12)."""
    vector = array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(256)), lambda x: (F.col("id") + x).cast("double")))
    blocks = linear.Blocks(spark.range(4096).select("id", (F.col("id") % 2).alias("label"), vector.alias("features")).coalesce(1))
    sizes = [int(x) for x in blocks.sum(lambda b: np.array([[len(b.value), len(b.value) > 1 << 18]], np.float64)).ravel()]
    moments = blocks.sum(lambda b: b.moments(256)[0])
    blocks.free()
    assert sizes == [4096 * 256, 0]
    assert np.allclose(moments, [sum(range(4096)) + 4096 * x for x in range(1, 257)])


def test_payloads_are_read_and_described_by_one_worker(spark, tmp_path):
    """Reading back and features are one pass over Python, so a task has one worker and payloads don't travel (F19)."""
    rows = [(i, f"text {i % 5} of some words " * (40 * i)) for i in range(12)] + [(12, None), (13, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = media.op8_media_chunks(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r["payload_sha256"] for r in df.collect()}
    assert plan.count("MapInArrow") == 1
    assert got == {i: hashlib.sha256(media.pad((t or "").encode())).hexdigest() for i, t in rows}
