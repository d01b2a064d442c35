"""What a worker holds at once doesn't grow with the rows of its task."""

import gc
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lattica.llm import op4_packing, op7_neardup


def peak(run, batches):
    """Bytes that Python, numpy and Arrow hold at once, at most, while the results are read."""
    gc.collect()
    before, arrow = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for _ in run(batches):
        arrow = max(arrow, pa.total_allocated_bytes() - before)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return held + arrow


def test_a_range_of_labels_is_read_in_chunks(monkeypatch):
    monkeypatch.setattr(op7_neardup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(op7_neardup, "CHUNK", 2000)

    def labels(chunks):
        for i in range(chunks):
            rng = np.random.default_rng(i)
            flat = rng.integers(0, 256, (2000, op7_neardup._WIDTH), dtype=np.uint8)
            flat[:, 0], flat[:, 1] = 0, i
            own = sorted(x.tobytes() for x in flat)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(range(2000 * i, 2000 * (i + 1)), pa.int64()), pa.array([x[:32] for x in own])], names=["label", "node", "sketch"])

    few, many = (peak(op7_neardup._neighbours(47.0), labels(n)) for n in (4, 40))
    assert many < 1.5 * few


def test_packing_holds_a_shard_at_a_time():
    def shards(n):
        for i in range(n):
            own = range(500 * i, 500 * (i + 1))
            columns = {"shard": [i] * 500, "doc_id": list(own), "n_tokens": [k * 37 % 1500 for k in own], "source": [f"s{k % 90}" for k in own], "cluster": [f"c{k}" for k in own]}
            yield pa.RecordBatch.from_pydict(columns)

    few, many = (peak(op4_packing._place(2048), shards(n)) for n in (4, 40))
    assert many < 1.5 * few
