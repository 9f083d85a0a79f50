"""What a task holds at once: Python and numpy memory over one Arrow batch, as tracemalloc counts it."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tracelake.llm import line_dedup, suffix_dedup

MB = 1 << 20


def _peak(batches) -> tuple[int, int]:
    """(rows, most bytes held) while each batch is dropped for the next."""
    tracemalloc.start()
    try:
        return sum(x.num_rows for x in batches), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_anchors_hold_a_slice() -> None:
    raw = np.random.default_rng(3).integers(97, 123, 8 * MB, dtype=np.uint8).tobytes().decode()
    texts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "print", "text"])
    rows, most = _peak(suffix_dedup._anchors(iter([batch]), suffix_dedup.LENGTH, suffix_dedup.KMER))
    assert rows > len(texts)
    assert most < 96 * MB


def test_applied_holds_a_slice() -> None:
    n, line = 16_000, "x" * 500
    keep = zlib.compress(np.packbits(np.array([1, 0, 1, 1, 1, 1, 1, 1], np.uint8)).tobytes(), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"{k}\n{line}\n{line}" for k in range(n)]), pa.array([keep if k % 2 else None for k in range(n)], pa.binary())], names=["doc_id", "_text", "_keep_bitmap"])
    rows, most = _peak(line_dedup._applied(iter([batch]), "_text"))
    assert rows == n
    assert most < 4 * MB
    out = pa.Table.from_batches(line_dedup._applied(iter([batch, batch.slice(0, 0)]), "_text"))
    assert out.column("doc_id").to_pylist() == list(range(n))
    assert out.column("_n_dropped").to_pylist() == [k % 2 for k in range(n)]
    assert out.column("_text").to_pylist() == [f"{k}\n{line}" if k % 2 else f"{k}\n{line}\n{line}" for k in range(n)]
