"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes (it forgets all but the last 21) sets the cuts, so an insertion moves only the cuts near
it. Chunks are told apart by a 128-bit digest. A chunk seen in another place is repeated; where repeated chunks follow each
other over ``min_run`` bytes or more, all but the first occurrence of each, by (doc_id, print, place), are removed. Shorter
runs, a shared phrase or line, stay.

Of the chunks that repeat within a batch one row travels for the digest, the others are settled there, so a digest that a
third of all documents hold is a few rows per batch; digests are then grouped by a sort that streams. Only rows of repeated
chunks go back to the documents.

Null texts are empty. Rows are told apart by doc_id and a hash of the text; rows that agree in both are one document. A
null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.textkit import U64, numbers, text_slices

#: Of a repeated passage a run lacks the chunks that straddle its ends: 96 bytes here are about 150 of the passage.
MIN_RUN, LEAST, MOST = 96, 16, 1024
GEAR = (numbers(256, 31) >> U64(32)).astype(np.uint32)
#: Four bits of the rolling hash, of which the highest sees 21 bytes: a cut every 16 bytes on average, chunks of 30 with LEAST.
CUT = np.uint32(0b1111 << 17)
LEN_BITS = 12
NULL_ID = -(1 << 63)


def gear_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] (32 bits) after each byte of its text, by doubling the window five times.

    What the bytes before a text add to its first 31 hashes is taken off again, so that equal texts have equal hashes.
    """
    h = GEAR[data]
    width = 1
    while width < 32:
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    start, end = offsets[:-1], offsets[1:]
    before = np.where(start > 0, h[np.maximum(start, 1) - 1], 0).astype(np.uint32)
    for k in range(31):
        has = start + k < end
        h[start[has] + k] -= before[has] << np.uint32(k + 1)
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """For each text the ends of its chunks, between ``least`` and ``most`` bytes long (the last may be shorter)."""
    ends = np.flatnonzero((gear_hash(data, offsets) & CUT) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    at = np.searchsorted(ends, offsets, side="right").tolist()
    ends = ends.tolist()
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        cuts, last = [], a
        for e in [*ends[at[i] : at[i + 1]], b]:
            while e - last > most:
                last += most
                cuts.append(last)
            if e - last >= least or (e == b and e > last):
                cuts.append(e)
                last = e
        out.append(cuts)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, print, place, later, twice): ``later`` chunks repeat an earlier one of the batch and need no digest.

    The rows that stand for a digest are its first in the batch; ``twice`` if the batch has more.
    """
    for batch in batches:
        ids, prints, rows, places, digests = batch.column(0).cast(pa.int64()), batch.column(1).to_numpy(), [], [], []
        known = ids.fill_null(NULL_ID).to_numpy()
        for a, _, data, offsets in text_slices(batch.column(2)):
            raw = data.tobytes()
            for i, cuts in enumerate(cut_points(data, offsets, least, most)):
                start = base = int(offsets[i])
                for e in cuts:
                    digests.append(xxhash.xxh3_128_digest(raw[start:e]))
                    places.append((start - base) << LEN_BITS | (e - start))
                    start = e
                rows.append((a + i, len(cuts)))
        if not digests:
            continue
        row = np.repeat([r for r, _ in rows], [n for _, n in rows])
        place = np.array(places, np.int64)
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        order = np.lexsort((place, prints[row], known[row], h[:, 1], h[:, 0]))
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        follows = np.append(~new[1:], False)
        row, place = row[order], place[order]
        # equal rows, of one document given twice, are one place
        yield pa.RecordBatch.from_arrays([pa.array(s[:, 0], mask=~new), pa.array(s[:, 1], mask=~new), ids.take(pa.array(row)), pa.array(prints[row]), pa.array(place), pa.array(~new), pa.array(new & follows)], names=["h1", "h2", "doc_id", "print", "place", "later", "twice"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (h1, h2, doc_id, print, place): (doc_id, print, place, later) of the repeated chunks."""
    held: pa.RecordBatch | None = None  # the last row, which the next may repeat
    before = None  # the digest ahead of the held row
    for batch in _with_end(batches):
        rows = batch if held is None else (held if batch is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0])
        if rows is None or not rows.num_rows:
            continue
        h1, h2 = (rows.column(k).fill_null(0).to_numpy() for k in (0, 1))
        none = ~rows.column(0).is_valid().to_numpy(zero_copy_only=False)
        same = np.zeros(rows.num_rows, bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & ~none[1:] & ~none[:-1]
        same[0] = before is not None and not none[0] and before == (h1[0], h2[0])
        later = rows.column(5).to_numpy(zero_copy_only=False) | same
        repeated = later | rows.column(6).to_numpy(zero_copy_only=False) | np.append(same[1:], False)
        n = rows.num_rows - (batch is not None)
        if batch is not None:
            held = rows.slice(n)
            if n:
                before = None if none[n - 1] else (h1[n - 1], h2[n - 1])
        keep = np.flatnonzero(repeated[:n])
        if len(keep):
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([rows.column(2).take(take), rows.column(3).take(take), rows.column(4).take(take), pa.array(later[keep])], names=["doc_id", "print", "place", "later"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _spans(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    """Per document: bytes and chunks in long runs of repeated chunks, and the spans to remove."""
    mask = (1 << LEN_BITS) - 1
    for batch in batches:
        out = []
        for chunks in batch.column(2).to_pylist():
            chunks = sorted({(x["place"] >> LEN_BITS, x["place"] & mask, x["later"]) for x in chunks})
            run: list = []
            n_repeated, n_chunks, spans = 0, 0, []

            def close() -> None:
                nonlocal n_repeated, n_chunks
                size = sum(x[1] for x in run)
                if size >= min_run:
                    n_repeated, n_chunks = n_repeated + size, n_chunks + len(run)
                    for start, length, later in run:
                        if later and spans and spans[-1]["end"] == start:
                            spans[-1]["end"] = start + length
                        elif later:
                            spans.append({"start": start, "end": start + length})

            for x in chunks:
                if run and run[-1][0] + run[-1][1] != x[0]:
                    close()
                    run = []
                run.append(x)
            close()
            out.append((n_repeated, n_chunks, spans))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        n_repeated, n_chunks, spans = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_repeated, pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(spans, kind)], names=["doc_id", "print", "n_repeated", "n_repeated_chunks", "spans"])


def chunk_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, print, n_repeated, n_repeated_chunks, spans) for the documents that have a repeated chunk."""
    if most >= 1 << LEN_BITS:
        raise ValueError(f"most must be under {1 << LEN_BITS}")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    chunks = read.mapInArrow(partial(_chunks, least=least, most=most), "h1 long, h2 long, doc_id long, print long, place long, later boolean, twice boolean")
    dealt = F.coalesce("h1", F.xxhash64("doc_id", "print", "place"))
    order = ["h1", "h2", "doc_id", "print", "place"]
    repeated = chunks.repartition(dealt).sortWithinPartitions(*order).mapInArrow(_repeated, "doc_id long, print long, place long, later boolean")
    by = repeated.groupBy("doc_id", "print").agg(F.collect_list(F.struct("place", "later")).alias("chunks"))
    return by.mapInArrow(partial(_spans, min_run=min_run), "doc_id long, print long, n_repeated long, n_repeated_chunks long, spans array<struct<start:int,end:int>>")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its spans; bytes of a character that a cut splits go with the removed side."""
    for batch in batches:
        sizes, lost, digests, texts = [], [], [], []
        for text, cut in zip(batch.column(3), batch.column(4)):
            raw = (text.as_py() or "").encode()
            parts, at = [], 0
            for x in cut.as_py() or []:
                parts.append(raw[at : x["start"]])
                at = x["end"]
            rest = b"".join([*parts, raw[at:]])
            sizes.append(len(raw))
            lost.append(len(raw) - len(rest))
            digests.append(hashlib.sha256(rest).hexdigest())
            texts.append(rest.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_repeated", "n_repeated_chunks", "n_bytes", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_repeated, n_repeated_chunks, n_removed, kept_sha256, kept) for each row of ``docs``.

    n_repeated counts bytes in long repeated runs, first occurrences too; kept is the text without the removed bytes.
    """
    found = chunk_spans(docs, id_col, text_col, **options)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    both = read.join(found, read["doc_id"].eqNullSafe(found["doc_id"]) & (read["print"] == found["print"]), "left")
    both = both.select(read["doc_id"], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeated", "n_repeated_chunks")], "text", "spans")
    return both.mapInArrow(_removed, "doc_id long, n_repeated long, n_repeated_chunks long, n_bytes long, n_removed long, kept_sha256 string, kept string")
