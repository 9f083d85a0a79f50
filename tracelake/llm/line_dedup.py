"""Line dedup: lines that many documents share are found by range-partitioned hashes and dropped by keep bitmaps.

Each line's key (stripped, A-Z lower-cased) is hashed to 128 bits. A task first keeps, for each key in its batch, the first
line of up to ``min_docs`` documents; these rows are range-partitioned by hash and sorted by document and position, so a
stream over them sees each key's first occurrence and counts its documents. A key that a third of all documents carry thus
reaches its range as a few rows per batch. The keys over the threshold are joined back to the thin (document, line, hash)
rows, and each document's lost lines come back as a compressed bitmap; only the last step reads the texts again.

Null and empty texts are one empty line. Rows are told apart by doc_id and a hash of the text, so ids may repeat or be
null; rows of null id are one document for each text. Keys shorter than ``min_chars`` code points are never dropped. ``keep`` says what
stays of a repeated key: ``none`` of its lines, or the ``first`` by doc_id and position. Extra columns pass through unchanged,
whatever their names; ``_n_lines`` and ``_n_dropped`` take the place of columns of these names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE_CHARS, free_name, stored
from tracelake.llm.textkit import text_slices

MIN_DOCS, MIN_CHARS = 10, 1
#: Bytes of text over which a task thins out a key's lines, and rows of which it holds the kept texts at once.
LINES_BYTES, HELD_ROWS = 2 << 20, 500
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STRIP = SPACE_CHARS.encode()


def _chars(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def _lines(batches: Iterator[pa.RecordBatch], min_docs: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, line, h1, h2, shown): ``shown`` rows stand for their key in the count."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        prints, lost = batch.column(1).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        #: a document is its id or, where that is null, its text
        known = np.where(lost, prints, ids.fill_null(0).to_numpy())
        for a, b, data, offsets in text_slices(batch.column(2), LINES_BYTES):
            raw = data.tobytes()
            row, line, digests = [], [], []
            for i in range(b - a):
                for j, x in enumerate(raw[offsets[i] : offsets[i + 1]].split(b"\n")):
                    key = x.strip(_STRIP).translate(_TO_LOWER)
                    if len(key) >= min_chars and (min_chars <= 1 or _chars(key) >= min_chars):
                        row.append(a + i)
                        line.append(j)
                        digests.append(xxhash.xxh3_128_digest(key))
            if not row:
                continue
            row, line = np.array(row), np.array(line, np.int32)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            order = np.lexsort((line, known[row], lost[row], h[:, 1], h[:, 0]))
            s, d, f = h[order], known[row][order], lost[row][order]
            key_new = np.ones(len(s), bool)
            key_new[1:] = (s[1:] != s[:-1]).any(axis=1)
            doc_new = key_new.copy()
            doc_new[1:] |= (d[1:] != d[:-1]) | (f[1:] != f[:-1])
            rank = np.cumsum(doc_new)
            rank -= np.maximum.accumulate(np.where(key_new, rank, 0))
            shown = np.zeros(len(s), bool)
            shown[order] = doc_new & (rank < min_docs)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(prints[row]), pa.array(line), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(shown)], names=["doc_id", "print", "line", "h1", "h2", "shown"])


def _repeated(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of (h1, h2, doc_id, print, line): keys of ``min_docs`` documents or more with their first line."""
    first, n, last = None, 0, None
    own = lambda x: (x[2], x[3] if x[2] is None else 0)

    def done(out: list) -> None:
        if first is not None and n >= min_docs:
            out.append(first)

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h1", "h2", "first_id", "first_print", "first_line"])

    for batch in batches:
        out: list = []
        for x in zip(*[batch.column(k).to_pylist() for k in ("h1", "h2", "doc_id", "print", "line")]):
            if first is None or x[:2] != first[:2]:
                done(out)
                first, n, last = x, 1, own(x)
            elif own(x) != last:
                n, last = n + 1, own(x)
        if out:
            yield batch_of(out)
    out = []
    done(out)
    if out:
        yield batch_of(out)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each line, 0 for the dropped, in whole bytes up to the last dropped one, compressed."""
    for batch in batches:
        maps = []
        for lost in batch.column(2).to_pylist():
            bits = np.ones((max(lost) // 8 + 1) * 8, np.uint8)
            bits[lost] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "print", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """(doc_id, print, keep_bitmap) for the documents that lose a line; ``print`` is xxhash64 of the text."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    lines = read.mapInArrow(partial(_lines, min_docs=min_docs, min_chars=max(1, min_chars)), "doc_id long, print long, line int, h1 long, h2 long, shown boolean")
    lines = stored(lines, "lines")
    order = ["h1", "h2", "doc_id", "print", "line"]
    ranged = lines.filter("shown").select(*order).repartitionByRange("h1", "h2").sortWithinPartitions(*order)
    repeated = ranged.mapInArrow(partial(_repeated, min_docs=min_docs), "h1 long, h2 long, first_id long, first_print long, first_line int")
    #: stored, so that its size is known before the join is planned
    lost = lines.join(stored(repeated, "lines-repeated"), ["h1", "h2"])
    if keep == "first":
        lost = lost.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("print") == F.col("first_print")) & (F.col("line") == F.col("first_line"))))
    return lost.groupBy("doc_id", "print").agg(F.collect_set("line").alias("lost")).mapInArrow(_bitmaps, "doc_id long, print long, keep_bitmap binary")


def _applied(batches: Iterator[pa.RecordBatch], text_name: str) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, HELD_ROWS) for whole in batches for k in range(0, whole.num_rows, HELD_ROWS)):
        rest, texts, n_lines, n_dropped = batch.schema.names[:-2], [], [], []
        for text, bitmap in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            text = text.as_py() or ""
            total, lost = text.count("\n") + 1, 0
            if bitmap.is_valid:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), np.uint8))[:total]
                kept = [x for k, x in enumerate(text.split("\n")) if k >= len(bits) or bits[k]]
                text, lost = "\n".join(kept), total - len(kept)
            texts.append(text)
            n_lines.append(total)
            n_dropped.append(lost)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*rest, text_name, "_n_lines", "_n_dropped"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the kept lines as text and ``_n_lines`` and ``_n_dropped``; a document may be left with an empty text."""
    docs = docs.drop("_n_lines", "_n_dropped")
    own = {c: free_name(docs, f"_{c}") for c in ("doc_id", "print", "keep_bitmap", "text")}
    maps = line_keep_bitmaps(docs, id_col, text_col, **options).withColumnsRenamed({c: own[c] for c in ("doc_id", "print", "keep_bitmap")})
    same = docs[id_col].cast("long").eqNullSafe(maps[own["doc_id"]]) & (F.xxhash64(docs[text_col]) == maps[own["print"]])
    rest = [c for c in docs.columns if c != text_col]
    both = docs.join(maps, same, "left").select(*rest, docs[text_col].alias(own["text"]), own["keep_bitmap"])
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*rest).dtypes)
    out = both.mapInArrow(partial(_applied, text_name=own["text"]), f"{fields}`{own['text']}` string, _n_lines long, _n_dropped long")
    return out.select(*[F.col(own["text"]).alias(c) if c == text_col else F.col(c) for c in docs.columns], "_n_lines", "_n_dropped")
