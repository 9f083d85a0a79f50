"""Suffix-array dedup: every byte covered by a repeated string of ``LENGTH`` bytes is removed.

Suffixes are ordered only through the first ``LENGTH`` bytes, by passes from the most significant digit on, and suffixes
alone in their group leave after each pass; the groups left after the last pass are exactly the repeated windows. Digits are
64-bit hashes of stretches of bytes. Not every suffix takes part: of the windows in a stretch of text, only the anchors do,
the positions whose ``KMER`` bytes have the smallest hash in some window. Equal windows have equal anchors at equal offsets,
so no repeat is lost, and there is about one anchor for half a window.

1. Digit ``KMER``: anchors are grouped by their k-mer. Lone anchors leave.
2. Digit context: an anchor stands for the windows that chose it, which together span a context. Equal contexts repeat in
   full. Copies in one batch are settled there, and one of them stands for the rest in the shuffle.
3. The other contexts, with one row for each group of equal ones, are cut into cores, ``STEP - 1`` bytes shorter than a
   window, on a grid around the anchor. Lone cores leave.
4. In each group of equal cores, the ``STEP`` windows around it are compared by the bytes left and right of the core.

Texts are joined to the few rows of steps 3 and 4 and to the final spans by document; nothing unbounded is collected. In
step 4 a group of up to ``HELD`` rows is compared within a task, at about 450 bytes a row; the rows of a larger one go on as
hashes of their windows, which are counted by an aggregation.

Null texts are empty. Rows are told apart by doc_id and a hash of the text, so ids may repeat or be null: two rows with the
same id and text are two texts, and repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.textkit import U64, Prefix, mix64, text_slices

LENGTH, KMER, STEP = 400, 32, 25
HELD = 20_000


def _window_choice(order: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the leftmost smallest of the ``width`` values from there on."""
    best = (order & U64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=U64)
    n, have = len(order) - width + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[:n], best[width - have : width - have + n])
    return (best[:n] & U64(0xFFFFFFFF)).astype(np.int64)


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int):
    """(text, anchor, first window, last window, k-mer hash, context hash), positions in the array."""
    prefix = Prefix(data)
    if len(data) < length:
        return None
    at = np.arange(len(data) - kmer + 1)
    raw = (prefix.sums[kmer:] - prefix.sums[: len(at)]) * prefix.down[: len(at)]
    raw ^= raw >> U64(29)
    raw *= U64(0xBF58476D1CE4E5B9)
    choice = _window_choice(raw, length - kmer + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(choice)]
    starts = np.flatnonzero(np.arange(len(choice)) + length <= offsets[text + 1])
    if not len(starts):
        return None
    chosen, text = choice[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor, low, high = chosen[first], starts[first], starts[last]
    context = mix64(prefix.hashes(low, high + length) + (anchor - low).astype(U64))
    return text[first], anchor, low, high, prefix.hashes(anchor, anchor + kmer), context


ANCHOR = "doc_id long, print long, anchor int, low int, high int, kmer long, context long, settled boolean, shown boolean"


def _anchors(batches: Iterator[pa.RecordBatch], length: int, kmer: int) -> Iterator[pa.RecordBatch]:
    """``settled``: the context repeats in this batch; of equal contexts in it, one is ``shown`` to other batches."""
    for batch in batches:
        ids, prints, parts = batch.column(0).cast(pa.int64()), batch.column(1).to_numpy(), []
        for a, _, data, offsets in text_slices(batch.column(2)):
            if (found := _anchors_of(data, offsets, length, kmer)) is not None:
                text, *places, kh, ch = found
                base = offsets[text]
                parts.append((text + a, *[x - base for x in places], kh, ch))
        if not parts:
            continue
        row, anchor, low, high, kh, ch = (np.concatenate(x) for x in zip(*parts))
        _, first, back, count = np.unique(ch, return_index=True, return_inverse=True, return_counts=True)
        shown = np.zeros(len(row), bool)
        shown[first] = True
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(prints[row]), *[pa.array(x.astype(np.int32)) for x in (anchor, low, high)], pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(count[back] > 1), pa.array(shown)], names=["doc_id", "print", "anchor", "low", "high", "kmer", "context", "settled", "shown"])


def _cores(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """(core, left, right, at) for each place of the grid; left and right are the bytes that the windows there may add."""
    for batch in batches:
        ids, prints, places = batch.column(0), batch.column(1), batch.column(3)
        for a, b, data, offsets in text_slices(batch.column(2)):
            prefix, raw = Prefix(data), data.tobytes()
            lists = places.slice(a, b - a)
            flat = lists.flatten()
            row = np.repeat(np.arange(b - a), np.array([len(x) for x in lists], dtype=np.int64))
            anchor, low, high = (flat.field(k).to_numpy().astype(np.int64) + offsets[row] for k in range(3))
            near, far = anchor - high, anchor - low  # offsets of the anchor in its last and first window
            g0, g1 = near // step, far // step
            n = g1 - g0 + 1
            pick = np.repeat(np.arange(len(row)), n)
            grid = (np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n) + g0[pick]) * step
            at = anchor[pick] - grid
            end = at + length - step + 1
            left = np.maximum(at - (step - 1), low[pick])
            right = np.minimum(end + step - 1, high[pick] + length)
            ok = (at >= offsets[row[pick]]) & (end <= offsets[row[pick] + 1]) & (left <= at) & (end <= right)
            pick, at, end, left, right = (x[ok] for x in (pick, at, end, left, right))
            core = prefix.hashes(at, end)
            who = pa.array(row[pick] + a)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array([raw[i:j] for i, j in zip(left.tolist(), at.tolist())], pa.binary()), pa.array([raw[i:j] for i, j in zip(end.tolist(), right.tolist())], pa.binary()), ids.take(who), prints.take(who), pa.array((at - offsets[row[pick]]).astype(np.int32))], names=["core", "left", "right", "doc_id", "print", "at"])


def _margin(column: pa.Array, step: int, from_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0, 1, ... bytes counted from the core, a row for each text; and how many bytes there are."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.diff(offsets)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(column), step), U64)
    for k in range(1, step):
        has = held >= k
        where = (offsets[1:] - k if from_right else offsets[:-1] + k - 1)[has]
        out[has, k] = mix64(out[has, k - 1] + data[where].astype(U64) + U64(k << 8))
    return out, held


def _window_keys(core: np.ndarray, left: pa.Array, right: pa.Array, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each row, the i-th taking i bytes on the left, and which of them there are."""
    lh, ln = _margin(left, step, True)
    rh, rn = _margin(right, step, False)
    keys = mix64(core[:, None] + lh * U64(0x9E3779B97F4A7C15) + rh[:, ::-1] * U64(0xD6E8FEB86659FD93) + np.arange(step, dtype=U64))
    at = np.arange(step)
    return keys, (ln[:, None] >= at) & (rn[:, None] >= step - 1 - at)


def _same_windows(core: np.ndarray, left: pa.Array, right: pa.Array, step: int) -> np.ndarray:
    """Bit i of a row: the window that takes i bytes on the left occurs in another row."""
    keys, has = _window_keys(core, left, right, step)
    mask = np.zeros(len(core), np.int64)
    for i in range(step):
        rows = np.flatnonzero(has[:, i])
        if len(rows) < 2:
            continue
        _, back, count = np.unique(keys[rows, i], return_inverse=True, return_counts=True)
        mask[rows[count[back] > 1]] |= 1 << i
    return mask


REPEAT = "doc_id long, print long, at int, mask long, windows array<long>"


def _repeats(batches: Iterator[pa.RecordBatch], step: int, most: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of core: the rows with a repeated window by ``mask``; of groups over ``most``, all by ``windows``."""

    def row(one: pa.RecordBatch, mask: np.ndarray, windows: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([one.column(3), one.column(4), one.column(5), pa.array(mask), windows], names=["doc_id", "print", "at", "mask", "windows"])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        core = table.combine_chunks().column(0).to_numpy()
        same = np.zeros(len(core), bool)
        same[1:] = core[1:] == core[:-1]
        same[:-1] |= core[1:] == core[:-1]
        for one in table.filter(pa.array(same)).combine_chunks().to_batches():
            if not one.num_rows:
                continue
            mask = _same_windows(one.column(0).to_numpy().view(U64), one.column(1), one.column(2), step)
            yield row(one, mask, pa.nulls(len(mask), pa.list_(pa.int64()))).filter(pa.array(mask != 0))

    def loose(one: pa.RecordBatch) -> pa.RecordBatch:
        keys, has = _window_keys(one.column(0).to_numpy().view(U64), one.column(1), one.column(2), step)
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * step)
        return row(one, np.zeros(len(keys), np.int64), pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64), mask=~has.ravel())))

    held: list[pa.RecordBatch] = []  # the rows of the last group, which may go on
    n, large = 0, None  # how many they are, or the group that is too large to hold
    for batch in batches:
        if not batch.num_rows:
            continue
        core = batch.column(0).to_numpy()
        if large is not None:
            k = int(np.searchsorted(core, large, side="right")) if core[0] == large else 0
            if k:
                yield loose(batch.slice(0, k))
                batch, core = batch.slice(k), core[k:]
                if not len(core):
                    continue
            large = None
        cut = int(np.searchsorted(core, core[-1]))
        if held and (cut or core[0] != held[-1].column(0)[-1].as_py()):
            yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, n = [], 0
        elif cut:
            yield from settle(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        n += len(core) - cut
        if n > most:
            for x in held:
                yield loose(x)
            held, n, large = [], 0, core[-1]
    if held:
        yield from settle(pa.Table.from_batches(held))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _spans(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, spans): per document the maximal runs that repeated windows cover."""
    for batch in batches:
        found = []
        for whole, masks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            runs = [(x["low"], x["high"] + length) for x in whole]
            for x in masks:
                runs += [(x["at"] - i, x["at"] - i + length) for i in range(step) if x["mask"] >> i & 1]
            found.append([{"start": a, "end": b} for a, b in _joined(runs)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "print", "spans"])


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["print"] == b["print"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, step: int = STEP, held: int = HELD) -> DataFrame:
    """(doc_id, print, spans): the byte runs, of documents that have any, that repeated strings cover."""
    read = _printed(docs, id_col, text_col)
    anchors = stored(read.filter(F.octet_length("text") >= length).mapInArrow(partial(_anchors, length=length, kmer=kmer), ANCHOR), "anchors")

    group = W.partitionBy("kmer").orderBy("context")
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = anchors.filter("shown").withColumns({
        "before": F.lag("context").over(group), "after": F.lead("context").over(group),
        "least": F.first("context").over(whole), "most": F.last("context").over(whole),
    })
    met = met.withColumns({"twice": F.coalesce(F.col("context") == F.col("before"), F.lit(False)) | F.coalesce(F.col("context") == F.col("after"), F.lit(False)), "open": (F.col("least") != F.col("most")) & ~F.col("context").eqNullSafe(F.col("before"))})
    met = stored(met.filter("twice or open").select("doc_id", "print", "anchor", "low", "high", "twice", "open"), "anchors-met")

    place = F.collect_list(F.struct("anchor", "low", "high")).alias("places")
    wanted = met.filter("open").groupBy("doc_id", "print").agg(place)
    cores = read.join(wanted, _same(read, wanted)).select(read["doc_id"], read["print"], "text", "places")
    cores = cores.mapInArrow(partial(_cores, length=length, step=step), "core long, left binary, right binary, doc_id long, print long, at int")
    repeats = stored(cores.repartition("core").sortWithinPartitions("core").mapInArrow(partial(_repeats, step=step, most=held), REPEAT), "repeats")
    windows = repeats.filter("windows is not null").select("doc_id", "print", "at", F.posexplode("windows").alias("i", "window")).filter("window is not null")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    loose = windows.join(twice, "window").groupBy("doc_id", "print", "at").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    repeats = repeats.filter("windows is null").select("doc_id", "print", "at", "mask").union(loose)

    full = anchors.filter("settled").select("doc_id", "print", "low", "high").union(met.filter("twice").select("doc_id", "print", "low", "high"))
    none = lambda kind: F.lit(None).cast(kind)
    found = full.select("doc_id", "print", F.struct("low", "high").alias("whole"), none("struct<at:int,mask:bigint>").alias("part"))
    found = found.union(repeats.select("doc_id", "print", none("struct<low:int,high:int>"), F.struct("at", "mask")))
    by = found.groupBy("doc_id", "print").agg(F.collect_list("whole").alias("whole"), F.collect_list("part").alias("part"))
    return by.mapInArrow(partial(_spans, length=length, step=step), "doc_id long, print long, spans array<struct<start:int,end:int>>")


def _without(raw: bytes, spans: list[dict]) -> bytes:
    parts, at = [], 0
    for x in spans:
        parts.append(raw[at : x["start"]])
        at = x["end"]
    return b"".join([*parts, raw[at:]])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw, spans = (text.as_py() or "").encode(), spans.as_py() or []
            rest = _without(raw, spans)
            rows.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 3, pa.string()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``; spans are null where nothing repeats."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return read.join(spans, _same(read, spans), "left").select(read["doc_id"], "text", "spans")


def suffix_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row; the digest is of the bytes that stay."""
    found = with_spans(docs, repeated_spans(docs, id_col, text_col, length, **options), id_col, text_col)
    return found.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
