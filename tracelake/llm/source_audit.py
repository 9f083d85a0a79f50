"""Source divergence audit: how each source's use of words differs from its language's and from that of each other source.

In-mapper stripes: a task folds whole documents into a hash table term -> (documents, counts by source) for each language and
spills it, in rows of one stripe each, when it holds ``most_entries`` counts. Stripes are dealt by (language, term), sorted, and
merged in a stream; so a word that every document has reaches its task as one row for each spill, and no task holds more
than one merged stripe, which is at most as long as the list of sources. The merged stripes of the kept terms are written once.
The sums over them give N for each source and V for each language; then the stripes are dealt over buckets by a hash of the
term, each bucket led by one row that lists its language's sources with their N, and emit the divergences directly: a term
against its language, and sums over a block of terms for each pair of sources. The pairs are what is asked for; they are
added up in the task, so that a bucket sends one row for each pair, not one for each term.

Rows are documents: two rows of the same id count twice. Null text, language and source are read as ''. A source of no kept
terms is listed with N = 0; a language of none (V = 0) has pairs of value 0 and no terms. An empty table gives no rows. Columns
besides the three named ones are not read. All arithmetic is in whole numbers; it is exact while N + V is under 9.2e15.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: A-Z and everything beyond ASCII; texts are read as UTF-8 bytes with A-Z lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIN_DOCS, MOST_RANK, SCALE = 3, 200, 1_000_000_000
MOST_ENTRIES, BLOCK_CELLS, MOST_PAIRS = 1 << 19, 1 << 20, 1 << 22
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _stripes(batches: Iterator[pa.RecordBatch], most_entries: int) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): stripes, each key once a spill."""
    counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    docs: dict[str, Counter] = defaultdict(Counter)

    def spill() -> Iterator[pa.RecordBatch]:
        for lang, by in counts.items():
            entries = pa.array([t for terms in by.values() for t in terms], pa.binary()).dictionary_encode()
            if not len(entries):
                continue
            #: entries by term, so that each term's counts by source are next to each other
            code = entries.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            source = np.repeat(np.arange(len(by)), [len(terms) for terms in by.values()])[order]
            n = np.fromiter((c for terms in by.values() for c in terms.values()), np.int64, len(code))[order]
            terms = entries.dictionary
            df = np.fromiter(map(docs[lang].__getitem__, terms.to_pylist()), np.int64, len(terms))
            sizes = np.bincount(code, minlength=len(terms))
            whole = [pa.array([lang] * len(terms), pa.string()), terms.cast(pa.string()), pa.array(df), _lists(pa.array(list(by), pa.string()).take(pa.array(source)), sizes), _lists(pa.array(n), sizes)]
            batch = pa.RecordBatch.from_arrays(whole, schema=_ARROW)
            for k in range(0, len(terms), 1 << 16):
                yield batch.slice(k, 1 << 16)
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            words = _TERM.findall(text.translate(_TO_LOWER))
            stripe = counts[lang][source]
            held -= len(stripe)
            stripe.update(words)
            held += len(stripe)
            docs[lang].update(set(words))
            if held >= most_entries:
                yield from spill()
                held = 0
    yield from spill()


def _merge(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Neighbouring rows of one (lang, term) made one: (merged stripes, their documents)."""
    lang, term, df, sources, counts = batch.columns
    new = np.ones(len(batch), bool)
    if len(batch) > 1:
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(batch) - 1)), pc.equal(term.slice(1), term.slice(0, len(batch) - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    total = np.add.reduceat(df.to_numpy(), first)
    group = np.repeat(np.cumsum(new) - 1, sources.value_lengths().to_numpy())
    coded = sources.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    cell, at = np.unique(group * width + coded.indices.to_numpy(), return_inverse=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, at.reshape(-1), counts.flatten().to_numpy())
    sizes = np.bincount(cell // width, minlength=len(first))
    index = pa.array(first)
    columns = [lang.take(index), term.take(index), pa.array(total), _lists(coded.dictionary.take(pa.array(cell % width)), sizes), _lists(pa.array(n), sizes)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW), total


def _merged(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """From stripes in order of (lang, term): one for each term of at least ``min_docs`` documents."""
    last = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _ARROW)], schema=_ARROW)
        if last is not None:
            batch = pa.concat_batches([last, batch])
        if not len(batch):
            continue
        whole, df = _merge(batch)
        #: the last term may go on in the next batch, as one stripe
        last = whole.slice(len(whole) - 1)
        keep = np.flatnonzero(df[:-1] >= min_docs)
        if len(keep):
            yield whole.take(pa.array(keep))
    if last is not None and last.column(2)[0].as_py() >= min_docs:
        yield last


def term_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, term, df, sources, counts): the merged stripe of each term that ``min_docs`` documents of its language have."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    dealt = read.mapInArrow(partial(_stripes, most_entries=most_entries), STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(partial(_merged, min_docs=min_docs), STRIPE)


def _shares(counts: np.ndarray, sizes: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (N + V)), by long division in base 1000: no product leaves 64 bits."""
    whole = sizes + v
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return 1 + out


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray, int, list[str], np.ndarray]]:
    """From rows in order of (salt, lang, lead first): (lang, its sources, their N, V, terms, counts by term and source) in blocks."""
    lang, names, at, sizes, v, terms, cells = None, [], {}, np.zeros(0, np.int64), 0, [], []
    most = 1

    def block():
        dense = np.zeros((len(terms), len(names)), np.int64)
        for i, (sources, counts) in enumerate(cells):
            dense[i, [at[s] for s in sources]] = counts
        return lang, names, sizes, v, terms, dense

    for batch in batches:
        for new, term, df, sources, counts in zip(*[batch.column(k).to_pylist() for k in ("lang", "term", "df", "sources", "counts")]):
            if term is None:
                if terms:
                    yield block()
                terms, cells = [], []
                lang, names, sizes, v = new, sources, np.array(counts, np.int64), df
                at, most = {s: k for k, s in enumerate(names)}, max(1, BLOCK_CELLS // max(1, len(names)))
                continue
            terms.append(term)
            cells.append((sources, counts))
            if len(terms) >= most:
                yield block()
                terms, cells = [], []
    if terms:
        yield block()


def _term_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, names, sizes, v, terms, counts in _blocks(batches):
        p = _shares(counts, sizes, v)
        q = _shares(counts.sum(axis=1, keepdims=True), sizes.sum(keepdims=True), v)
        term, source = np.nonzero((counts > 0) & (p > q))
        value = _excess(p[term, source], q[term, 0])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), pa.array(names, pa.string()).take(pa.array(source)), pa.array(terms, pa.string()).take(pa.array(term)), pa.array(value)], schema=_TERMS)


def _pair_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of sources of each language in the task; more often only where a task holds more pairs than ``MOST_PAIRS``."""
    totals: dict[str, tuple[list[str], np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (names, total) in totals.items():
            a, b = np.nonzero(~np.eye(len(names), dtype=bool))
            column = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), column.take(pa.array(a)), column.take(pa.array(b)), pa.array(total[a, b])], schema=_TERMS)
        totals.clear()

    for lang, names, sizes, v, _, counts in _blocks(batches):
        if lang not in totals:
            if sum(len(names) ** 2 for names, _ in totals.values()) > MOST_PAIRS:
                yield from rows()
            totals[lang] = (names, np.zeros((len(names), len(names)), np.int64))
        total = totals[lang][1]
        p = _shares(counts, sizes, v)
        for k in range(len(names)):
            total[k] += _excess(p[:, k : k + 1], p).sum(axis=0)
    yield from rows()


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, most_rank: int = MOST_RANK, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank).

    ``pair``: item is another source of the language, value how far the source's shares of all kept terms lie from its.
    ``term``: item is a term that the source uses more than its language does, value by how much; ranks through ``most_rank``.
    """
    spark = docs.sparkSession
    kept = stored(term_stripes(docs, text_col, lang_col, source_col, min_docs, most_entries), "stripes")
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    there = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.lit(0).cast("long").alias("n"))
    sizes = there.unionByName(cells).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    listed = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
    lead = listed.join(kept.groupBy("lang").agg(F.count("*").alias("df")), "lang", "left")
    lead = stored(lead.select("lang", F.coalesce("df", F.lit(0)).cast("long").alias("df"), F.col("g.source").alias("sources"), F.col("g.n").alias("counts")), "stripes-sources")

    #: each bucket of terms is led by a row (term null) with its language's sources
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = kept.select(F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("salt"), "lang", "term", "df", "sources", "counts")
    leads = lead.filter("df > 0").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), "lang", F.lit(None).cast("string").alias("term"), "df", "sources", "counts")
    dealt = salted.unionByName(leads).repartition(n, "salt").sortWithinPartitions("salt", "lang", F.col("term").asc_nulls_first())
    schema = "lang string, source string, item string, value long"

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = dealt.mapInArrow(_term_values, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_rank)
    others = lead.filter("df = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    pairs = dealt.mapInArrow(_pair_values, schema).unionByName(others).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))
