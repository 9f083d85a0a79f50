"""Document fingerprints by order MinHash: sketches that tell texts by edit distance, so also by the order of what they say.

The k-mers of a text are its runs of ``WIDTH`` words, each numbered by its occurrence in the text (a shorter text is one
k-mer). A 64-bit hash of (k-mer, number) deals them into 2 * ``TUPLES`` strata by its top bits; the least of each stratum is
selected, and an empty stratum takes that of the next one that isn't. Strata i and i + ``TUPLES`` make a tuple: their two
k-mers in the order in which the text has them, hashed to 16 bits. Likeness is the share of equal tuples: texts that share
k-mers in another order share few.

All of it is built-in functions on one row: the k-mers as an array of hashes, two sorts of (hash, place) pairs, and array
functions over these. Occurrence numbers come from the first sort, where equal k-mers are neighbours in text order; the
start of a long run of them is found by bisection. Time is n log n in a text's words, memory linear, at any length.

For the edited texts, documents are put in order by a range partition of their ids and text hashes alone, and each
partition's last row is handed to the next one (one row for each partition). Each text then sends to the document before it
only as many characters as that one replaces, and later its fingerprint: no text is sorted, windowed or collected by source.

Null texts are empty. Null ids come first. Rows that agree in id and text are one document with one successor, and each is
reported; rows of one id and different texts follow each other by a hash of the text. A lone document is its own successor.
Texts without words share one fingerprint. Columns besides the two named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE_CHARS, SPACES, bound_to, stored

WIDTH, TUPLES = 3, 64
_STRATUM_BITS = (2 * TUPLES).bit_length() - 1
KEY = ["known", "id", "print"]


def kmer_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words, in text order."""
    def of(words: Column) -> Column:
        runs = F.transform(F.slice(words, 1, F.size(words) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, width)]))
        return F.when(F.size(words) >= width, runs).when(F.get(words, F.lit(0)) == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))

    return bound_to(F.split(F.trim(text, F.lit(SPACE_CHARS)), SPACES), of)


def _numbered(pairs: Column) -> Column:
    """From (hash, place) in order: (hash of k-mer and occurrence number, place)."""
    halves = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def start(x: Column, i: Column) -> Column:
        #: i less the largest steps that stay among equals
        return F.aggregate(F.filter(halves, lambda p: p <= i), i, lambda at, p: F.when((at >= p) & (F.get(pairs, at - p)["h"] == x["h"]), at - p).otherwise(at))

    def number(x: Column, i: Column) -> Column:
        back = lambda k: F.get(pairs, i - k)["h"].eqNullSafe(x["h"])
        return F.when(~back(1), F.lit(0)).when(~back(2), F.lit(1)).otherwise(i - start(x, i))

    return F.transform(pairs, lambda x, i: F.struct(F.xxhash64(x["h"], number(x, i)).alias("v"), x["at"].alias("at")))


def order_minhash(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint as binary: two bytes for each tuple."""
    #: from 0, in the (signed) order of v
    stratum = lambda e: F.shiftright(e["v"], 64 - _STRATUM_BITS).cast("int") + TUPLES

    def selected(e: Column) -> Column:
        return F.filter(e, lambda x, i: (i == 0) | (stratum(F.get(e, i - 1)) != stratum(x)))

    def dense(s: Column) -> Column:
        reach = lambda x, i: stratum(x) - F.when(i == 0, F.lit(-1)).otherwise(stratum(F.get(s, i - 1)))
        own = F.flatten(F.transform(s, lambda x, i: F.array_repeat(x, reach(x, i))))
        return F.concat(own, F.array_repeat(F.get(s, F.lit(0)), 2 * TUPLES - 1 - stratum(F.get(s, F.size(s) - 1))))

    def tuples(d: Column) -> Column:
        a, b = lambda i: F.get(d, i), lambda i: F.get(d, i + TUPLES)
        both = lambda i: F.when(a(i)["at"] <= b(i)["at"], F.xxhash64(a(i)["v"], b(i)["v"])).otherwise(F.xxhash64(b(i)["v"], a(i)["v"]))
        return F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda i: F.lpad(F.hex(F.shiftrightunsigned(both(i), 48)), 4, "0"))))

    paired = F.sort_array(F.transform(kmer_hashes(text, width), lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    chosen = bound_to(bound_to(paired, lambda p: F.sort_array(_numbered(p))), selected)
    none = F.unhex(F.lit("0" * 4 * TUPLES))
    return bound_to(chosen, lambda s: F.when(F.size(s) == 0, none).otherwise(bound_to(bound_to(s, dense), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2)))
    return F.size(same) / F.lit(float(TUPLES))


def _before(docs: DataFrame) -> DataFrame:
    """(known, id, print, before): for each distinct document, the key and length of the one before it; the last comes before the first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(*KEY, "n_chars").distinct().repartitionByRange(n, *KEY).withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "fingerprint-order")
    key = F.struct(*KEY, "n_chars")
    #: one row for each partition
    ends = ordered.groupBy("part").agg(F.max(key).alias("last")).withColumn("every", F.lit(1))
    ends = ends.select("part", F.coalesce(F.lag("last").over(W.partitionBy("every").orderBy("part")), F.max("last").over(W.partitionBy("every"))).alias("hand"))
    ordered = ordered.withColumn("lag", F.lag(key).over(W.partitionBy("part").orderBy(*KEY)))
    return ordered.join(ends, "part").select(*KEY, F.coalesce("lag", "hand").alias("before"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has the last half of its characters replaced by the first as many of the next document's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    #: only the key and the text, so that both joins read one and the same shuffle of the texts
    read = docs.select(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    doc_id, n_chars = F.when(F.col("known"), F.col("id")).cast(docs.schema[id_col].dataType), F.length("text").cast("long")
    before = _before(read.withColumn("n_chars", n_chars))
    here = read.join(before, KEY)
    half = F.floor(F.col("before")["n_chars"] / 2).cast("int")
    heads = here.select(*[F.col("before")[k].alias(k) for k in KEY], F.substring(F.col("text"), F.lit(1), half).alias("head")).dropDuplicates(KEY)
    kept = (n_chars - F.floor(n_chars / 2)).cast("int")
    edited = here.join(heads, KEY).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("head")))
    made = edited.select(doc_id.alias("doc_id"), *KEY, "before", n_chars.alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), order_minhash(F.col("text"), width).alias("f"), order_minhash(F.col("edited"), width).alias("e"))
    made = stored(made, "fingerprints")
    after = made.select(*[F.col("before")[k].alias(k) for k in KEY], F.col("f").alias("next")).dropDuplicates(KEY)
    hexed = lambda c: F.lower(F.hex(c))
    return made.join(after, KEY).select("doc_id", "n_chars", hexed("sha").alias("edited_sha256"), hexed("f").alias("fingerprint"), hexed("e").alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next")).alias("near_next"))
