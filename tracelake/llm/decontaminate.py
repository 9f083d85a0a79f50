"""Benchmark decontamination with built-in functions only.

The benchmark's n-gram windows are hashed into a bit set, which every task gets; one projection over each text keeps the
windows whose bit is set, and an equi-join on the full n-gram text verifies them (by broadcast where Spark finds the n-gram
table small, else by shuffling the few windows that passed). The bit set has 128 bits or more for each window of the
benchmark, but at most ``MOST_BITS`` (4 MB): beyond 262,144 windows more of the others pass the first test, none is lost. Texts are
never shuffled here, and documents without a passing window take no part in the join.

Null texts have no words. A benchmark row without words, or with a null text, has no window; a null item_id still marks
words as hit but isn't listed. Rows are told apart by doc_id and a hash of the text, so each text is judged by itself, also
where ids are null or shared; each row has its own row in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import PLAIN_WORD, ascii_lower, bit_set, bits_for, bound_to, has_bit, stored

WINDOW = 13


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def _starts(words: Column, length: Column) -> Column:
    return F.sequence(F.lit(1), F.size(words) - length + 1)


def _hash(words: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(words, start, length))


def benchmark_grams(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(gram, length, hash, item_id) for each distinct window of each item."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), _words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    items = items.withColumn("length", length)
    at = F.transform(_starts(F.col("words"), F.col("length")), lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, F.col("length"))).alias("gram"), _hash(F.col("words"), i, F.col("length")).alias("hash")))
    return items.select("item_id", "length", F.explode(at).alias("x")).select("x.gram", "length", "x.hash", "item_id").distinct()


def window_hits(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """(id, print, n_words, first, at, length, item_id): the verified windows, and one ``first`` row for each row of ``docs``."""
    packed, lengths = bit_set(grams, bits), grams.agg(F.array_sort(F.collect_set("length")).alias("lengths"))
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_print"), _words(F.col(text_col)).alias("words"), packed.scalar().alias("bits"), lengths.scalar().alias("lengths"))

    def passing(w: Column) -> Column:
        def of_length(m: Column) -> Column:
            slots = F.transform(_starts(w, m), lambda i: F.struct(i.alias("at"), F.pmod(_hash(w, i, m), F.lit(bits)).alias("slot")))
            kept = F.filter(slots, lambda x: has_bit(F.col("bits"), x["slot"]))
            return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), m.alias("length"), F.concat_ws(" ", F.slice(w, x["at"], m)).alias("gram")))

        found = F.flatten(F.transform(F.filter(F.col("lengths"), lambda m: m <= F.size(w)), of_length))
        # the null stands for the row itself
        return F.concat(F.array(F.lit(None)), found)

    both = bound_to(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), passing(w).alias("passed")))
    seen = read.select("_id", "_print", both.alias("x")).select("_id", "_print", "x.n_words", F.explode("x.passed").alias("y"))
    seen = seen.select("_id", "_print", "n_words", F.col("y").isNull().alias("first"), "y.at", "y.length", "y.gram")
    seen = stored(seen, "windows-passed")
    hits = seen.filter("gram is not null").join(grams.select("gram", "item_id"), "gram")
    hits = hits.select("_id", "_print", "n_words", F.lit(False).alias("first"), "at", "length", "item_id")
    none = F.lit(None)
    return hits.union(seen.filter("first").select("_id", "_print", "n_words", "first", none.cast("int"), none.cast("int"), none.cast("string")))


def _verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, bits: int | None) -> DataFrame:
    """(_id, _print, n_words, hits, items, n_hit, contaminated, copies): one row per id and text, which ``copies`` rows have."""
    grams = stored(benchmark_grams(benchmark, item_col, item_text, window), "grams")
    hits = window_hits(docs, grams, id_col, text_col, bits or bits_for(grams.count()))
    by = hits.groupBy("_id", "_print").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "length")))).alias("hits"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.count_if("first").alias("copies"),
    )
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(a["end"], x["at"]))).alias("n"))
    n_hit = F.aggregate("hits", zero, step, lambda a: a["n"].cast("long"))
    out = by.select("_id", "_print", "n_words", "hits", "items", n_hit.alias("n_hit"), "copies")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """Per row of ``docs``: n_words, hits (sorted word intervals), n_hit, items (sorted strings), contaminated.

    Contaminated: at least one hit, and a twentieth of the words or more are hit.
    """
    found = _verdicts(docs, benchmark, id_col, text_col, item_col, item_text, window, bits)
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(F.col("_id").alias(id_col), "n_words", "hits", "items", "n_hit", "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; rows with a null id are judged one by one too."""
    found = _verdicts(docs, benchmark, id_col, text_col, item_col, item_text, window, bits).filter("contaminated")
    #: stored, so that its size is known before the join is planned
    bad = stored(found.select(F.col("_id").alias("_bad"), F.col("_print").alias("_bad_print")), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text_col]) == bad["_bad_print"]), "left_anti")
