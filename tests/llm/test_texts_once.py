"""The n-gram Jaccard join fetches each text that a pair names by one shuffle, and carries one sketch into its last join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import jaccard_join


def test_texts_are_found_by_one_shuffle(spark) -> None:
    long, other = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(1, long), (1, long), (1, long.replace(" ", "  ")), (1, other), (2, long), (3, other), (None, long), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.xxhash64("text"))
    members = docs.mapInArrow(jaccard_join._members, jaccard_join.MEMBER).filter("sid is not null and doc_id is not null")
    members = members.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min_by("print", "doc_id").alias("print"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard_join._candidates(docs, members, members.select("sid"))
        texts = [x.text.split() for x in found.collect()]
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(texts) == [other.split(), long.split()]
    # one for the texts and one for the sets: none follows the join
    assert plan.count("Exchange hashpartitioning(") == 2, plan


def test_wide_sketch_implies_the_narrow_one() -> None:
    draw = np.random.default_rng(5)
    for n in (1, 20, 200, 2000):
        a, b = (np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in "ab")
        b = np.union1d(a[: n // 2], b)
        narrow, wide = (np.bitwise_count((jaccard_join._sketch(a, w) ^ jaccard_join._sketch(b, w)).view(np.uint64)).sum() for w in (jaccard_join.SKETCH_WORDS, jaccard_join.WIDE_WORDS))
        assert narrow <= wide
