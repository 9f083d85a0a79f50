"""Crowded parts of the n-gram join: who brings other parts, and which pairs go on to their texts."""

import random

import numpy as np

from tracelake.llm import jaccard_join as J


def _spied(monkeypatch, docs):
    """{name: rows of each table stored under it} of a run, and its result."""
    seen, stored = {}, J.stored

    def spy(df, name):
        out = stored(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(J, "stored", spy)
    return {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()}, seen


def test_only_sets_with_a_crowded_part_bring_others(spark, monkeypatch):
    """Long texts apart from a crowd of 45 shared words out of 70 bring no other parts for a false bit."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    common = words(45)
    rows = [(i, f"{words(25)} {common}") for i in range(600)] + [(1000 + i, words(2500)) for i in range(250)]
    got, seen = _spied(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {i: i for i, _ in rows}
    held = {r["sid"]: r["doc_id"] for r in seen["jaccard-sets"][0].select("sid", "doc_id").collect()}
    again = {held[r["sid"]] for x in seen["jaccard-again"] for r in x.select("sid").distinct().collect()}
    assert again and max(again) < 1000


def test_wide_sketch_bounds_the_difference():
    """Parity bits never exceed the symmetric difference, and 1024 of them tell 160 changes from 86, which 256 do not."""
    rng = np.random.default_rng(3)
    apart = lambda x, y, words: int(np.bitwise_count((J._sketch(x, words) ^ J._sketch(y, words)).view(np.uint64)).sum())
    for size in (0, 1, 43, 80, 300):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (390 - min(size, 300), size, size))
        x, y = np.append(both, a), np.append(both, b)
        assert apart(x, y, 4) <= 2 * size and apart(x, y, J.WIDE_WORDS) <= 2 * size
        if size == 80:
            assert apart(x, y, J.WIDE_WORDS) > J.most_apart(390, 390)
