"""Fingerprints, the source audit and conversation repair against plain Python, on hand-made edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_llm import DOCS
from tracelake.llm import common, conversation_repair, jaccard_join, order_minhash, source_audit
from tracelake.llm.queries import QUERIES

CLASH = ["known", "id", "print", "before", "part", "head", "v", "at", "n", "df", "term", "item", "value", "rank", "sources", "counts", "salt", "k", "audit", "cost", "copies", "kind", "i", "c", "p"]


def table_of(spark, rows, schema, n=4):
    return spark.createDataFrame(rows, schema).repartition(n)


def in_order(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- 11


@pytest.fixture(scope="module")
def odd_docs():
    return [*DOCS, (None, "a b c d"), (None, "a b c d"), (None, None), (3, "other text of id three"), (5, DOCS[5][1]), (5000, "x " * 700), (5001, "x"), (5002, "a  b"), (5003, "ü\n\té")]


def test_fingerprints(spark, odd_docs):
    d = table_of(spark, odd_docs, "doc_id long, text string")
    want = sorted(brute.fingerprints(odd_docs), key=str)
    assert in_order(order_minhash.fingerprints(d)) == want
    assert in_order(order_minhash.fingerprints(d.withColumns({c: F.lit("7") for c in CLASH}))) == want
    assert order_minhash.fingerprints(d.limit(0)).count() == 0
    assert in_order(order_minhash.fingerprints(d.filter("doc_id = 5001"))) == sorted(brute.fingerprints([(5001, "x")]), key=str)


def test_fingerprints_of_the_table(spark):
    docs = [tuple(r) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert in_order(QUERIES["op11_order_minhash"](spark, DATA)) == sorted(brute.fingerprints(docs), key=str)


def test_likeness_follows_order_and_edits(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    moved = words[1000:] + words[:1000]
    shuffled = [w for k in rng.sample(range(100), 100) for w in words[k * 20 : k * 20 + 20]]
    few = [w if rng.random() > 0.01 else "new" for w in words]
    d = spark.createDataFrame([(" ".join(words), *map(" ".join, (words, few, moved, shuffled, words[::-1])))], "a string, same string, few string, moved string, shuffled string, back string")
    got = d.select(*[order_minhash.likeness(order_minhash.order_minhash(F.col("a")), order_minhash.order_minhash(F.col(c))).alias(c) for c in d.columns[1:]]).first()
    assert got["same"] == 1 and got["few"] > 0.8
    #: the same k-mers but for those at the cuts, in another order
    assert got["shuffled"] < got["moved"] + 0.2 < got["few"] + 0.2 and got["shuffled"] < 0.7 and got["back"] < 0.05


# -- 12


def audit_docs():
    rng = random.Random(7)
    words = ["the", "Of", "über", "niño", "x", "zeta", "ÉTÉ", "mid-word", "a1b", "\u4f60\u597d", "q_r", "*", "end."]
    out = []
    for k in range(160):
        text = rng.choice([None, "", "..", " ".join(rng.choice(words[: 3 + k % 11]) for _ in range(rng.randrange(40)))])
        out.append((k % 40, text, rng.choice(["en", "de", "", None, "rare" if k % 50 == 0 else "en"]), rng.choice([None, "", "s1", "s2", "s3", f"t{k % 9}"])))
    return [*out, (200, "one two", "few", "s1"), (201, "", "few", "s2"), (202, None, "none", "s1"), (203, "the the " * 4000, "en", "s1")]


def test_source_audit(spark):
    docs = audit_docs()
    want = brute.divergences([x[1:] for x in docs])
    d = table_of(spark, docs, "doc_id long, text string, lang string, source string")
    assert in_order(source_audit.source_divergence(d)) == sorted(want, key=str)
    crowded = d.withColumns({c: F.lit("7") for c in CLASH})
    #: a spill after each document, and blocks of one term
    assert in_order(source_audit.source_divergence(crowded, most_entries=1)) == sorted(want, key=str)
    assert source_audit.source_divergence(d.limit(0)).count() == 0
    few = in_order(source_audit.source_divergence(d, min_docs=1, most_rank=2))
    assert few == sorted(brute.divergences([x[1:] for x in docs], 1, 2), key=str)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        v, size = rng.randrange(1, 10**6), rng.randrange(10 ** rng.randrange(1, 15))
        n = rng.randrange(size + 1)
        assert source_audit._shares(np.array([n]), np.array([size]), v)[0] == 1 + 10**9 * (n + 1) // (size + v)


# -- 13

ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ü"]
SAID = ["Yes.", "no", "Why? ", "!", "", None, " \t\n", "end.\n", "ok"]


def talks(seed, ids, most):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for i in range(rng.randrange(1, most)):
            rows += [(c, rng.choice([None, i, i, i + 3, rng.randrange(9)]), rng.choice(ROLES), rng.choice(SAID))] * rng.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversation_repair(spark):
    rows = talks(3, [None, *range(60)], 12)
    d = table_of(spark, rows, SCHEMA)
    assert in_order(conversation_repair.repair_damaged(d)) == sorted(brute.conversations(rows), key=str)
    want = sorted(brute.conversations(rows, hurt=False), key=str)
    assert in_order(conversation_repair.repair_conversations(d)) == want
    assert in_order(conversation_repair.repair_conversations(d.withColumns({c: F.lit("7") for c in CLASH}))) == want
    assert conversation_repair.repair_damaged(d.limit(0)).count() == 0


def test_conversation_over_many_tasks(spark):
    """One conversation with most rows, a repeated row all through it, and short ones around it."""
    rng = random.Random(9)
    rows = talks(4, range(8), 6) + talks(5, range(90, 94), 6)
    for i in range(1200):
        rows.append((40, None if i % 7 == 0 else i // 2, rng.choice(ROLES[:7]), rng.choice([f"t{i}.", f"t{i}", "Yes.", "", f"q{i % 40}?"])))
    got = in_order(conversation_repair.repair_conversations(table_of(spark, rows, SCHEMA)))
    assert got == sorted(brute.conversations(rows, hurt=False), key=str)


def test_conversation_of_other_ids(spark):
    rows = [("b", 1, "user", "A?"), ("b", 2, "assistant", "B."), ("ä", 1, "assistant", "x"), (None, 1, "user", "y.")]
    got = in_order(conversation_repair.repair_conversations(table_of(spark, rows, SCHEMA.replace("conv_id long", "conv_id string"))))
    assert got == sorted(brute.conversations(rows, hurt=False), key=str)


def test_ranks_order_nodes_by_their_audits():
    """Doubled ranks choose the least of all cheapest paths: against a walk over all of them."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        letter, must, late = rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.3
        late &= ~must
        paths = conversation_repair.LeastPaths(letter, must, late, np.array([0, n]), conversation_repair._ENDS, True)

        def walks(i, s, inserts=0):
            if i == n and s in (0, 3):
                yield 0, ""
            to = [2, 2, 3, 2][s]
            if inserts < 3:
                yield from ((5 + c, "I" + a) for c, a in walks(i, to, inserts + 1))
            if i < n:
                yield from ((2 + c, "D" + a) for c, a in walks(i + 1, s))
                if not must[i]:
                    kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((s, int(letter[i])))
                    more = 5 * int(late[i])
                    if kept is not None:
                        yield from ((more + c, "K" + a) for c, a in walks(i + 1, kept))
                    yield from ((1 + more + c, "R" + a) for c, a in walks(i + 1, to))

        _, code, _ = paths.path(np.array([0]), np.array([0]))
        assert (int(paths.cost[0, 0]), conversation_repair._LETTERS[code].tobytes().decode()) == min(walks(0, 0))


# -- names that clash, and null ids, in the earlier operators


def test_names_of_own_columns(spark):
    """Columns named as an operator's own pass through, and its own output can go in again."""
    from tracelake.llm.line_dedup import line_dedup
    from tracelake.llm.mixing import mix, mix_rates

    rows = [(i, f"same line\nown {i} {'w ' * (i % 5)}", "en", f"s{i % 3}") for i in range(40)]
    d = table_of(spark, rows, "doc_id long, text string, lang string, source string")
    clash = ["_id", "_doc_id", "_print", "_text", "_keep_bitmap", "_n_lines", "_n_dropped", "_mix", "_MIX2", "copy"]
    crowded = d.withColumns({c: F.lit(f"own {c}") for c in clash})
    out = line_dedup(crowded)
    assert sorted(out.columns) == sorted(crowded.columns)
    assert in_order(out.select("doc_id", "text", "_n_dropped")) == in_order(line_dedup(d).select("doc_id", "text", "_n_dropped"))
    assert {r["_print"] for r in out.collect()} == {"own _print"}
    assert {r["_n_dropped"] for r in line_dedup(out).collect()} == {0}
    assert in_order(mix_rates(crowded).select("doc_id", "_mix.*")) == in_order(mix_rates(d).select("doc_id", "_mix.*"))
    mixed = mix(crowded)
    assert in_order(mixed.select("doc_id", "copy")) == in_order(mix(d).select("doc_id", "copy")) and {r["_mix"] for r in mixed.collect()} == {"own _mix"}


def test_lines_of_null_ids_are_counted_by_text(spark):
    from tracelake.llm.line_dedup import line_dedup

    rows = [(None, f"common\nrow {i}") for i in range(12)] + [(None, "twin\nx")] * 30 + [(5, "five\nlast")] * 30
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r["text"]: r["_n_dropped"] for r in out.collect()}
    #: the line of twelve texts goes; thirty equal rows of null id are one document, as are thirty rows of one id
    assert got == {**{f"row {i}": 1 for i in range(12)}, "twin\nx": 0, "five\nlast": 0}


# -- 4


def test_jaccard_shared_passages(spark, monkeypatch):
    """Many documents share a passage and little else: its parts go to the end of the order, and no link is lost."""
    rng = random.Random(11)
    say = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passages, texts = [say(40), say(50)], []
    for k in range(240):
        own = say(30 if k % 2 else 22)
        at = rng.randrange(len(own))
        texts.append(own[:at] + passages[k % 2] + own[at:])
    for k in range(0, 240, 9):
        # near copies: the first few words anew, which may or may not keep the link
        texts.append(say(1 + k % 12) + texts[k][1 + k % 12 :])
    texts += [say(8) + passages[0], passages[0], passages[1], passages[0][:9], passages[0][:12]]
    texts = [(i, " ".join(x)) for i, x in enumerate(texts)]
    seen, whole, pairs = [], jaccard_join._rebrought, jaccard_join._open
    monkeypatch.setattr(jaccard_join, "_rebrought", lambda *x: seen.append("moved") or whole(*x))

    def opened(*x):
        out = pairs(*x)
        seen.append(out[2])
        return out

    monkeypatch.setattr(jaccard_join, "_open", opened)
    got = jaccard_join.jaccard_components(table_of(spark, [*texts, (None, texts[0][1]), (7, None)], "doc_id long, text string"))
    want = brute.components(texts)
    assert in_order(got) == sorted([*want, (None, want[0][1], None), (7, 0, 7)], key=str)
    assert len({c for *_, c in want}) < len(texts)
    assert seen[seen.index("moved") - 1] > 10 * seen[-1]


def test_moved_orders_keep_the_pigeonhole():
    """However keys are moved to the end of the order, linked sets bring one in common."""
    rng = np.random.default_rng(3)
    for n in (3, 16, 17, 60, 120, 400):
        for part in range(1, 4):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            drop = int(rng.integers(0, jaccard_join.most_apart(n, n) // 2 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])
            if 100 * (n - drop) < 80 * (n + drop):
                continue

            def brought(x):
                out = set()
                for keys, bring in jaccard_join.key_orders(np.sort(x)):
                    late = keys % np.uint64(4) < part
                    out |= set(np.concatenate([keys[~late], keys[late]])[:bring].tolist())
                return out

            assert brought(a) & brought(b)
