"""N-gram Jaccard join with parity sketches.

A document's set of distinct word shingles is hashed into a parity sketch of P parts: each part is the exclusive-or of the
64-bit hashes that fall into it (the parity of a very wide, sparse bit vector). One element more or less changes one part,
so the number of differing parts is at most the size of the symmetric difference, which a similarity of 0.8 bounds by
(|A| + |B|) / 9. By the pigeonhole principle two linked documents have at least P less that bound parts in common, so it is
enough that each brings the first bound + 1 of its parts in an order both share (parts of many elements first: the likeliest
to be rare) to meet in at least one. P and the order are set per band of sizes; a document near a band's upper end also
joins the next band. Sets of under 16 elements differ in three at most: they meet in one of their first elements by hash
(one more than a fifth of the set) and in one of the four words of a 256-bit parity sketch. No link is lost, and the number
of parts brought grows with the text's length only.

Documents with equal sets are one member from the start. The members that meet in a part are streamed in sorted order and
tied to the first, which is linear in the rows; it is the one with the most shared parts (of a family of near copies the
likeliest original) or one by a hash. Ties whose sizes and 256-bit sketches allow a link (Hamming distance again bounds the difference from below) are
verified on whole texts and joined to components. Parts that many members share without a link (a common passage) then go to
the end of the order, by a bit set of their keys, which any two sets read alike: sets that brought one of them bring rarer parts
instead, and the pigeonhole bound holds for each such order. A false bit moves a rare part, which loses nothing. Members that
have too few other parts still meet in a common one: those with about 0.6 and more of their shingles in common with the rest,
whose pairs that part compares in one group of Spark's sorted join. At the end all pairs of members that met but lie in different components
are taken, if their sizes and sketches of 1024 bits allow a link, and verified as well. A pair that met in many parts comes from one of them: each
member carries its ``LOW`` smallest part keys, and of those that both carry only the smallest gives the pair; a pair without
any such key comes from each part. Groups are streamed or joined in sorted order, never collected.

Texts that are null or without words have an empty set and are linked with nothing. A null doc_id is not linked either and
gets a null component. Rows that share a doc_id are one document if their texts agree, else each text takes part and both
rows carry the id. Set identity, shingle equality and which of an id's texts stands for a set rest on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bit_set, bits_for, has_bit, stored
from tracelake.llm.components import connected_components
from tracelake.llm.textkit import U64, mix64, set_hash, shingle_sets, text_slices

WIDTH = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
SKETCH_WORDS, WIDE_WORDS = 4, 16
#: Sets of fewer elements meet in elements, not in parts: small sets would have empty parts in common.
SMALL = 16
#: A further round against centres comes if over FEW pairs for each row are left and the last one found a link for TEN rows.
ROUNDS, FEW, TEN, ORDERS = 4, 8, 10, 32
LOW = 8
#: Bits that a crowded key has in their bit set: at 128 bits a key, about one other key in a million has all of them.
PROBES = 4
#: A text that more pairs than this name is repeated in as many partitions of the join as needed.
HOT = 4096


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def _bands(n: int) -> list[tuple[int, int, int]]:
    """(band, parts in it, parts that a set of ``n`` elements brings): bands double, and the largest partner is n / 0.8."""
    own, partner = max(n, SMALL).bit_length() - 1, n * DEN // NUM
    out = []
    for k in range(own, partner.bit_length()):
        high = (2 << k) - 1
        bring = most_apart(n, min(high, partner)) + 1
        out.append((k, most_apart(high, high) * 3 // 2 + 6, bring))
    return out


def key_orders(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(keys in the order that all sets share, how many of them the set brings): its elements if it is small, then each band."""
    out = []
    mixed = mix64(values + U64(1))
    n = len(values)
    if n < SMALL:
        first = np.sort(mixed)[: n + 1 + -n * NUM // DEN]
        words = mix64(_sketch(values).view(U64) + np.arange(SKETCH_WORDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
        pairs = mix64(first[:, None] + words).ravel()
        out.append((pairs, len(pairs)))
    for k, parts, bring in _bands(n):
        slot = ((mixed >> U64(32)) * U64(parts)) >> U64(32)
        order = np.argsort(slot, kind="stable")
        held, first, count = np.unique(slot[order], return_index=True, return_counts=True)
        parity = np.zeros(parts, dtype=U64)
        parity[held] = np.bitwise_xor.reduceat(mixed[order], first)
        counts = np.zeros(parts, dtype=np.int64)
        counts[held] = count
        keys = mix64(mix64(parity + np.arange(parts, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(k + 1))
        out.append((keys[np.lexsort((keys, -counts))], bring))
    return out


def part_keys(values: np.ndarray) -> np.ndarray:
    """The keys under which a set of hashes meets others, over its bands."""
    return np.concatenate([keys[:bring] for keys, bring in key_orders(values)])


def _sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """64 parity bits a word, as signed longs; ``words`` is a power of two."""
    size = 64 * words
    bits = np.bincount((values >> U64(65 - size.bit_length())).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


SKETCH = [f"s{j}" for j in range(SKETCH_WORDS)]
WIDE = [f"w{j}" for j in range(WIDE_WORDS)]
MEMBER = "doc_id long, print long, sid long, n long, " + ", ".join(f"{c} long" for c in SKETCH + WIDE) + ", keys array<long>"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; of equal sets in a batch, one brings its keys. A null id brings none."""
    for batch in batches:
        ids, known = batch.column(0).cast(pa.int64()), batch.column(0).is_valid().to_pylist()
        seen: set[int] = set()
        for a, b, data, offsets in text_slices(batch.column(1)):
            sids, sizes, bits, keys = [], [], np.zeros((b - a, SKETCH_WORDS + WIDE_WORDS), np.int64), []
            for i, values in enumerate(shingle_sets(data, offsets, WIDTH)):
                sids.append(set_hash(values) if len(values) else None)
                sizes.append(len(values))
                bits[i] = np.append(_sketch(values), _sketch(values, WIDE_WORDS))
                brings = len(values) and known[a + i] and sids[-1] not in seen
                keys.append(part_keys(values).view(np.int64) if brings else np.zeros(0, np.int64))
                if brings:
                    seen.add(sids[-1])
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(bits[:, j]) for j in range(bits.shape[1])], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate(keys))],
                names=["doc_id", "print", "sid", "n", *SKETCH, *WIDE, "keys"],
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, sid): those of the keys that have more than one sid, each once."""
    key0 = sid0 = np.zeros(0, np.int64)  # the last row, which waits for the next
    joined = False  # whether it has the key of the row before it

    def rows(key: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid)], names=["key", "sid"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key0, sid0)))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[new], sid[new]
        same = np.append(joined, key[1:] == key[:-1])
        keep = (same | np.append(same[1:], False))[:-1]
        key0, sid0, joined = key[-1:], sid[-1:], bool(same[-1])
        if keep.any():
            yield rows(key[:-1][keep], sid[:-1][keep])
    if joined:
        yield rows(key0, sid0)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, rank): (a, b), a < b, of each member with its key's first, where a link is possible."""
    key0 = centre0 = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        now = np.stack([batch.column(k).to_numpy() for k in range(1, 4 + SKETCH_WORDS)])  # sid, component, n and the sketch
        if key0 is not None:
            key, now = np.append(key0, key), np.concatenate([centre0, now], axis=1)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        centre = now[:, at]
        key0, centre0 = key[-1:], centre[:, -1:]
        small, large = np.minimum(now[2], centre[2]), np.maximum(now[2], centre[2])
        apart = np.bitwise_count((now[3:] ^ centre[3:]).view(U64)).sum(axis=0, dtype=np.int64)
        keep = (now[1] != centre[1]) & (small * DEN >= large * NUM) & (apart * (DEN + NUM) <= (small + large) * (DEN - NUM))
        pairs = np.unique(np.sort(np.stack([now[0], centre[0]])[:, keep], axis=0), axis=1)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sid, text): (sid, bring, keys) for each order of the texts."""
    for batch in batches:
        want = batch.column(0).to_pylist()
        for a, _, data, offsets in text_slices(batch.column(1)):
            sids, brings, keys = [], [], [np.zeros(0, U64)]
            for i, values in enumerate(shingle_sets(data, offsets, WIDTH), a):
                for order, bring in key_orders(values):
                    sids.append(want[i])
                    brings.append(bring)
                    keys.append(order)
            ends = np.cumsum([len(x) for x in keys])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate(keys).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(brings, pa.int32()), lists], names=["sid", "bring", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        step = 64
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            sides = [[values for *_, data, offsets in text_slices(part.column(j)) for values in shingle_sets(data, offsets, WIDTH)] for j in (2, 3)]
            for i, (x, y) in enumerate(zip(*sides)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k + i] = DEN * both >= NUM * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _allowed(a: str, b: str) -> F.Column:
    """Sizes and the wide parity sketches allow a link; these differ in no fewer bits than the 256 that are folded from them."""
    small, large, both = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n"), F.col(f"{a}n") + F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in WIDE), F.lit(0))
    return (small * DEN >= large * NUM) & (apart * (DEN + NUM) <= both * (DEN - NUM))


def _bit_test(hashes: DataFrame, each: int = 128, probes: int = 1):
    """The one-row table of a bit set over the column ``hash``, and the test of a column against it (as the column ``bits``).

    With one of ``probes``, a set of many keys that is tested key by key nearly always has a false one.
    """
    bits = bits_for(hashes.count(), each)
    slots = lambda x: [F.shiftrightunsigned(x, 13 * j).bitwiseAND(F.lit(bits - 1).cast("long")) for j in range(probes)]
    if probes > 1:
        hashes = hashes.select(F.explode(F.array(*slots(F.col("hash")))).alias("hash"))
    return bit_set(hashes, bits), lambda x: reduce(lambda p, q: p & q, [has_bit(F.col("bits"), s) for s in slots(x)])


def _candidates(docs: DataFrame, members: DataFrame, named: DataFrame) -> DataFrame:
    """(sid, text): one text for each of the sets ``named``. A bit set of ids keeps most other texts from the shuffle.

    A text is found by its id and print, so it is shuffled once: copies of a row lie in the partition that the join made.
    """
    wanted = stored(members.join(named, "sid", "left_semi").select("doc_id", "print", "sid"), "jaccard-wanted")
    packed, has = _bit_test(wanted.select(F.xxhash64("doc_id").alias("hash")))
    docs = docs.withColumn("bits", packed.scalar()).filter(has(F.xxhash64("doc_id")))
    return docs.join(wanted, ["doc_id", "print"]).select("doc_id", "print", "sid", "text").dropDuplicates(["doc_id", "print"]).select("sid", "text")


def _texts_of(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, text): one text for each set that a pair names."""
    named = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    return stored(_candidates(docs, members, named), "jaccard-texts")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link. Each text of a pair is joined to it; one that very many pairs name is repeated over partitions."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT)
    hot = stored(named.select("sid", F.ceil(F.col("_n") / HOT).cast("long").alias("_of")), "jaccard-hot")
    share = F.coalesce(F.col("_of"), F.lit(1).cast("long"))
    own = texts.join(hot, "sid", "left").select("sid", "text", F.explode(F.sequence(F.lit(0).cast("long"), share - 1)).alias("_salt"))
    for side, other in (("a", "b"), ("b", "a")):
        dealt = pairs.join(hot.withColumnRenamed("sid", side), side, "left").withColumn("_salt", F.pmod(F.xxhash64(other), share)).drop("_of")
        pairs = dealt.join(own.withColumnsRenamed({"sid": side, "text": f"text_{side}"}), [side, "_salt"]).drop("_salt")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def _exploded(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``sets`` with their component so far, a row for each key."""
    here = sets.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    return here.withColumn("key", F.explode("keys")).drop("keys")


def _merged(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` after the links ``found``: each component so far counts as a star, so its links aren't followed again."""
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))


def _open(sets: DataFrame, parts: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, n, pairs) of the keys that hold members of different components; their rows and pairs in all."""
    held = _exploded(sets.select("sid", "keys"), parts).groupBy("key", "component").agg(F.count("*").alias("n"))
    held = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).filter("n * n > same")
    held = stored(held.select("key", "n", F.expr("(n * n - same) div 2").alias("pairs")), "jaccard-open")
    return held, *held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()


def _sets(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, n, sketch, keys that others have too) from rows (key, sid)."""
    met = keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_met, "key long, sid long")
    return stored(met.groupBy("sid").agg(F.collect_list("key").alias("keys")).join(members.select("sid", "n", *SKETCH), "sid"), "jaccard-met")


def _rebrought(docs: DataFrame, rows: DataFrame, members: DataFrame, crowded: DataFrame, held: DataFrame) -> DataFrame:
    """``_sets`` after the keys of a bit set over ``crowded`` went to the end of the order that all sets share.

    Only sets that brought such a key bring others now; of the rest, the keys that were open or are brought anew take part.
    """
    packed, late = _bit_test(crowded.select(F.col("key").alias("hash")), probes=PROBES)
    marked = rows.filter("doc_id is not null and size(keys) > 0").withColumn("bits", packed.scalar())
    marked = marked.select("sid", "keys", F.exists("keys", late).alias("again"))
    orders = _candidates(docs, members, marked.filter("again").select("sid").distinct()).mapInArrow(_orders, "sid long, bring int, keys array<long>")
    order = F.concat(F.filter("keys", lambda x: ~late(x)), F.filter("keys", late))
    new = orders.withColumn("bits", packed.scalar()).select(F.slice(order, 1, F.col("bring")).alias("keys"), "sid")
    new = stored(new.select(F.explode("keys").alias("key"), "sid"), "jaccard-again")
    # a false bit only takes a row of two numbers along
    packed, wanted = _bit_test(new.select("key").union(held.select("key")).select(F.col("key").alias("hash")), 16)
    rest = marked.filter("not again").select(F.explode("keys").alias("key"), "sid").withColumn("bits", packed.scalar()).filter(wanted(F.col("key"))).drop("bits")
    return _sets(new.union(rest), members)


def _components_of(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component) over the links among the sets of ``rows``.

    In each round, the members of a part are tied to its first by rank: in half of the parts of the first round that is the
    member of the most shared parts, in the others one by a hash, in one of ``ORDERS`` orders that parts have in common. Parts
    that still hold over ``FEW`` pairs for each row then go to the end of the order, again and again while that halves the
    pairs. The last step takes all pairs of members in different components that sizes and sketches allow.
    """
    spark = docs.sparkSession
    sets = _sets(rows.select(F.explode("keys").alias("key"), "sid"), members)
    checked = spark.createDataFrame([], "a long, b long")
    parts = spark.createDataFrame([], "node long, component long")
    for k in range(ROUNDS):
        here = _exploded(sets.withColumn("n_keys", F.size("keys")), parts)
        if k:
            here = here.join(open_keys, "key", "left_semi")
        order = F.pmod("key", F.lit(ORDERS))
        rank = F.when((F.lit(k) == 0) & (order % 2 == 0), -F.col("n_keys")).otherwise(F.xxhash64("sid", order, F.lit(k)))
        here = here.select("key", "sid", "component", "n", *SKETCH, rank.alias("rank"))
        pairs = here.repartition("key").sortWithinPartitions("key", "rank", "sid").drop("rank").mapInArrow(_ties, "a long, b long")
        pairs = stored(pairs.distinct().join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        found = stored(_links(pairs, _texts_of(docs, members, pairs)), "jaccard-links")
        checked = checked.union(pairs)
        parts = stored(_merged(parts, found), "jaccard-parts")
        held, n_rows, n_pairs = _open(sets, parts)
        open_keys = held.select("key")
        if not n_rows:
            return parts
        if n_pairs <= FEW * n_rows or TEN * found.count() < n_rows:
            break
    crowded = held.filter(F.col("pairs") > FEW * F.col("n")).select("key")
    before = 2 * n_pairs
    while FEW * n_rows < n_pairs <= before // 2:
        before = n_pairs
        sets = _rebrought(docs, rows, members, crowded, held)
        held, n_rows, n_pairs = _open(sets, parts)
        crowded = stored(crowded.union(held.filter(F.col("pairs") > FEW * F.col("n")).select("key")).distinct(), "jaccard-crowded")
        open_keys = held.select("key")
    left = stored(_exploded(sets.select("sid", "keys"), parts).join(open_keys, "key", "left_semi"), "jaccard-left")
    held = sets.select("sid", "n", F.slice(F.sort_array("keys"), 1, LOW).alias("low")).join(members.select("sid", *WIDE), "sid")
    full = left.join(held, "sid")
    a, b = (full.select("key", *[F.col(c).alias(f"{side}_{c}") for c in full.columns if c != "key"]) for side in "ab")
    least = F.array_min(F.array_intersect("a_low", "b_low"))
    pairs = a.join(b, "key").filter("a_sid < b_sid and a_component <> b_component").filter(_allowed("a_", "b_")).filter(F.coalesce(least, "key") == F.col("key"))
    pairs = pairs.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct()
    pairs = stored(pairs.join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
    found = stored(_links(pairs, _texts_of(docs, members, pairs)), "jaccard-links")
    return parts if found.isEmpty() else _merged(parts, found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the smallest doc_id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    rows = stored(docs.mapInArrow(_members, MEMBER), "jaccard-members")
    members = rows.filter("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min_by("print", "doc_id").alias("print"), *[F.first(c).alias(c) for c in ("n", *SKETCH, *WIDE)])
    members = stored(members, "jaccard-sets")

    parts = _components_of(docs, rows, members)

    label = members.select("sid", "doc_id").join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "component").select("sid", "component_id")
    return rows.join(label, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller id; rows with a null id stay."""
    gone = jaccard_components(docs, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    #: stored, so that its size is known before the join is planned
    gone = stored(gone, "jaccard-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
