"""Secret scans with built-in functions only: fixed patterns, and a randomness test battery over the other long tokens.

Patterns are found by splitting the text at them: the lengths of the pieces and matches give the places. The battery looks
at tokens of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that no pattern covers. Each token's encoding is inferred (hex of
either case, base 32, base 62, base 64) and three tests are made with that alphabet: chi-squared uniformity of the
characters, the number of runs of character classes, and the serial correlation of neighbouring code values. Their three
p-values are combined (the smallest, with Sidak's correction), and in each band of lengths the Benjamini-Hochberg rule at
``MISSED`` over all tokens of the corpus dismisses those that aren't random: of the dismissed, that share at most is random.
What stays is a candidate. Against it stands the hypothesis of a written token, whose class changes at a rate of at most
``WRITTEN`` between neighbours: the number of changes gives a z score that short tokens can't raise far. The same rule at
``RATE``, again by band, sets the score from which candidates are spans. Both scores are
counted in bins, a table of bounded size, whatever the corpus. Tokens of one character before their padding aren't tested.

Null texts are empty. Rows are judged one by one, so ids may repeat or be null. Matches are placed and compared in chunks of
``CHUNK``, so a text's cost grows with its length and its matches, plus the square of its number of chunks. One row per document is stored between the two steps, without texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import bound_to, stored


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed values.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
PATTERNS = (
    Pattern("assign", "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", "[0-9a-f]+", 0, 24),
)
TOKEN = Pattern("random", "[A-Za-z0-9+/_=-]{20,}", 0, 20)
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern of the whole token, alphabet, sizes of its character classes)
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef", (10, 6)),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF", (10, 6)),
    ("^[A-Z2-7]+=*$", UPPERS + "234567", (26, 6)),
    ("^[A-Za-z0-9]+$", UPPERS + LOWERS + DIGITS, (26, 26, 10)),
    ("^[A-Za-z0-9+/_-]+=*$", UPPERS + LOWERS + DIGITS + "+/_-", (26, 26, 10, 4)),
)
BANDS = (20, 32, 48, 80)
MISSED, WRITTEN, RATE = 0.01, 0.15, 0.01
BIN, MOST_Z = 0.05, 40.0
LOG_BIN, MOST_LOG = 0.1, 40.0
CHUNK = 256


def _chunks(values: Column) -> Column:
    """``values`` cut into arrays of up to ``CHUNK``."""
    return bound_to(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice(v, k + 1, CHUNK)))


def _match_spans(text: Column, p: Pattern) -> Column:
    """Array of (start, end, kind, token) in code points, for the matches whose group is long enough."""

    def walk(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(p.regex), F.lit(0))
        value = F.regexp_extract_all(t, F.lit(p.regex), F.lit(p.group)) if p.group else whole
        pieces = F.arrays_zip(F.transform(F.split(t, p.regex, -1), F.length).alias("gap"), whole.alias("whole"), F.transform(value, F.length).alias("long"))
        pieces = F.filter(pieces, lambda x: x["whole"].isNotNull())
        empty = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            end = start + F.length(x["whole"])
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(p.kind).alias("kind"), F.when(F.lit(p.kind == TOKEN.kind), x["whole"]).alias("token"))
            return F.struct(end.alias("at"), F.when(x["long"] >= p.least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

        def placed(chunks: Column) -> Column:
            """Each chunk's spans from where the chunk starts, so that no array grows with all the matches."""
            sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["whole"])))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            starts = F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
            both = F.arrays_zip(starts.alias("at"), chunks.alias("pieces"))
            return F.flatten(F.transform(both, lambda c: F.aggregate(c["pieces"], F.struct(c["at"].alias("at"), empty.alias("spans")), step, lambda a: a["spans"])))

        return bound_to(_chunks(pieces), placed)

    empty = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")
    #: what must occur for the pattern to match with a group long enough
    needed = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}.get(p.kind, p.regex)
    return bound_to(text, lambda t: F.when(t.rlike(needed), walk(t)).otherwise(empty))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, within 1e-7 (a standard polynomial approximation)."""
    t = 1 / (1 + z * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _two_sided(z: Column) -> Column:
    return 2 * _normal_tail(F.abs(z))


def _battery(token: Column) -> Column:
    """Struct (length, z, p): the score against a written token, and the combined p-value of randomness."""
    alphabet = F.lit(ENCODINGS[-1][1])
    classes = F.array(*[F.lit(float(x)) for x in ENCODINGS[-1][2]])
    for regex, letters, sizes in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(regex), letters).otherwise(alphabet)
        classes = F.when(token.rlike(regex), F.array(*[F.lit(float(x)) for x in sizes])).otherwise(classes)

    def tests(x: Column) -> Column:
        chars, letters, sizes = x["chars"], x["letters"], x["sizes"]
        n, k = F.size(chars).cast("double"), F.length(letters).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(chars, lambda y: y == c)).cast("double"), F.lit(2.0)))
        chi, free = k / n * squares - n, k - 1
        chi_z = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        kind = F.transform(chars, lambda c: F.when(c.between("0", "9"), 1).when(c.between("A", "Z"), 2).when(c.between("a", "z"), 3).otherwise(4))
        codes = F.transform(chars, lambda c: F.call_function("locate", c, letters).cast("double"))
        pairs = F.sequence(F.lit(1), F.size(chars) - 1)
        changes = bound_to(kind, lambda q: F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when(F.get(q, i) != F.get(q, i - 1), 1.0).otherwise(0.0)))
        same = F.aggregate(sizes, F.lit(0.0), lambda a, s: a + F.pow(s / k, F.lit(2.0)))

        def serial(q: Column) -> Column:
            mean = F.aggregate(q, F.lit(0.0), lambda a, v: a + v) / n
            return bound_to(mean, lambda m: F.try_divide(
                F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.get(q, i) - m) * (F.get(q, i - 1) - m)),
                F.aggregate(q, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)),
            ))

        z_serial = F.coalesce(bound_to(codes, serial), F.lit(1.0)) * F.sqrt(n)
        least = lambda c: F.least(
            F.when(chi_z > 0, _normal_tail(chi_z)).otherwise(1.0),
            _two_sided((c - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same))),
            _two_sided(z_serial),
        )
        return bound_to(F.struct(changes.alias("c"), bound_to(changes, least).alias("m")), lambda v: F.struct(
            n.alias("length"),
            ((v["c"] - 0.5 - (n - 1) * WRITTEN) / F.sqrt((n - 1) * WRITTEN * (1 - WRITTEN))).alias("z"),
            F.least(v["m"] * (3 - 3 * v["m"] + v["m"] * v["m"]), F.lit(1.0)).alias("p"),
        ))

    bare = F.regexp_replace(token, "=+$", "")
    none = F.struct(F.lit(0.0).alias("length"), F.lit(0.0).alias("z"), F.lit(0.0).alias("p"))
    return bound_to(
        F.struct(F.split(bare, "").alias("chars"), alphabet.alias("letters"), classes.alias("sizes")),
        lambda x: F.when(F.size(x["chars"]) > 1, tests(x)).otherwise(none),
    )


def _band(length: Column) -> Column:
    return sum((F.when(length >= x, 1).otherwise(0) for x in BANDS[1:]), F.lit(0))


def _bin(z: Column) -> Column:
    return F.floor(F.least(F.greatest(z, F.lit(0.0)), F.lit(MOST_Z)) / BIN).cast("long")


def _log_bin(p: Column) -> Column:
    return F.floor(F.least(-F.log(F.greatest(p, F.lit(1e-300))), F.lit(MOST_LOG)) / LOG_BIN).cast("long")


def score_bounds(found: DataFrame) -> DataFrame:
    """One row: ``bounds``, by band of lengths the log bin from which tokens are dismissed and the least score bin of a span.

    Where none is, the bin is beyond all.
    """
    tokens = found.select(F.explode("tokens").alias("t")).filter(F.col("t")["length"] > 0)
    cells = tokens.groupBy(_band(F.col("t")["length"]).alias("band"), _log_bin(F.col("t")["p"]).alias("log"), _bin(F.col("t")["z"]).alias("bin")).agg(F.count("*").alias("n"))
    band, by_log, by_bin = (W.partitionBy("band"), *(W.partitionBy("band").orderBy(F.col(x).desc()) for x in ("log", "bin")))
    cells = cells.select("*", F.sum("n").over(band).alias("all"), F.sum("n").over(by_log).alias("over"))
    #: the largest p-value of the bin
    cells = cells.select("*", F.exp(-F.col("log") * LOG_BIN).alias("p"))
    cells = cells.withColumn("least_log", F.coalesce(F.min(F.when(F.col("p") * F.col("all") <= F.col("over") * MISSED, F.col("log"))).over(band), F.lit(int(MOST_LOG / LOG_BIN) + 1)))
    cells = cells.withColumn("random", F.sum(F.when(F.col("log") < F.col("least_log"), F.col("n")).otherwise(0)).over(by_bin))
    #: an upper bound of the normal tail at the bin's lower edge
    z = F.col("bin") * BIN
    tail = F.when(z >= 1, F.exp(-z * z / 2) / (z * math.sqrt(2 * math.pi))).otherwise(1.0)
    by = cells.groupBy("band").agg(
        F.max("least_log").cast("long").alias("log"),
        F.coalesce(F.min(F.when(tail * F.col("all") <= F.col("random") * RATE, F.col("bin"))), F.lit(int(MOST_Z / BIN) + 1)).cast("long").alias("bin"),
    )
    return by.agg(F.array(*[F.max(F.when(F.col("band") == k, F.struct("log", "bin"))) for k in range(len(BANDS))]).alias("bounds"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row: arrays of (start, end, kind), the second with the battery's spans as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = {p.kind: k for k, p in enumerate((*PATTERNS, TOKEN))}
    found = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    found = found.select("id", F.concat(*[_match_spans(F.col("t"), p) for p in PATTERNS]).alias("base"), _match_spans(F.col("t"), TOKEN).alias("tokens"))

    def apart(x: Column) -> Column:
        meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])

        def alone(c: Column) -> Column:
            """A chunk's tokens that no base span meets; only the base spans in the chunk's stretch are looked at."""
            stretch = F.struct(F.get(c, 0)["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"))
            near = bound_to(stretch, lambda s: F.filter(x["base"], lambda b: meets(s, b)))
            return bound_to(near, lambda n: F.filter(c, lambda t: ~F.exists(n, lambda b: meets(t, b))))

        free = F.when(F.size(x["tokens"]) > 0, F.flatten(F.transform(_chunks(x["tokens"]), alone))).otherwise(x["tokens"])
        scored = F.transform(free, lambda t: bound_to(_battery(t["token"]), lambda s: F.struct(t["start"].alias("start"), t["end"].alias("end"), s["length"].alias("length"), s["z"].alias("z"), s["p"].alias("p"))))
        return F.struct(x["base"].alias("base"), scored.alias("tokens"))

    found = found.select("id", bound_to(F.struct("base", "tokens"), apart).alias("x")).select("id", "x.base", "x.tokens")
    found = stored(found, "secrets")
    found = found.select("id", "base", "tokens", score_bounds(found).scalar().alias("bounds"))
    bound = lambda t: F.get("bounds", _band(t["length"]))
    new = F.filter("tokens", lambda t: (t["length"] > 0) & (_log_bin(t["p"]) < bound(t)["log"]) & (_bin(t["z"]) >= bound(t)["bin"]))
    spans = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.transform(new, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(TOKEN.kind).alias("kind")))

    def ordered(a: Column) -> Column:
        number = lambda s: sum((F.when(s["kind"] == k, n).otherwise(0) for k, n in rank.items()), F.lit(0))
        keyed = F.transform(a, lambda s: F.struct(s["start"].alias("start"), number(s).alias("number"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    return found.select(F.col("id").alias(id_col), ordered(spans(F.col("base"))).alias("base"), ordered(F.concat(spans(F.col("base")), added)).alias("spans"))


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
