"""DuckDB SQL for the queries of the text operators that SQL can express.

The statements are written from the contracts, not from the operators: they use plain joins and grouping.
"""

from __future__ import annotations

import math
import re

from tracelake.llm.common import LOWER, PLAIN_WORD, SPACED_WORD, UPPER
from tracelake.llm.license_scan import PHRASES, TEMPLATES
from tracelake.llm.mixing import MOST, SEED, WEIGHTS
from tracelake.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS
from tracelake.llm.secret_scan import BANDS, BIN, ENCODINGS, LOG_BIN, MISSED, MOST_LOG, MOST_Z, PATTERNS, RATE, TOKEN, WRITTEN

_SPACED = SPACED_WORD.replace("\\x20", " ")
_PLAIN = PLAIN_WORD
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def op3(docs: str = "documents") -> str:
    return f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM {docs}),
bw AS (SELECT item_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM grams),
win AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS gram
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hits AS (SELECT DISTINCT a.doc_id, a.i, a.m, g.item_id FROM win a JOIN grams g USING (m, gram)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _broken(rules) -> str:
    one = lambda r: f"(n_words >= {r.least} AND {r.scale} * {r.part} {r.beyond} {r.bound} * {'1' if r.whole == 'one' else r.whole})"
    return "(" + " OR ".join(map(one, rules)) + ")"


def op5(docs: str = "documents") -> str:
    removed = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACED}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, 1 AS one, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        ({removed(SYMBOLS)})::BIGINT AS n_symbols, ({removed('!')})::BIGINT AS n_exclamations, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: list_contains({_list(STOP_WORDS)}, translate(translate(x, '{UPPER}', '{LOWER}'), '.,;:!?', '')))) AS n_stop_words
      FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT {_broken(RULES)} AS kept
FROM m"""


_TAKEN = "size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken"


def op9(docs: str = "documents", taken: str = _TAKEN) -> str:
    return f"""
WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS print, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size FROM {docs}),
b AS (SELECT source, sum(size)::BIGINT AS source_size, {_list(WEIGHTS).replace("'", "")}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::BIGINT AS weight FROM s GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY ({MOST} * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST) AS k FROM b),
f AS (SELECT o.*, (SELECT sum(source_size) FROM o) - coalesce(sum({MOST} * source_size) OVER before, 0) AS left_size,
        (SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER before, 0) AS left_weight
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(left_size, k) AS ls, arg_min(left_weight, k) AS lw, min(k) AS k FROM f WHERE weight * left_size < {MOST} * source_size * left_weight),
t AS (SELECT f.source, source_size, CASE WHEN f.k >= level.k THEN (weight * ls)::DOUBLE / lw::DOUBLE ELSE ({MOST} * source_size)::DOUBLE END AS target FROM f CROSS JOIN level),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || print), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, {taken} FROM r"""


def op2() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letter = lambda k: f"'{alphabet}'[1 + ((v >> {k}) & 31)]"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INT), lambda v: {" || ".join(letter(k) for k in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""


def op4(docs: str = "documents") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _kept_lines(docs: str) -> str:
    """CTEs ending in kept (doc_id, n_lines, n_dropped, kept)."""
    return f"""
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM {docs})),
k AS (SELECT *, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '') AS kept
         FROM k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id)"""


def op6(docs: str = "documents") -> str:
    return f"WITH {_kept_lines(docs)} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept"


def op10(docs: str = "documents", length: int = 400) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {docs}),
win AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, {2 * length})) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {length} + 1)) AS p FROM d WHERE n >= {length})),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
isle AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k
         FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS new FROM rep)),
span AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS b FROM isle GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
        UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY 1) r USING (doc_id)"""


def _found(pattern, k: int, docs: str) -> str:
    """Matches with their places: (doc_id, number, kind, start, end, token)."""
    regex = pattern.regex.replace("'", "''")
    return f"""SELECT doc_id, {k} AS number, '{pattern.kind}' AS kind, p[i] AS start, p[i] + length(whole[i]) AS stop, whole[i] AS token, length(value[i]) AS long FROM (
  SELECT *, list_transform(range(1, len(whole) + 1), lambda i: list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0))::INT[] AS p, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}') AS whole, regexp_extract_all(t, '{regex}', {pattern.group}) AS value FROM {docs}))"""


def _tail(z: str) -> str:
    t = f"(1 / (1 + {z} * 0.2316419))"
    return f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"


def op7(docs: str = "documents") -> str:
    encoded = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(token, '{x[0]}') THEN {f(x)}" for x in ENCODINGS[:-1]) + f" ELSE {f(ENCODINGS[-1])} END"
    band = " + ".join(f"(n >= {x})::INT" for x in BANDS[1:])
    pairs = "range(2, len(ch) + 1)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
hits AS ({" UNION ALL ".join(f"SELECT * FROM ({_found(p, k, 'd')}) WHERE long >= {p.least}" for k, p in enumerate(PATTERNS))}),
toks AS (SELECT * FROM ({_found(TOKEN, len(PATTERNS), "d")}) x WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop)),
c AS (SELECT *, regexp_split_to_array(regexp_replace(token, '=+$', ''), '') AS ch, {encoded(lambda x: "'" + x[1] + "'")} AS letters, {encoded(lambda x: str([float(y) for y in x[2]]))} AS sizes FROM toks WHERE length(regexp_replace(token, '=+$', '')) > 1),
e AS (SELECT *, len(ch)::DOUBLE AS n, length(letters)::DOUBLE AS k, list_transform(ch, lambda x: instr(letters, x)::DOUBLE) AS code,
  list_transform(ch, lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN 1 WHEN x BETWEEN 'A' AND 'Z' THEN 2 WHEN x BETWEEN 'a' AND 'z' THEN 3 ELSE 4 END) AS cls FROM c),
f AS (SELECT *, k / n * list_sum(list_transform(list_distinct(ch), lambda x: pow(len(list_filter(ch, lambda y: y = x)), 2))) - n AS chi, list_sum(list_transform({pairs}, lambda i: (cls[i] <> cls[i - 1])::INT))::DOUBLE AS changes,
  list_sum(list_transform(sizes, lambda x: pow(x / k, 2))) AS same, list_sum(code) / n AS mean FROM e),
g AS (SELECT *, (pow(chi / (k - 1), {1 / 3!r}) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS chi_z,
  coalesce(list_sum(list_transform({pairs}, lambda i: (code[i] - mean) * (code[i - 1] - mean))) / nullif(list_sum(list_transform(code, lambda x: (x - mean) * (x - mean))), 0), 1.0) * sqrt(n) AS serial_z,
  abs((changes - (n - 1) * (1 - same)) / sqrt((n - 1) * same * (1 - same))) AS runs_z, (changes - 0.5 - (n - 1) * {WRITTEN}) / sqrt((n - 1) * {WRITTEN * (1 - WRITTEN)!r}) AS z FROM f),
h AS (SELECT *, {band} AS band, floor(least(greatest(z, 0.0), {MOST_Z}) / {BIN})::BIGINT AS bin,
  least(CASE WHEN chi_z > 0 THEN {_tail("chi_z")} ELSE 1.0 END, 2 * {_tail("runs_z")}, 2 * {_tail("abs(serial_z)")}) AS m FROM g),
hb AS (SELECT *, floor(least(-ln(greatest(least(m * (3 - 3 * m + m * m), 1.0), 1e-300)), {MOST_LOG}) / {LOG_BIN})::BIGINT AS log_ FROM h),
lg AS (SELECT band, log_, sum(count(*)) OVER (PARTITION BY band ORDER BY log_ DESC) AS over_, sum(count(*)) OVER (PARTITION BY band) AS all_ FROM hb GROUP BY 1, 2),
dis AS (SELECT band, coalesce(min(log_) FILTER (exp(-log_ * {LOG_BIN}) * all_ <= over_ * {MISSED}), {int(MOST_LOG / LOG_BIN) + 1}) AS least_log FROM lg GROUP BY 1),
cnt AS (SELECT band, bin, count(*) AS n, count(*) FILTER (log_ < least_log) AS r FROM hb JOIN dis USING (band) GROUP BY 1, 2),
ov AS (SELECT band, bin, sum(r) OVER (PARTITION BY band ORDER BY bin DESC) AS over_, sum(n) OVER (PARTITION BY band) AS all_ FROM cnt),
least_ AS (SELECT band, min(bin) AS least_bin FROM ov WHERE (CASE WHEN bin * {BIN} >= 1 THEN exp(-(bin * {BIN}) * (bin * {BIN}) / 2) / (bin * {BIN} * {math.sqrt(2 * math.pi)!r}) ELSE 1.0 END) * all_ <= over_ * {RATE} GROUP BY band),
spans AS (SELECT doc_id, number, kind, start, stop, TRUE AS base FROM hits UNION ALL SELECT doc_id, number, kind, start, stop, FALSE FROM hb JOIN dis USING (band) JOIN least_ USING (band) WHERE log_ < least_log AND bin >= least_bin),
j AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{p.kind}') AS n_{p.kind}" for p in PATTERNS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number, stop) FILTER (base) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number, stop) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in PATTERNS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


def _markup_pattern(markup: str) -> str:
    """A template as a regular expression over words that are each led by a space."""
    parts = {"[": "(?:", "]": ")?"}
    items = re.findall(r"\[|\]|\{\d+,\d+\}|[^\s\[\]{}]+", markup)
    return "".join(parts.get(x) or (f"(?: [^ ]+){x}" if x[0] == "{" else f" {x}") for x in items) + " "


def op8(docs: str = "documents") -> str:
    places = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {same}), lambda i: {{'i': i - 1, 'label': '{label}'}})")
    labels = [f"CASE WHEN regexp_matches(j, '{'|'.join(map(_markup_pattern, many))}') THEN '{label}' END" for label, many in TEMPLATES.items()]
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN}') AS w FROM {docs}),
p AS (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS j, list_concat({", ".join(places)}) AS at_ FROM d),
l AS (SELECT *, list_distinct(list_transform(at_, lambda x: x.label)) AS base, list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS own FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(at_)::BIGINT AS n_base, list_min(list_transform(at_, lambda x: x.i))::BIGINT AS first_word, list_max(list_transform(at_, lambda x: x.i))::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(at_) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l"""


def op12(docs: str = "documents") -> str:
    share = lambda n, size: f"(1 + 1000000000 * ({n}::HUGEINT + 1) // ({size} + v))"
    excess = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // {q})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS t FROM {docs}),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "size")} AS p FROM g JOIN kept USING (lang) JOIN size USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(size)::HUGEINT AS size FROM size GROUP BY 1),
q AS (SELECT lang, term, {share("n", "size")} AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2) JOIN l USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum({excess("x.p", "y.p")}) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, {excess("p", "q")}::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


def op13() -> str:
    said = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    given = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    line = lambda role: f"chr(10) || '{name[role]}:'"
    #: rows put in before one that is read: none, one or two
    pre = [(s, s, 0, "", "''") for s in given] + [(s, given[s], 5, "I", line(given[s])) for s in given] + [(s, given[given[s]], 10, "II", f"{line(given[s])} || {line(given[given[s]])}") for s in given]
    pre = ", ".join(f"('{s}', '{to}', {cost}, '{audit}', {text})" for s, to, cost, audit, text in pre)
    ways = [(s, "*", s, 2, "D", "") for s in given] + [(s, c, c, 0, "K", "") for s, c in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))] + [(s, "*", given[s], 1, "R", name[given[s]]) for s in given]
    ways = ", ".join(str(x) for x in ways)
    return f"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
k AS (SELECT conv_id, turn, {said("role")} AS role, {said("text")} AS text,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({said("conv_id")} || ':' || {said("turn")}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(crcs[1 + (xor(c, b) & 255)], c >> 8))) % 20 AS kind
      FROM conversations, crcs),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {_SPACE_SQL}) AS t FROM d),
e AS (SELECT *, left(role, 1) AS init, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
m AS (SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au') AS illegal FROM e),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM m GROUP BY 1),
pre(s, mid, cost, audit, said) AS (VALUES {pre}),
ways(s, init, nxt, cost, audit, role) AS (VALUES {ways}),
f AS (SELECT conv_id, 0::BIGINT AS i, '' AS s, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS best FROM stats
      UNION ALL
      SELECT f.conv_id, f.i + 1, nxt, min({{'cost': best.cost + pre.cost + ways.cost + CASE WHEN fault = 'truncated' AND ways.audit <> 'D' THEN 5 ELSE 0 END, 'audit': best.audit || pre.audit || ways.audit,
          'said': best.said || pre.said || CASE WHEN ways.audit = 'D' THEN '' ELSE chr(10) || CASE WHEN ways.audit = 'K' THEN e.role ELSE ways.role END || ':' || e.text END}})
      FROM f JOIN e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i + 1 JOIN pre ON pre.s = f.s JOIN ways ON ways.s = pre.mid AND ways.init IN ('*', e.init) AND (ways.audit = 'D' OR fault NOT IN ('blank', 'duplicate'))
      GROUP BY f.conv_id, f.i, nxt),
last AS (SELECT f.conv_id, min({{'cost': best.cost + pre.cost, 'audit': best.audit || pre.audit, 'said': best.said || pre.said}}) AS best FROM f JOIN stats ON stats.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = n JOIN pre ON pre.s = f.s AND pre.mid IN ('', 'a') GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM a.conv_id"""


def pipeline() -> str:
    """The five stages, one after another; each stage's text and numbers come from the one before."""
    return f"""
WITH RECURSIVE q AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({op5()}) j USING (doc_id) WHERE j.kept),
ll AS MATERIALIZED (WITH {_kept_lines("q")} SELECT q.doc_id, kept AS text, lang, source, length(kept)::BIGINT AS n_chars FROM q JOIN kept USING (doc_id)),
nd AS MATERIALIZED (SELECT ll.* FROM ll JOIN ({op4("ll")}) c USING (doc_id) WHERE c.component_id = doc_id),
dc AS MATERIALIZED (SELECT nd.* FROM nd JOIN ({op3("nd")}) c USING (doc_id) WHERE NOT c.contaminated),
mx AS MATERIALIZED ({op9("dc", taken="floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies")})
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM dc JOIN mx USING (doc_id) WHERE copies > 0"""


ORACLE_SQL = {
    "op2_warc": op2(),
    "op3_decontaminate": op3(),
    "op4_jaccard_join": op4(),
    "op5_quality_rules": op5(),
    "op6_line_dedup": op6(),
    "op7_secret_scan": op7(),
    "op8_license_scan": op8(),
    "op9_mixing": op9(),
    "op10_suffix_dedup": op10(),
    "op12_source_audit": op12(),
    "op13_conversation_repair": op13(),
}
