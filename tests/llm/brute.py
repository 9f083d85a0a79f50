"""Plain Python versions of the contracts, for small inputs. They share no code with the operators."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def spaced(text):
    return re.findall("[^ \t-\r]+", text or "")


def plain(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def warc(rows):
    """rows: (page_id, html)."""
    first = {}
    for i, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        lead = first[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == lead else "revisit", None if i == lead else lead))
    return sorted(out)


def decontaminate(docs, items, window=13):
    grams = defaultdict(set)
    for item, text in items:
        w = plain(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if w else 0):
            grams[tuple(w[i : i + m])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = plain(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in grams:
                    hit |= set(range(i, i + m))
                    ids |= grams[g]
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def shingles(text):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def line_dedup(docs, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(seen[key(x)]) >= least)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def base_secrets(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(SECRETS):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licenses(text):
    w = plain(text)
    at = [(i, x) for p, x in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def licenses(text, templates):
    """Labels of the templates that a regular expression finds in the words, each led by an underscore."""

    def regex(markup):
        out = ""
        for x in re.sub(r"([\[\]])", r" \1 ", markup).split():
            gap = re.fullmatch(r"\{(\d+),(\d+)\}", x)
            out += "(?:" if x == "[" else ")?" if x == "]" else f"(?:_[^_]+){{{gap[1]},{gap[2]}}}" if gap else f"_{x}"
        return out + "_"

    flat = "".join(f"_{w}" for w in plain(text)) + "_"
    return {label for label, many in templates.items() if any(re.search(regex(x), flat) for x in many)}


def suffix_dedup(docs, length=400):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(x[p : p + length] for _, x in raw for p in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return sorted(out)


def quality(text):
    w = spaced(text)
    t = text or ""
    lines = [x for x in t.split("\n") if spaced(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target}: shares by weight, what is over a bound reshared until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        level = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and level[s] > most * sizes[s]}
        if not over:
            return level
        full |= over


def _tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def _scores(token):
    """(length, log bin of the combined p-value, bin of the score against a written token) or None."""
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for regex, letters, sizes in (("[0-9a-f]+", digit + "abcdef", (10, 6)), ("[0-9A-F]+", digit + "ABCDEF", (10, 6)), ("[A-Z2-7]+=*", upper + "234567", (26, 6)), ("[A-Za-z0-9]+", upper + lower + digit, (26, 26, 10)), (".*", upper + lower + digit + "+/_-", (26, 26, 10, 4))):
        if re.fullmatch(regex, token):
            break
    x = token.rstrip("=")
    n, k = len(x), len(letters)
    if n < 2:
        return None
    chi, free = sum((c - n / k) ** 2 for c in [x.count(a) for a in letters]) / (n / k) if set(x) <= set(letters) else k / n * sum(c * c for c in Counter(x).values()) - n, k - 1
    chi_z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    kind = [1 if c in digit else 2 if c in upper else 3 if c in lower else 4 for c in x]
    changes, same = sum(a != b for a, b in zip(kind, kind[1:])), sum((s / k) ** 2 for s in sizes)
    code = [letters.find(c) + 1 for c in x]
    mean = sum(code) / n
    spread = sum((c - mean) ** 2 for c in code)
    serial = sum((a - mean) * (b - mean) for a, b in zip(code, code[1:])) / spread if spread else 1.0
    runs = (changes - (n - 1) * (1 - same)) / math.sqrt((n - 1) * same * (1 - same))
    m = min(_tail(chi_z) if chi_z > 0 else 1.0, 2 * _tail(abs(runs)), 2 * _tail(abs(serial * math.sqrt(n))))
    p = 1 - (1 - m) ** 3 if m > 1e-6 else 3 * m
    z = (changes - 0.5 - (n - 1) * 0.15) / math.sqrt((n - 1) * 0.15 * 0.85)
    return n, int(min(-math.log(max(p, 1e-300)), 40.0) / 0.1 + 1e-9), int(min(max(z, 0.0), 40.0) / 0.05 + 1e-9)


def secrets(docs):
    """{id: base and random spans}: in each band of lengths, two Benjamini-Hochberg rules over all free tokens."""
    base = {i: base_secrets(t) for i, t in docs}
    free = []
    for i, t in docs:
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
            if not any(a < m.end() and m.start() < b for _, a, b in base[i]) and (s := _scores(m[0])):
                free.append((i, m.start(), m.end(), sum(s[0] >= x for x in (32, 48, 80)), *s[1:]))
    out = {i: [(a, 0, b, kind) for kind, a, b in spans] for i, spans in base.items()}
    for band in range(4):
        here = [x for x in free if x[3] == band]
        dismissed = [g for g in range(401) if any(x[4] == g for x in here) and math.exp(-g * 0.1) * len(here) <= 0.01 * sum(x[4] >= g for x in here)]
        left = [x for x in here if not dismissed or x[4] < min(dismissed)]
        tail = lambda z: math.exp(-z * z / 2) / (z * math.sqrt(2 * math.pi)) if z >= 1 else 1.0
        passed = [g for g in range(801) if any(x[5] == g for x in here) and tail(g * 0.05) * len(here) <= 0.01 * sum(x[5] >= g for x in left)]
        for i, a, b, _, _, g in left:
            if passed and g >= min(passed):
                out[i].append((a, 3, b, "random"))
    return {i: [(kind, a, b) for a, _, b, kind in sorted(spans)] for i, spans in out.items()}


def xx(*values):
    """Spark's xxhash64: strings as bytes, (n,) as 4 bytes, n as 8."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def order_minhash(text, width=3, tuples=64):
    w = spaced(text)
    kmers = [xx(*w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [xx(" ".join(w))] if w else []
    if not kmers:
        return "0" * 4 * tuples
    seen, least = Counter(), {}
    for at, h in enumerate(kmers):
        v = xx(h, (seen[h],))
        seen[h] += 1
        least[(v >> 57) + 64] = min(least.get((v >> 57) + 64, (1 << 70, 0)), (v, at))
    n = 2 * tuples
    dense = [least[next(k % n for k in range(j, j + n) if k % n in least)] for j in range(n)]
    out = ""
    for a, b in zip(dense[:tuples], dense[tuples:]):
        p, q = (a, b) if a[1] <= b[1] else (b, a)
        out += f"{(xx(p[0], q[0]) % (1 << 64)) >> 48:04x}"
    return out


def alike(a, b, tuples=64):
    return sum(a[4 * i : 4 * i + 4] == b[4 * i : 4 * i + 4] for i in range(tuples)) / tuples


def fingerprints(docs):
    key = lambda d: (d[0] is not None, d[0] or 0, xx(d[1] or ""))
    order = sorted({key(d): d[1] or "" for d in docs}.items())
    after = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    out = []
    for d in docs:
        text, other = d[1] or "", after[key(d)]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b = order_minhash(text), order_minhash(edited)
        out.append((d[0], len(text), sha(edited), a, b, alike(a, b), alike(a, order_minhash(other))))
    return out


def divergences(docs, min_docs=3, most_rank=200):
    """docs: (text, lang, source)."""
    read = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER)), x or "", s or "") for t, x, s in docs]
    out = []
    for lang in {x for _, x, _ in read}:
        here = [(w, s) for w, x, s in read if x == lang]
        df = Counter(t for w, _ in here for t in set(w))
        kept = {t for t in df if df[t] >= min_docs}
        counts = {s: Counter() for _, s in here}
        for w, s in here:
            counts[s].update(t for t in w if t in kept)
        share = lambda c, t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        q = {t: share(whole, t) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, most_rank)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def damage(rows):
    """rows: (conv_id, turn, role, text)."""
    said = lambda v: " " if v is None else str(v)
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _repair(rows):
    """rows: (turn, role, text) in order. Back from the end, the least (cost, audit) for each role read last."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    legal, name = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}, {"u": "user", "a": "assistant"}
    given = {x: "a" if x == "u" else "u" for x in ("", "s", "u", "a")}
    after = {}
    for i in range(len(rows), -1, -1):
        ways = {x: [] for x in given}
        for x in given:
            step = lambda to, cost, letter, line, x=x: ways[x].append((cost + after[to][0], letter + after[to][1], (line, after[to][2]) if line else after[to][2]))
            if i == len(rows):
                ways[x] += [(0, "", ())] * (x in ("", "a"))
                continue
            _, role, text = rows[i]
            step(x, 2, "D", None)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if (x, role[:1]) in legal:
                    step(role[:1], more, "K", f"{role}:{text}")
                step(given[x], 1 + more, "R", f"{name[given[x]]}:{text}")
        now = {x: min(w, key=lambda v: v[:2]) for x, w in ways.items() if w}
        for _ in range(3):
            for x, to in given.items():
                if to in now:
                    way = (5 + now[to][0], "I" + now[to][1], (f"{name[to]}:", now[to][2]))
                    now[x] = min(now.get(x, way), way, key=lambda v: v[:2])
        after = now
    cost, audit, chain = after[""]
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    turns = {t for t, _, _ in rows} - {None}
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


def conversations(rows, hurt=True):
    by = defaultdict(list)
    for c, t, role, text in damage(rows) if hurt else rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    return [(c, *(_repair(sorted(by[c], key=order)) if by[c] else (0, 0, 0, 0, 0, 0, "", sha("")))) for c in {r[0] for r in rows}]
