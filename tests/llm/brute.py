"""Plain Python versions of the operators, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(lower(text))


def base_scores(rows):
    """[(held_out, n_tokens, n_known, N, base)] of [(doc_id, text)]."""
    tokens = [words(t) + [0] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t)) for t, h in zip(tokens, held)]


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
    return (*counts, len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def shingles(text, width=3):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_classes(rows, percent=90, width=3):
    """Index of the class of every row."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and n and 100 * n >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(rows))]


def smallest_ids(rows, classes):
    best = defaultdict(list)
    for (i, _), c in zip(rows, classes):
        if i is not None:
            best[c].append(i)
    return [min(best[c]) if best[c] else None for c in classes]


def contamination(text, items, width=13):
    """(n_words, n_hit, n_items, digest, contaminated) with items [(item_id, text)]."""
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            got = windows.get(tuple(w[k : k + size]))
            if got:
                hit |= set(range(k, k + size))
                found |= got
    names = sorted(map(str, found))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target per source of {source: words}: shares by weight, the excess over a cap dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = goal - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return got | fixed
        fixed |= {s: float(most * sizes[s]) for s in over}


def edit_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def planted_runs(doc_id, text):
    """Words of a text after the contract's repeats."""
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def runs_of(w, least=12):
    """[(start, length, period)]: maximal stretches with smallest period q of max(least, 2q) words or more."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_row(doc_id, w):
    runs = runs_of(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def spelling_counts(rows, planted=True, least=7):
    n = Counter()
    for i, t in rows:
        for w in RUNS.findall(t or ""):
            w = lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if planted and i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def spelling_rows(n):
    """[(word, form, root, n, n_near, form_n)]: words without one place are buckets, their members are compared in full."""
    buckets = defaultdict(set)
    for w in n:
        buckets[w].add(w)
        for k in range(len(w)):
            buckets[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in buckets.values():
        for a in group:
            near[a] |= {b for b in group if a != b and edit_distance(a, b) == 1}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out
