"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(LOWER)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def contamination(documents, benchmark, window=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = {}
    for item, text in benchmark:
        w = alnum_words(text)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in documents:
        w = alnum_words(text)
        hit, items = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    items |= found
                    hit[i:i + n] = [True] * n
        n_hit = sum(hit)
        out[doc] = (len(w), n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w))
    return out


def repeated_bytes(documents, size=400):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in documents]
    for _, b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i:i + size]] = seen.get(b[i:i + size], 0) + 1
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    w = space_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def components(documents, percent=80):
    """{doc_id: (n_shingles, component_id)}"""
    sets = [(d, shingles(t)) for d, t in documents]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (d, s) in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(d), root(sets[j][0])))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets}


def base_scores(documents, held_out):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    import math
    from collections import Counter

    tokens = {d: space_words(t) + [None] for d, t in documents}
    counts = Counter(w for d, ws in tokens.items() if not held_out(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for d, ws in tokens.items()}


def tail_repeated(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def word_runs(words, least=12):
    """[(start, length, period)] by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(documents):
    """{doc_id: (n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)}"""
    out = {}
    for doc, text in documents:
        words = tail_repeated(doc, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = word_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        n, s, q = min(((-n, s, q) for s, n, q in runs), default=(None, None, None))
        out[doc] = (len(runs), s, n and -n, q, n and 1000 * -n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def spellings(documents, fraction=199, length=6, least=5, factor=5):
    """{word: (n, n_near, form, form_n, root)}"""
    counts = {}
    for doc, text in documents:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if fraction and h % fraction == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    holes = {}  # words less one character, for speed only
    for w in counts:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes.setdefault(x, []).append(w)
    near = {w: {o for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for o in holes[x] if one_edit(w, o)} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}
