"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_stats(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def contamination(docs, items, window=13):
    """docs, items: (id, text). (id, n_words, n_hit, n_items, items_sha256, contaminated) for each document."""
    words = lambda t: ALNUM.findall((t or "").translate(_UPPER))
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wanted[tuple(w[k : k + m])].add(str(item))
    lengths = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if found := wanted.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    own |= found
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(data, length):
    """For each text which of its bytes are in a string of `length` bytes that is there twice or more."""
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def repeated_spans(docs, length=400):
    """docs: (id, text). (id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    data = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), b, gone in zip(docs, data, repeats(data, length)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(docs, length=240, words=51):
    """docs: (id, text). (id, n_passages, passage_bytes) for each document."""
    data = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), b, gone in zip(docs, data, repeats(data, length)):
        own = [m.span() for m in re.finditer(b"\1+", gone)]
        own = [(a, z) for a, z in own if len(b[a:z].split()) >= words]
        out.append((d, len(own), sum(z - a for a, z in own)))
    return out


def fingerprint(text):
    w = BLANK.findall((text or "").translate(_UPPER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def components(prints, most=2):
    """prints: (id, fingerprint). id -> smallest id reachable over pairs at `most` or fewer differing bits."""
    ids = [d for d, _ in prints]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= most:
                up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, d in enumerate(ids)}


def _word_pairs(text):
    w = ALNUM.findall(text.translate(_UPPER))
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def license_matches(text, templates, bodies, least=0.7):
    """(line, licence, dice) of a text: of every line and of the whole text the best template (ties by name); then, from the best down, runs of
    lines against templates and full texts. A run goes if it overlaps a better one, or has a line that matches the same licence or any at
    least as well; it is not told if the whole text matches the same licence."""
    known = [(name, _word_pairs(t)) for name, t in templates]
    more = known + [(name, _word_pairs(t)) for name, t in bodies]
    sizes = {id(v): v.total() for _, v in more}

    def dice(u, v):
        a, b = u.total(), sizes[id(v)]
        if not a or 2 * min(a, b) < least * (a + b):
            return 0.0
        return 2 * (u & v).total() / (a + b)

    lines = (text or "").split("\n")
    out = []
    for line, unit in [*enumerate(lines, 1)] + ([(0, text)] if len(lines) > 1 else []):
        u = _word_pairs(unit)
        score, name = min((-dice(u, v), name) for name, v in known)
        if -score >= least:
            out.append((line, name, -score))
    taken, whole = {line: (d, name) for line, name, d in out if line}, {name for line, name, _ in out if not line}
    runs = []
    for a in range(1, len(lines) + 1):
        for z in range(a, len(lines) + 1):
            u = _word_pairs("\n".join(lines[a - 1 : z]))
            runs += [(-d, z - a, a, name) for name, v in more if (d := dice(u, v)) >= least]
    used = set()
    for score, length, a, name in sorted(runs):
        own = range(a, a + length + 1)
        if used & {*own} or any(k in taken and (taken[k][1] == name or taken[k][0] >= -score) for k in own):
            continue
        used |= {*own}
        if name not in whole:
            out.append((a, name, -score))
    return out
