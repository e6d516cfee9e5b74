"""Plain-Python versions of the operators' contracts, over lists of rows."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window=13):
    """docs: (doc_id, text); items: (item_id, text)."""
    wins = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(window, len(w))
        for at in range(len(w) - k + 1) if k else ():
            wins.setdefault(tuple(w[at : at + k]), set()).add(str(name))
    sizes = {len(k) for k in wins}
    out = {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if (own := tuple(w[at : at + k])) in wins:
                    hit |= set(range(at, at + k))
                    names |= wins[own]
        out[doc] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def shingles(text, n=4):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(docs, n=4, num=85, den=100):
    """docs: (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for y, j in enumerate(ids):
        for i in ids[:y]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def substrings(docs, length=20):
    """docs: (doc_id, text) with distinct ids, in order."""
    seen, out = set(), {}
    for i, text in docs:
        w = SPACED.findall(text or "")
        gone = set()
        for at in range(len(w) - length + 1):
            own = tuple(w[at : at + length])
            if own in seen:
                gone |= set(range(at, at + length))
            seen.add(own)
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    from collections import Counter

    text = text or ""
    w = SPACED.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    repeat = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def targets(sizes, weights=(5, 2, 1), total=1.5, most=2):
    """sizes: {source: words} -> {source: target}, by reshared excess."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, out = total * sum(sizes.values()), list(names), {}
    while free:
        share = left / sum(weight[n] for n in free)
        over = [n for n in free if share * weight[n] > most * sizes[n]]
        if not over:
            out |= {n: share * weight[n] for n in free}
            break
        for n in over:
            out[n] = float(most * sizes[n])
            left -= out[n]
        free = [n for n in free if n not in over]
    return out


def mix(docs, seed="mix-2", weight=lambda i, size: max(1, int(size**0.5 * 1024)), **options):
    """docs: (doc_id, text, source) -> {index: copies}."""
    size = [len(SPACED.findall(t or "")) for _, t, _ in docs]
    sources = {}
    for n, (_, _, s) in zip(size, docs, strict=True):
        sources[s] = sources.get(s, 0) + n
    goal, out, seen = targets(sources, **options), {}, {}
    for source, total in sources.items():
        ratio = goal[source] / total if total else 0.0
        whole = int(ratio)
        rest = goal[source] - whole * total
        own = [i for i, (_, _, s) in enumerate(docs) if s == source and size[i]]
        w = {i: weight(i, size[i]) for i in own}
        certain: set = set()
        while True:
            free = [i for i in own if i not in certain]
            level = (rest - sum(size[i] for i in certain)) / sum(size[i] * w[i] for i in free) if free else 1.0
            if not (more := [i for i in free if level * w[i] >= 1]):
                break
            certain |= set(more)
        ranked = []
        for i in own:
            doc, text, _ = docs[i]
            digest = hashlib.md5((text or "").encode()).hexdigest()
            k = seen[doc, source, digest] = seen.get((doc, source, digest), -1) + 1
            u = (int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}:{digest}:{k}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
            p = min(1.0, level * w[i])
            q = 0.0 if p >= 1 else u / (1 - u) * ((1 - p) / p) if p > 0 else u / (1 - u)
            ranked.append((q, 2**63 - 1 if doc is None else doc, digest, k, i))
        run, had, picked, left = 0, 0, set(), []
        for unit in sorted(ranked):
            run += size[unit[4]]
            if run <= rest:
                picked.add(unit[4])
                had = run
            else:
                left.append(unit)
        best = min(((abs(rest - had - size[x[4]]), x) for x in left), default=None)
        if best and best[0] < rest - had:
            picked.add(best[1][4])
        for i in own:
            out[i] = whole + (i in picked)
    return {i: out.get(i, 0) for i in range(len(docs))}


def kneser_ney(trusted, order=4):
    """A function text -> perplexity, from the trusted texts of one language."""
    from collections import defaultdict
    from math import exp, log

    def marked(text):
        body = " ".join((text or "").split())
        return "\1" * (order - 1) + body + "\2" if body else ""

    counts = {order: defaultdict(int)}
    for text in trusted:
        t = marked(text)
        for i in range(order - 1, len(t)):
            counts[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = defaultdict(int)
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    discount, total, mass = {}, defaultdict(int), defaultdict(float)
    for n, own in counts.items():
        of = [sum(v == k for v in own.values()) for k in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] + of[1] else None
        for k in (1, 2, 3):
            d = k - (k + 1) * y * of[k] / of[k - 1] if y is not None and of[k - 1] else None
            discount[n, k] = d if d is not None and 0 < d < k else k / 2
        for gram, v in own.items():
            total[n, gram[:-1]] += v
            mass[n, gram[:-1]] += discount[n, min(v, 3)]

    def p(context, c):
        n = len(context) + 1
        below = p(context[1:], c) if context else 1 / (len(counts[1]) + 1)
        if (n, context) not in total:
            return below
        v = counts[n].get(context + c, 0)
        own = max(v - discount[n, min(v, 3)], 0.0) if v else 0.0
        return (own + mass[n, context] * below) / total[n, context]

    def perplexity(text):
        t = marked(text)
        logs = [log(p(t[i - order + 1 : i], t[i])) for i in range(order - 1, len(t))]
        return exp(-sum(logs) / len(logs)) if logs else None

    return perplexity


def _mixed(x):
    mask = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def gram_code(gram):
    """The number by which n-grams of equal count are ranked: of one letter, of a pair, of three (a blank is code point 0)."""
    points = [0 if c == " " else ord(c) for c in gram]
    if len(points) == 1:
        value = points[0] | 1 << 63
    elif len(points) == 2:
        value = points[0] << 21 | points[1]
    else:
        value = (points[0] << 42 | points[1] << 21 | points[2]) ^ 3 << 61
    return _mixed(value) & (1 << 44) - 1


def ranked_grams(texts, most):
    """The n-grams of the texts, most frequent first."""
    from collections import Counter

    seen = Counter()
    for text in texts:
        for word in "".join(c.lower() if c.isalpha() else " " for c in text or "").split():
            w = f" {word} "
            for i in range(1, len(w) - 1):
                seen.update([w[i], w[i : i + 2], w[i - 1 : i + 2]])
    return sorted(seen, key=lambda g: (-seen[g], gram_code(g)))[:most]


def language(docs, text, size=400, top=300):
    """docs: (text, lang) -> (language, score) of text."""
    names = sorted({x for t, x in docs if x is not None and ranked_grams([t], 1)})
    own = ranked_grams([text], top)
    if not own or not names:
        return "und", 0.0
    off = {}
    for name in names:
        place = {g: i for i, g in enumerate(ranked_grams([t for t, x in docs if x == name], size))}
        off[name] = sum(min(abs(i - place[g]), size) if g in place else size for i, g in enumerate(own))
    best = min(names, key=lambda x: (off[x], x))
    return best, 1 - off[best] / (len(own) * size)
