"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def find_roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def similar_pairs(sets):
    """Index pairs of Jaccard similarity of 0.8 or more, by shared members."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in holders[x]:
                seen[j] += 1
            holders[x].append(i)
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                yield j, i


def shingle_sets(texts):
    out = []
    for t in texts:
        w = SPACED.findall(ascii_lower(t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def ngram_components(rows):
    """rows: (doc_id, text) -> [(n_shingles, component_id)]"""
    sets = shingle_sets(t for _, t in rows)
    roots = find_roots(len(rows), similar_pairs(sets))
    low = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return [(len(s), low.get(r) if s else d) for (d, _), r, s in zip(rows, roots, sets)]


def kept_lines(rows):
    """rows: (doc_id, text) -> {(row, line number): (doc_id, line number) that is kept}"""
    norm, first = {}, {}
    for i, (d, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            line = line.strip(SPACE).lower()
            if line:
                norm[i, k] = line
                here = (d is not None, d or 0, k)
                first[line] = min(first.get(line, here), here)
    lines = list(first)
    sets = [{x[j : j + 5] for j in range(len(x) - 4)} or {x} for x in lines]
    roots = find_roots(len(lines), similar_pairs(sets))
    best = {}
    for x, r in zip(lines, roots):
        best[r] = min(best.get(r, first[x]), first[x])
    at = {x: best[r] for x, r in zip(lines, roots)}
    return {key: (at[x][1] if at[x][0] else None, at[x][2]) for key, x in norm.items()}


def windows(items, n=10):
    out = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(ascii_lower(text or ""))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            out[tuple(w[k : k + n])].add(name)
    return out


def leaks(text, phrases):
    """Word spans in characters, hit flags and items."""
    low = ascii_lower(text or "")
    found = list(ALNUM.finditer(low))
    w = [m.group() for m in found]
    hit, items = [False] * len(w), set()
    for n in {len(p) for p in phrases}:
        for k in range(len(w) - n + 1):
            names = phrases.get(tuple(w[k : k + n]))
            if names:
                items |= names
                hit[k : k + n] = [True] * n
    return found, hit, items


def without_leaks(text, phrases):
    found, hit, _ = leaks(text, phrases)
    out, upto, k = [], 0, 0
    while k < len(found):
        if hit[k]:
            j = k
            while j + 1 < len(found) and hit[j + 1]:
                j += 1
            out.append(text[upto : found[k].start()])
            upto, k = found[j].end(), j
        k += 1
    return "".join([*out, text[upto:]]), bool(found) and all(hit)


def quality(text):
    """Counts, verdicts and the cleaned text."""
    from stockline.llm.quality_rules import LINE_END, SEPARATORS, STOCK, SYMBOLS

    text = text or ""
    words = SPACED.findall(text)
    lines = text.split("\n")
    seen, dups = set(), 0
    for x in lines:
        if SPACED.search(x):
            dups += x in seen
            seen.add(x)
    tri = defaultdict(list)
    for k in range(len(words) - 2):
        tri[tuple(words[k : k + 3])].append(k)
    again = {p + j for ps in tri.values() if len(ps) > 1 for p in ps for j in range(3)}
    stay = []
    for x in lines:
        n = len(SPACED.findall(x))
        seps, shouts = sum(c in SEPARATORS for c in x), len(re.findall("!!", x))
        fails = (
            (seps >= 2 and seps * 4 >= n)
            or (bool(re.search(STOCK, x.lower())) and n <= 20)
            or (shouts >= 2 and shouts * 3 >= n)
            or (not re.search(LINE_END, x) and n < 4)
        )
        if n == 0 or not fails:
            stay.append(x)
    clean = "\n".join(stay)
    size = lambda t: sum(len(w) for w in SPACED.findall(t))
    bad = len(words) < 50 or 100 * len(again) > 50 * len(words)
    kept = not bad and (size(text) - size(clean)) * 100 <= size(text) * 50
    return len(words), size(text), sum(c in SYMBOLS for c in text), dups, len(again), bad, kept, clean


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted digests of op13."""
    import hashlib
    import zlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(*values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            first = i // 3 * 3
            yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
            i //= 3

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append(levels([x for x, _ in by[s]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (own, r) in enumerate(by[s]):
            d, text = r[0], r[4]
            hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None
            now, said = leaf(*r[:4], text.replace("\n", "")) if hit else own, []
            for a, b in [*path(trees[k], i), *path(top, k)]:
                said += [a, b]
                now = h(a, now, b)
            out.append((d, own, trees[k][-1][0], top[-1][0], h(*said), now, now == top[-1][0]))
    return sorted(out, key=str)


def good_vector(v, size=None):
    import math

    return v is not None and len(v) > 0 and (size is None or len(v) == size) and all(x is not None and math.isfinite(x) for x in v)


def kmeans(rows, k=40, rounds=5):
    """rows: (vec_id, embedding) -> sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)"""
    import hashlib
    import math

    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if good_vector(e, 64)]
    first = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in first[:k]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in v]

    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            mine = [x for (_, x), (_, a) in zip(v, at) if a == j]
            if mine:
                c[j] = [sum(t) // len(mine) for t in zip(*mine)]
    at = near()
    per = defaultdict(int)
    for d, j in at:
        per[j] += d
    names = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, per[j], sum(per.values()), names[j]) for (i, _), (d, j) in zip(v, at)), key=str)


def nearest(rows, step=20, k=20):
    """rows: (vec_id, embedding) -> {place of the query: [(score, vec_id)]} by brute force"""
    v = [(p, i, e) for p, (i, e) in enumerate(rows) if good_vector(e) and any(e)]
    out = {}
    for p, i, q in v:
        if i is not None and i % step == 0:
            got = []
            for o, j, e in v:
                if o != p and len(e) == len(q):
                    s = 0.0
                    for a, b in zip(q, e):
                        s += float(a) * float(b)
                    got.append((s, j))
            out[p] = sorted(got, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return out
