"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, width=13):
    """doc_id -> (words, removed, kept text)."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, shingle=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash(docs, bits=3):
    """doc_id -> (fingerprint, component)."""
    marks = {i: fingerprint(t) for i, t in docs}
    by = defaultdict(list)
    for i, f in marks.items():
        by[f].append(i)
    fps = np.array(list(by), dtype=np.uint64)
    links = [(min(v), x) for v in by.values() for x in v]
    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ f) <= bits):
            links.append((by[int(f)][0], by[int(fps[k + 1 + j])][0]))
    comp = roots(list(marks), links)
    return {i: (f"{marks[i]:016x}", comp[i]) for i in marks}


def similar(docs, width=5, similarity=0.8):
    """doc_id -> component, by the Jaccard similarity of sets of shingles."""
    words = {i: tuple(WORD.findall(lower(t))) for i, t in docs}
    sets = {i: {w[k : k + width] for k in range(max(1, len(w) - width + 1))} for i, w in words.items()}
    ids, links = list(sets), []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links.append((i, j))
    return roots(ids, links)


def url_tree(urls, min_share, min_urls, similar, prior):
    """(template, labels of its own, purity) of each (host, path, label): label 1 is blocked, 0 allowed, None unknown."""
    known = [x for _, _, x in urls if x is not None]
    overall = sum(known) / len(known) if known else 0.0
    out = [None] * len(urls)

    def grow(rows, level, template, above):
        deeper, ended = defaultdict(list), []
        for k in rows:
            segments = [s.replace("*", "%2A").replace("|", "%7C") for s in urls[k][1].split("/") if s]
            if len(segments) > level:
                deeper[segments[level]].append(k)
            else:
                ended.append(k)
        total, kids = sum(map(len, deeper.values())), defaultdict(list)
        if total < min_urls:
            ended, deeper = rows, {}
        labels = [urls[k][2] for k in ended if urls[k][2] is not None]
        purity = (sum(labels) + prior * above) / (len(labels) + prior)
        for k in ended:
            out[k] = template, len(labels), purity
        for name, own in deeper.items():
            kids[name if len(own) >= max(min_urls, total * min_share) else "*"] += own
        branches, labelled = [], []
        for name, own in kids.items():
            labels = [urls[k][2] for k in own if urls[k][2] is not None]
            if labels:
                labelled.append((sum(labels) / len(labels), name, len(labels), sum(labels), own))
            else:
                branches.append([[name], 0, 0, own])
        runs = []
        for share, name, n, bad, own in sorted(labelled, key=lambda x: x[:4]):
            if runs:
                names, n0, bad0, own0 = runs[-1]
                p = (bad + bad0) / (n + n0)
                if abs(bad0 / n0 - share) <= similar * (p * (1 - p) * (1 / n + 1 / n0)) ** 0.5:
                    runs[-1] = [[*names, name], n + n0, bad + bad0, own0 + own]
                    continue
            runs.append([[name], n, bad, own])
        for names, _, _, own in branches + runs:
            grow(own, level + 1, f"{template}/{'*' if '*' in names else '|'.join(sorted(names))}", purity)

    hosts = defaultdict(list)
    for k, (host, _, _) in enumerate(urls):
        hosts[host].append(k)
    for rows in hosts.values():
        grow(rows, 0, "", overall)
    return out


def contamination(docs, items, width=10):
    """doc_id -> (words, hit words, item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(None if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w = TOKEN.findall(lower(text))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit[k : k + size] = [True] * size
                    found |= windows[key]
        out[i] = len(w), sum(hit), sorted(found, key=lambda x: (x is None, x))
    return out


def embeddings(rows, cosine=0.98):
    """vec_id -> (links, component)."""
    sound = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], defaultdict(int)
    for k, (i, v, a) in enumerate(sound):
        for j, w, b in sound[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    comp = roots([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], comp[r[0]]) for r in rows}
