"""Plain, slow versions of the operators, by their definitions."""

import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def classes(texts, width, percent=80):
    """{doc_id: (set size, smallest reachable id)}"""
    sets = {k: shingles(v, width) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for k in sorted(sets):
        common = collections.Counter(j for s in sets[k] for j in held[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            held[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


def removed(texts, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        cover, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                for j in range(max(i, end), i + length):
                    cover[j] = 1
                end = i + length
            seen.add(w)
        spans = sum(c and not p for c, p in zip(cover, b"\0" + bytes(cover)))
        rest = bytes(v for v, c in zip(b, cover) if not c)
        out[k] = (len(b), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return out


def statistics(text):
    """words, characters in words, symbols, repeated lines, words in repeated windows of eight"""
    x = text or ""
    w = WORD.findall(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, inside, seen, lines = collections.Counter(windows), set(), set(), 0
    for i, k in enumerate(windows):
        if n[k] > 1:
            inside.update(range(i, i + 8))
    for line in x.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), lines, len(inside)


def licenses(text, base):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in base.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def personal(text):
    t = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def secrets(text):
    """Base spans (start, kind, end) by start, then kind."""
    t, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def nearest(vectors, k=5, modulus=50):
    ids, v = np.array([i for i, _ in vectors]), np.array([x for _, x in vectors], dtype=float)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % modulus == 0]:
        s = v @ v[ids == q][0]
        order = sorted((-round(s[i], 12), int(ids[i])) for i in range(len(ids)) if ids[i] != q)
        out[int(q)] = [i for _, i in order[:k]]
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def least_determinant(x, share, scale, floor, starts=60):
    """Mean and log determinant (scaled, with floors) of the minimum-covariance-determinant estimate, by many random starts."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(share * len(x))), None
    for _ in range(starts):
        core = x[rng.choice(len(x), min(len(x), 14), replace=False)]
        for _ in range(30):
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True) + np.diag(floor)
            core = x[np.argsort(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]]
        got = np.linalg.slogdet(scale * np.cov(core.T, bias=True) + np.diag(floor))[1]
        if best is None or got < best[1]:
            best = core.mean(axis=0), got
    return best
