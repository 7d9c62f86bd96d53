"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import re

import numpy as np
import xxhash


def digest(spans, kinds):
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return out


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def vectors(rows, least):
    """rows: (id, list or None). (id -> (links, component))."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = x / np.sqrt((x * x).sum())
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    roots = closure([i for i, _ in rows], pairs)
    return {i: (sum(i in p for p in pairs), roots[i]) for i, _ in rows}


def warc(rows, least=0):
    """rows: (id, html). id -> (bytes, digest, type, refers_to)."""
    by = {}
    for i, h in rows:
        by.setdefault(h or "", []).append(i)
    out = {}
    for i, h in rows:
        b = (h or "").encode()
        last = max(by[h or ""])
        revisit = len(b) >= least and i != last
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
    return out


def nearest(rows, k, asked):
    """rows: (id, list). Query id -> [(distance, id)]."""
    bits = {i: np.array(v) > 0 for i, v in rows}
    return {q: sorted((int((bits[q] != bits[i]).sum()), i) for i in bits if i != q)[:k] for q in bits if asked(q)}
