"""Plain rewritings of operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}


def whitening(vectors):
    """{dim: (n, S, V, eigenvalues, axes)} over the distinct integer vectors."""
    out = {}
    rows = [np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for v in vectors]
    for d in {len(x) for x in rows}:
        u = np.unique(np.array([x for x in rows if len(x) == d]), axis=0)
        v = np.atleast_2d(np.cov(u.T.astype(float), bias=True))
        values, axes = np.linalg.eigh(v)
        out[d] = len(u), u.sum(axis=0), v, values[::-1], axes[:, ::-1]
    return out


def warc(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from (page_id, html)."""
    same = defaultdict(list)
    for i, html in pages:
        same[(html or "").encode()].append(i)
    out = []
    for payload, ids in same.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return out


def phrases(rows, best=2000, least=10):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang)."""
    by_lang, out = defaultdict(list), []
    for text, lang in rows:
        by_lang["und" if lang is None else lang].append((text or "").translate(LOWER))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                w = re.findall("[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        scored = []
        for p, a in found.items():
            if p not in dropped:
                s, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return out
