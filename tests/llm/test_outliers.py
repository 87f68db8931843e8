"""The robust estimates against a plain rewriting in numpy."""

from collections import defaultdict

import numpy as np
import pytest

from funnelkit.llm import quality_rules as q

FLOORS = np.diag(np.array(list(q.FLOOR.values())) ** 2)
P = len(q.FLOOR)


def d2_of(x, mean, cov):
    y = np.linalg.solve(np.linalg.cholesky(cov), (x / q.UNIT - mean).T)
    return (y * y).sum(axis=0)


def medians(x):
    mean, cov = np.zeros(P), np.zeros((P, P))
    for i in range(P):
        b = np.sort(x[:, i] // (q.UNIT // 64))
        at = lambda p: b[max(1, int(np.ceil(p * len(b)))) - 1]  # noqa: E731, B023
        mean[i], cov[i, i] = (at(0.5) + 0.5) / 64, ((at(0.75) - at(0.25)) / 64 / 1.349) ** 2
    return mean, cov + FLOORS


def moments(x, factor):
    mean = x.mean(axis=0) / q.UNIT
    cov = ((x.T @ x) / len(x) / q.UNIT**2 - np.outer(mean, mean)) * factor
    cov[np.diag_indices(P)] = np.maximum(cov.diagonal(), 0)
    return mean, cov + FLOORS


def concentrated(x, mean, cov):
    bins = np.minimum(q.BINS - 1, np.floor(np.log1p(d2_of(x, mean, cov)) * 40)).astype(int)
    order = np.unique(bins, return_counts=True)
    upto = np.cumsum(order[1]) - order[1]
    keep = np.isin(bins, order[0][upto < q.H_SHARE * len(x)])
    return moments(x[keep], q.CONSISTENCY), (int(keep.sum()), *x[keep].sum(axis=0).tolist())


def brute(groups):
    """{(lang, source): (mean, covariance)} from {(lang, source): rows}."""
    levels = defaultdict(list)
    for (lang, source), x in groups.items():
        for name in ((lang, source), (lang,), ()):
            levels[name].append(x)
    levels = {k: np.concatenate(v) for k, v in levels.items()}

    def shrunk(found):
        out = {}
        for name in sorted(levels, key=len):
            mean, cov = found[name]
            if name:
                up, n = out[name[:-1]], len(levels[name])
                w = n / (n + q.PRIOR_ROWS)
                mean, cov = w * mean + (1 - w) * up[0], w * cov + (1 - w) * up[1]
            out[name] = mean, cov
        return out

    now = [{k: medians(x) for k, x in levels.items()}, {k: moments(x, 1.0) for k, x in levels.items()}]
    seen = [{k: set() for k in levels} for _ in now]
    done = [set(), set()]
    while any(len(d) < len(levels) for d in done):
        for start, marks, ended in zip(range(2), seen, done, strict=True):
            estimates = shrunk(now[start])
            for k, x in levels.items():
                if k not in ended:
                    now[start][k], mark = concentrated(x, *estimates[k])
                    if mark in marks[k]:
                        ended.add(k)
                    marks[k].add(mark)
    ends = [shrunk(m) for m in now]
    return {k: min((e[k] for e in ends), key=lambda e: round(0.5 * np.linalg.slogdet(e[1])[1], 9)) for k in groups}


def test_distances_against_numpy(spark, docs_of):
    rng = np.random.default_rng(4)
    words = [f"w{'x' * int(k)}{j}" for j, k in enumerate(rng.integers(0, 9, 300))]
    rows, k = [], 0
    for lang, source, n in (("en", "a", 60), ("en", "b", 7), ("de", "a", 25), ("de", None, 3), (None, "c", 1)):
        for _ in range(n):
            body = list(rng.choice(words, int(rng.integers(55, 160))))
            odd = rng.random() < 0.15
            for at in rng.integers(0, len(body), 40 if odd else int(rng.integers(0, 6))):
                body[at] = "#%|" * 6 if odd else "#"
            lines = [" ".join(body[a : a + 9]) for a in range(0, len(body), 9)]
            if rng.random() < 0.2:
                lines += lines[:2]
            rows.append((k, "\n".join(lines), lang, source))
            k += 1
    docs = docs_of(rows)
    found = {r.doc_id: r for r in q.quality_rules(docs).collect()}
    groups = defaultdict(list)
    for i, _, lang, source in rows:
        if not found[i].base_failed:
            groups[(lang, source)].append([getattr(found[i], f"x{j}") for j in range(P)])
    groups = {k: np.array(v, dtype=np.int64) for k, v in groups.items()}
    assert {k: len(v) for k, v in groups.items()} == {(lang, source): found[next(i for i, _, a, b in rows if (a, b) == (lang, source))].group_rows for lang, source in groups}
    expected = brute(groups)
    rejected = 0
    for i, _, lang, source in rows:
        x = np.array([[getattr(found[i], f"x{j}") for j in range(P)]])
        d2 = d2_of(x, *expected[(lang, source)])[0]
        assert found[i].d2 == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert found[i].kept == (not found[i].base_failed and d2 <= q.chi2_at(1 - q.TAIL, P))
        rejected += not found[i].kept
    assert 3 < rejected < 40


def test_every_group_has_an_estimate_of_its_own(spark):
    """At a size where no group has more than a few rows, too."""
    rows = [r for r in q.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if not r.base_failed]
    sizes = defaultdict(int)
    for r in rows:
        sizes[(r.lang, r.source)] += 1
    assert all(r.group_rows == sizes[(r.lang, r.source)] for r in rows) and min(sizes.values()) < 10
