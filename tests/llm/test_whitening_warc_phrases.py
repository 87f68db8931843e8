"""Operators 11 to 13 against plain rewritings."""

import gzip
import io
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelkit.llm import phrases, queries, warc, whitening
from funnelkit.llm.common import scratch, ship

SF = "/root/testdata/sf0.001"
nulls_last = lambda r: tuple((x is None, 0 if x is None else x) for x in r)


# ---------------------------------------------------------------- whitening

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 150), st.integers(1, 7), st.sampled_from([3, 300, 1 << 20, 1 << 62]))
def test_bit_sliced_sums_are_exact(seed, n, d, top):
    x = np.random.default_rng(seed).integers(-top, top, (n, d))
    count, sums, cross = whitening.block_sums(x)
    o = x.astype(object)
    assert count == n and (sums == o.sum(axis=0)).all() and (cross == o.T @ o).all()
    v = int(cross[0, 0]) - 7
    assert sum(k << (30 * i) for i, k in enumerate(whitening._limbs(v))) == v


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, -1, 127, -128, 128, 40000, -(2**31), 2**31, 2**62]), max_size=4), min_size=1, max_size=8))
def test_vector_keys(rows):
    lengths = np.array([len(r) for r in rows])
    keys = whitening.vector_keys(lengths, np.array([v for r in rows for v in r], dtype=np.int64))
    assert len(set(zip(lengths.tolist(), keys, strict=True))) == len({tuple(r) for r in rows})
    for r, k in zip(rows, keys, strict=True):
        assert not r or whitening.from_keys([k], len(r))[0].tolist() == r


def check_whitened(rows, source):
    """Rows against a plain rewriting over the usable (vec_id, vector)."""
    spaces = brute.whitening([v for _, v in source])
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c + 1) for i, v in source for c in range(min(4, len(v))))
    vector = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in source}
    signs = {}
    for r in rows:
        x = vector[r.vec_id]
        n, sums, v, values, axes = spaces[len(x)]
        k = r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, sums, strict=True))
        if values[k] <= 1e-9:
            assert r.whitened is None
            continue
        assert r.explained == pytest.approx(values[k] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
        expected = (x - sums / n) @ axes[:, k] / np.sqrt(values[k])
        if abs(expected) > 1e-6:
            assert abs(r.whitened) == pytest.approx(abs(expected), rel=1e-6)
            assert signs.setdefault((len(x), k), np.sign(expected * r.whitened)) == np.sign(expected * r.whitened)


def test_op11_against_numpy(spark):
    rows = queries.queries()["op11_whitening"](spark, SF).collect()
    check_whitened(rows, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_op11_odd_rows(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=3).round(2).tolist()) for k in range(30)] + [(40, [0.5]), (41, [0.5]), (42, [0.25, 0.5]), (43, [1.5, 0.5])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0])]
    table = spark.createDataFrame([*good, *odd], "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("dim", F.lit("y"))
    check_whitened(whitening.op11(table.unionByName(table.where("vec_id = 1"))).dropDuplicates(["vec_id", "component"]).collect(), good)
    assert whitening.op11(table.unionByName(table.where("vec_id = 1"))).where("vec_id = 1").count() == 6
    assert whitening.op11(table.limit(0)).count() == 0
    # beyond a long: no crash, and the exact figure as text
    far = whitening.op11(spark.createDataFrame([(None, [3e38]), (2, [-3e38])], "vec_id long, embedding array<float>")).collect()
    assert len(far) == 2 and all(r.deviation is None and int(r.deviation_text) > 2**63 and abs(r.whitened) == pytest.approx(1) for r in far)


# ---------------------------------------------------------------------- WARC

def read_back(df):
    return sorted((nulls_last(r[:5]) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


def test_op12_odd_rows(spark):
    ship(spark)
    long = "<p>é " * 300_000
    rows = [(5, "u", "x" * 100), (3, "http://a/\r\nX-Page-Id: 9 é", "x" * 100), (3, "v", "x" * 100), (None, "w", "x" * 100), (None, None, "only nulls " * 20), (None, "q", "only nulls " * 20),
            (7, "a", "short"), (8, "b", "short"), (9, "c", None), (10, "d", ""), (11, "e", long), (2, "f", long), (12, "g", "WARC/1.1\r\n\r\n\x1f\x00" + "y" * 90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("row", F.lit("r")).repartition(3)
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    found = warc.op12(pages)
    assert read_back(found) == sorted(map(nulls_last, brute.warc([(r[0], r[2]) for r in rows])))
    assert Counter(r.url for r in found.collect()) == Counter(r[1] for r in rows)
    assert warc.op12(pages.limit(0)).count() == 0


def test_ranges_own_each_record_once(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = warc.write_archives(pages, scratch(spark, "warc-test"))
    expected = sorted((r.page_id, r.html.encode()) for r in pages.collect())
    for size in (20_000, 1 << 24):
        found = warc.read_archives(spark, path, range_bytes=size)
        assert sorted((r.page_id, bytes(r.payload)) for r in found.collect()) == expected
        assert found.where("problem IS NOT NULL").count() == 0
    # the files are plain gzip streams of whole records
    parts = [r.content for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert sum(len(list(warc.records(gzip.decompress(p)))) for p in parts) == len(expected)


def test_scan_cuts_anywhere():
    """Any two cuts of a file with false magics and foreign members give every record once."""
    noise = warc.MAGIC + b"\0\0\0\0\0\0\xff junk" + warc.MAGIC
    stored = warc.member([("WARC-Type", "resource")], warc.MAGIC * 50, level=0)  # magics in plain sight
    two = gzip.compress(b"".join(b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" for _ in range(2)))
    parts = [stored, warc.EMPTY_MEMBER, noise, two, gzip.compress(b"no record"), stored, warc.member([("WARC-Type", "resource")], b"z" * 300)]
    data = b"".join(parts)
    whole = list(warc.scan(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 4 and [len(list(warc.records(c))) for _, c, _ in whole] == [1, 2, 1, 1]
    for a in range(0, len(data), 7):
        for b in range(a, len(data), 131):
            cuts = [0, a, b, len(data)]
            assert [r for lo, hi in zip(cuts, cuts[1:], strict=False) for r in warc.scan(io.BytesIO(data), lo, hi)] == whole
    cut = list(warc.scan(io.BytesIO(data[:-5]), 0, len(data)))
    assert cut[:3] == whole[:3] and cut[3][1] is None and cut[3][2]


# ------------------------------------------------------------------- phrases

@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=80), st.integers(0, 60)), max_size=6), st.sampled_from([0, 4, 9]))
def test_trie_counts_through_bursts_and_spills(batches, shared):
    """Any order of batches, bursts and spills leaves the counts right."""
    burst, phrases.BURST = phrases.BURST, 8
    try:
        trie, out, expected = phrases.HatTrie(), [], Counter()
        for batch, keep in batches:
            triples = [(a, b, c if b else 0) for a, b, c in batch]
            expected.update(triples)
            keys = np.array([(a << 42) | (b << 21) | c for a, b, c in triples], dtype=np.uint64)
            trie.add(*np.unique(keys, return_counts=True))
            assert trie.size == sum(map(len, trie.leaf)) and (np.diff(trie.least.astype(object)) > 0).all()
            out.append(trie.spill(keep))
            assert trie.size <= keep
        out.append(trie.spill(0))
    finally:
        phrases.BURST = burst
    hashes = np.concatenate([[0], np.random.default_rng(1).integers(1, 2**63, 9)]).astype(np.uint64)
    merges = {}
    for keys, n in out:
        assert (np.diff(keys.astype(object)) > 0).all()
        for r in phrases.run_rows(keys, n, hashes, shared, "en", 5):
            merges.setdefault(r["part"], phrases.Merge(shared)).add(*phrases.row_entries(r["words"], r["entries"]))
    found = Counter()
    number = {int(h): k for k, h in enumerate(hashes)}
    for m in merges.values():
        m.merge()
        for g1, g2, g3, n in zip(*m.often(1, hashes[: shared + 1]), strict=True):
            assert (number[int(g1)], number[int(g2)], number[int(g3)]) not in found
            found[(number[int(g1)], number[int(g2)], number[int(g3)])] = int(n)
    pairs = Counter()
    for (a, b, _), n in expected.items():
        pairs[(a, b, 0)] += n if b else 0
    assert found == +pairs + Counter({t: n for t, n in expected.items() if t[2]})


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(map(tuple, queries.queries()["op13_phrases"](spark, SF).collect()))
    assert found == sorted(brute.phrases([(r.text, r.lang) for r in docs.collect()])) and len(found) > 100


def test_op13_odd_rows(spark, docs_of):
    rows = [(1, "A b c. a B\tc,c  a b;x " * 20, None), (2, "a b c " * 30, "und"), (3, None, "en"), (4, "", "en"), (None, " \n\t", "fr"), (5, "é é é! é" * 15, "de"), (5, "é é é! é" * 15, "de"),
            (6, "w " * 200_000, "es"), (7, "p q\x0br p q\x0cr p q\rr " * 12, "")]
    docs = docs_of([(i, t, lang, None) for i, t, lang in rows]).withColumn("word", F.lit(1)).withColumn("a", F.lit("x"))
    expected = sorted(brute.phrases([(t, lang) for _, t, lang in rows]))
    assert sorted(map(tuple, phrases.op13(docs).collect())) == expected
    assert {r[0] for r in expected} == {"und", "de", "es", ""}
    assert phrases.op13(docs.limit(0)).count() == 0
    # the cap on ranks, with ties by phrase
    ties = docs_of([(k, f"t{k} u{k} " * 10, "en") for k in range(30)])
    assert [r.phrase for r in phrases.op13(ties, best=3).orderBy("rank").collect()] == [r[2] for r in sorted(brute.phrases([(f"t{k} u{k} " * 10, "en") for k in range(30)], best=3))]
