"""The mix as it is written, against a plain rewriting of its law."""

import re
from collections import Counter, defaultdict
from math import comb

import numpy as np

from funnelkit.llm import mixing
from funnelkit.llm.common import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check_mix(spark, docs, shard_slots=300, **kw):
    """Every slot holds the block that the plan draws for it, word by word."""
    path = scratch(spark, "mix-test")
    places, plan = mixing.write_mix(docs, path, shard_slots=shard_slots, **kw)
    places = places.collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    stream = defaultdict(list)  # the words of a source in order
    for r in sorted(places, key=lambda r: (r.src, r.start, r.size)):
        words = WORD.findall(text[r.doc_id])
        assert len(words) == r.size and len(stream[r.src]) == r.start
        stream[r.src] += [(w, r.row) for w in words]
    rows = mixing.read_mix(spark, path).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.slot, r.at)):
        assert r.text.split(" ") == WORD.findall(text[r.doc_id])[r.first : r.first + r.n_words] and len(r.text.split(" ")) == r.n_words
        found[(r.shard, r.slot)] += [(w, r.row) for w in r.text.split(" ")]
    drawn = {(r.shard, r.slot): (r.src, r.block) for r in mixing.slots(spark, plan, kw.get("seed", 5), shard_slots).collect()}
    b = kw.get("block_words", mixing.BLOCK_WORDS)
    assert found == {k: stream[s][n * b : (n + 1) * b] for k, (s, n) in drawn.items()}
    # slots are gapless, and each shard has the counts that were drawn for it
    shards = -(-int(plan.quota.sum()) // shard_slots)
    for shard in range(shards):
        mine = {k: v for k, v in drawn.items() if k[0] == shard}
        assert sorted(s for _, s in mine) == list(range(len(mine)))
        count = Counter(s for s, _ in mine.values())
        assert [count[s] for s in range(len(plan.quota))] == mixing.shard_counts(plan.quota, shards, shard, kw.get("seed", 5))[1].tolist()
    # a block is taken as often as its place in the permutations says
    times = Counter(drawn.values())
    for s, (n, quota) in enumerate(zip(plan.blocks.tolist(), plan.quota.tolist(), strict=True)):
        assert sum(times[(s, k)] for k in range(n)) == quota and (not n or max(times[(s, k)] for k in range(n)) - min(times[(s, k)] for k in range(n)) <= 1)
    # what a document gives is what its words are taken
    taken = Counter(row for piece in found.values() for _, row in piece)
    return {r.row: taken[r.row] for r in places}, places


def test_mix_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken, places = check_mix(spark, docs)
    got = Counter((r.doc_id, r.taken) for r in mixing.op5(docs).collect())
    assert got == Counter((r.doc_id, taken[r.row]) for r in places)  # shards of another size, the same blocks


def test_mix_of_odd_documents(spark, docs_of):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " one \x0b two\tthree\r\nfour ", "en", None), (4, "w " * 5_000, "en", "b"), (5, "x", "en", "c"), *[(10 + k, f"d{k} " * (k % 40), "en", "a") for k in range(60)]]
    taken, places = check_mix(spark, docs_of(rows).repartition(1), shard_slots=50, block_words=8, seed=3)
    assert all(taken[r.row] <= 3 * r.size for r in places) and sum(taken.values()) > 5_000


def test_draws_of_any_size():
    rng = np.random.default_rng(1)
    for good, bad, take in ((5, 7, 4), (300, 500, 200), (10**6, 10**6, 5 * 10**5), (10**12, 3 * 10**12, 10**12), (3 * 10**9, 10, 10**9)):
        n = 2_000
        x = np.array([mixing.hypergeometric(good, bad, take, rng) for _ in range(n)], dtype=float)
        total = good + bad
        mean, var = take * good / total, take * good / total * bad / total * (total - take) / (total - 1)
        assert abs(x.mean() - mean) < 4.5 * np.sqrt(var / n) and 0.8 < x.var() / var < 1.25
    # the whole distribution of a small draw
    seen = np.bincount([mixing.hypergeometric(300, 500, 200, rng) for _ in range(20_000)], minlength=201)
    law = np.array([comb(300, k) * comb(500, 200 - k) / comb(800, 200) for k in range(201)]) * 20_000
    often = law > 5
    assert ((seen - law)[often] ** 2 / law[often]).sum() < 2 * often.sum()
    quota = np.array([3 * 10**12, 0, 10**10, 7])
    got = mixing.split(quota, 10**12, rng)
    assert got.sum() == 10**12 and (got <= quota).all()


def test_permutations_turn_round():
    for n in (1, 2, 63, 64, 1_000):
        there = mixing.permuted(np.arange(n), n, (5, 1, 2, 0))
        assert sorted(there.tolist()) == list(range(n)) and mixing.permuted(there, n, (5, 1, 2, 0), back=True).tolist() == list(range(n))
    total, shards = 1_003, 7
    for shard in range(shards):
        n = total * (shard + 1) // shards - total * shard // shards
        assert sorted(mixing.slot_of(np.arange(n), np.full(n, shard), total, shards, 5).tolist()) == list(range(n))


def test_starts_by_a_join_give_the_same_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    paths = [scratch(spark, "mix-test") for _ in range(2)]
    mixing.write_mix(docs, paths[0], shard_slots=300)
    monkeypatch.setattr(mixing, "MAX_STARTS", 0)
    mixing.write_mix(docs, paths[1], shard_slots=300)
    one, two = (sorted(map(str, mixing.read_mix(spark, p).collect())) for p in paths)
    assert one and one == two
