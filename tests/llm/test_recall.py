"""Recall of the decontamination on planted cut copies and paraphrases."""

import numpy as np

from funnelkit.llm.decontaminate import op9

SF = "/root/testdata/sf0.01"


def test_cut_copies_and_paraphrases_are_found(spark, docs_of):
    """Items with 72 % of their words left, or with a quarter or two fifths of
    the words before the last eight replaced, inside other documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").toPandas()
    rng = np.random.default_rng(1)
    texts = docs.text.fillna("")
    vocabulary, base = " ".join(texts.head(300)).split(), [t for t in texts if len(t.split()) > 120]
    rows, plan, k = [(int(i), t) for i, t in zip(docs.doc_id, texts, strict=True)], set(), 10**9
    for share in (None, 0.6, 0.75):
        for i, text in zip(items.item_id, items.text, strict=True):
            w = (text or "").split()
            if len(w) < 12:
                continue
            around, at = base[int(rng.integers(len(base)))].split(), int(rng.integers(20, 90))
            k += 1
            if share is None:
                w = w[: int(np.ceil(len(w) * 0.72))]
            else:
                keep = rng.random(len(w)) < share
                w = [x if keep[j] or j >= len(w) - 8 else str(rng.choice(vocabulary)) for j, x in enumerate(w)]
            rows.append((k, " ".join(around[:at] + w + around[at : at + 60])))
            plan.add((k, int(i)))
    benchmark = spark.createDataFrame([(int(i), t) for i, t in zip(items.item_id, items.text, strict=True)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in op9(docs_of(rows), benchmark).collect()}
    assert len(plan) == 120 and len(plan & found) >= 117
