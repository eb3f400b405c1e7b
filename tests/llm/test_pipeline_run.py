"""The whole pipeline over a small table: what its stages have to leave, and that what they leave is right."""

import numpy as np
from test_brute_force import lower

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingled(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run_leaves_clean_documents_once_each(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = [r["doc_id"] for r in got]
    assert len(set(kept)) == len(kept) and set(kept) <= set(docs)
    assert all(r["decoded"] == docs[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids_le"]) // 4 > 0 for r in got)
    texts = {i: docs[i]["text"] for i in kept}
    assert len({lower(t) for t in texts.values()}) == len(texts)
    sets = {i: shingled(t) for i, t in texts.items()}
    assert all(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a in kept for b in kept if a < b)
    # a document goes for a reason: another text like it, low quality, or no clear language
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every = {i: shingled(r["text"] or "") for i, r in docs.items()}
    alone = [i for i in docs if labels.get(i) == 1 and not any(5 * len(every[i] & every[j]) >= 4 * len(every[i] | every[j]) for j in docs if j != i)]
    assert np.mean([i in texts for i in alone]) > 0.95
