"""Results of near-duplicates must not depend on how large a candidate group is."""

import random

import numpy as np

from methylspark.llm import minhash
from methylspark.llm.shingles import shingle_set


def _pairs_with_one_common_band(n):
    """Texts that come in pairs of 20% or more alike, which share one band of their signatures."""
    rng, texts = random.Random(3), {}
    while len(texts) < 2 * n:
        same = [f"s{rng.randrange(10**9)}" for _ in range(12)]
        pair = [" ".join(same + [f"o{rng.randrange(10**9)}" for _ in range(8)]) for _ in range(2)]
        keys = [minhash.band_keys(minhash.signature(shingle_set(t.encode(), 1))) for t in pair]
        if len(np.intersect1d(*keys)) == 1:
            texts |= {len(texts) + k: t for k, t in enumerate(pair)}
    return texts


def test_pairs_with_one_common_band_are_compared_in_groups_of_any_size(spark, monkeypatch):
    texts = _pairs_with_one_common_band(6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {k: k - k % 2 for k in texts}
    for largest in (20_000, 1):
        monkeypatch.setattr(minhash, "REFINE", largest)
        found = minhash.near_duplicates(docs, width=1, percent=20).collect()
        assert {r.doc_id: r.component_id for r in found} == want
