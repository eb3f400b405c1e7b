"""Short cuts of the toxicity readings against the whole search, and what is looked up against what is enumerated."""

import random
import unicodedata

import numpy as np

from lectern.llm import toxicity


def test_doubled_letters_are_decided_as_the_search_does():
    draw, size = random.Random(5), toxicity.SYMBOLS
    probs = np.random.default_rng(5).dirichlet(np.full(size, 0.2), size**3) + 1e-6
    read = toxicity.Restorer(np.log(probs).astype(np.float32).reshape(-1))
    words = ["".join(draw.choice("aabbccdeñé") for _ in range(draw.randint(2, 12))) for _ in range(3000)]
    found = [(w, f) for w in words if toxicity.DOUBLED.search(w) and (f := read.doubled(w)) is not None]
    assert len(found) > 300 and sum(w != f for w, f in found) > 30
    assert all(f == read.search(read.nodes(w)).strip() for w, f in found)
    assert read.doubled("aaab") is None and read.doubled("aabcc") is None and read.doubled("aabdcc") is not None


def test_plain_forms_are_looked_up():
    model = toxicity.ToxicityModel(np.zeros(1), dict.fromkeys(["stupid", "idiot$", "moronic", "scum$", "foolis"], 1.0), 0.0)
    for word in ["stúpid", "stuppidity", "idiott", "ídiots", "moronnically", "scumm", "scummy", "foolish", "foollishly", "plain", "", "é"]:
        hit = [s for s in toxicity.stems(word) if s in model.weights]
        bare = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
        bare = "".join(c for i, c in enumerate(bare) if not i or c != bare[i - 1])
        if not hit and bare != word:
            hit = [v for k, v in model.plain.items() if (bare == k if v.endswith("$") else bare.startswith(k) and len(k) > 5)]
        assert sorted(model.hits(word)) == sorted(hit), word
