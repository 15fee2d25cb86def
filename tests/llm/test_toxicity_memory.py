"""What fitting a lexicon holds beside the texts."""

import random
import tracemalloc

from terracell.llm import toxicity


def test_words_of_all_documents_are_not_held_together():
    rng = random.Random(4)
    plain = ["".join(rng.choices("bcdefghkmnprstuvwz", k=6)) for _ in range(200)]
    rows = [(" ".join(rng.choices(plain, k=3000) + ["grobian"] * (i % 2)), i % 2) for i in range(200)]
    tracemalloc.start()
    try:
        lex = toxicity.fit(rows)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert any("grobian".startswith(toxicity.fold(s)) or s.startswith("grob") for s in lex.weights)
    assert peak < 3 * sum(len(t) for t, _ in rows)  # a word is about ten times as large as an object of its own
