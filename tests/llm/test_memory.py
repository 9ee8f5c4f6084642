"""What the tasks that fit a model hold at once."""

import tracemalloc

import numpy as np

from quillspark.llm import toxicity


def test_fit_holds_few_bytes_a_word():
    n, each = 400_000, 400
    index = np.random.default_rng(1).integers(0, 1 << toxicity.BITS, (n, 7)).astype(np.int32)
    offsets, toxic = np.arange(0, n + 1, each), np.arange(n // each) % 3 == 0
    index[np.repeat(toxic, each) & (np.arange(n) % 50 == 0), 0] = 7
    tracemalloc.start()
    try:
        toxicity.fit(index, offsets, toxic, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 150 * n
    finally:
        tracemalloc.stop()
