"""What a worker holds while it makes its tables."""

import tracemalloc

from tidewave.llm import bpe
from tidewave.llm.queries import vocabulary


def test_an_encoder_is_made_in_little_more_than_it_keeps():
    spec = vocabulary()
    bpe.PrefixEncoder('{"model": {"vocab": {"a": 0, "a</w>": 1}, "merges": [], "end_of_word_suffix": "</w>"}}')
    tracemalloc.start()
    try:
        encoder = bpe.PrefixEncoder(spec)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert encoder.word("hello") and most < 1.2 * kept
