"""The word encoder of op4 against the tokenizers library on odd texts, and what it asks of its cache."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestar.llm import packing
from lodestar.llm.queries import TOKENIZER
from lodestar.llm.shared import as_array

LETTERS = [*"aZé'É×÷ÿßs tdlrvem09<|>.,-\n\t\x0b\x00\x1c\x85\xa0 ÃÂ½²ªµ日😀İ ſK", "<|endoftext|>", "'re", "'LL", "don't", "́", "Ã©"]


def test_ids_are_those_of_the_library():
    some = random.Random(5)
    texts = ["".join(some.choice(LETTERS) for _ in range(some.randrange(40))) for _ in range(5000)] + ["", None, "É" * 100, "0" * 50]
    library, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER, cache_words=50)
    for begin in (0, 3):
        for _ in range(2):  # the second time from the cache, in part
            got = packing.token_ids(as_array(pa.array(texts)).slice(begin), encoder)
            for text, ids in zip(texts[begin:], got, strict=True):
                assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_word_is_encoded_once_whatever_signs_stand_by_it():
    encoder = packing.WordEncoder(TOKENIZER)
    list(packing.token_ids(as_array(pa.array(["Word word, (word) WORD.\nword7 word-word!"])), encoder))
    assert sum("word" in w.lower() for w in encoder.words) == 1


def test_cache_is_bounded_and_keeps_what_was_met_last():
    encoder = packing.WordEncoder(TOKENIZER, cache_words=100)
    for k in range(20):
        encoder([f"common{j}" for j in range(10)] + [f"{k}x{j}" for j in range(30)])
        assert len(encoder.words) + len(encoder.older) <= 100 + 2 * 40
        assert "common3" in encoder.words
    encoder.forget()
    assert not encoder.words and not encoder.older and np.array_equal(encoder(["common3"])[0], encoder(["common3"])[0])
