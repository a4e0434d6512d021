"""Pieces of the byte-level vocabulary: few calls for many new words, and the library's ids all the same."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from skein.llm.arrays import text_bytes
from skein.llm.token_files import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def encoded(own: ByteBpe, texts: list[str]) -> list[list[int]]:
    ids, bounds = own.encode_many(*text_bytes(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def odd_texts(seed: int, n: int) -> list[str]:
    deal = random.Random(seed)
    return ["".join(deal.choice(" aéZ  '\t\n\u0085\xa0sS.t09¿ñß中　 ́٣²Ⅳ😀​﻿\x1c\x7f") for _ in range(deal.randint(0, 24))) for _ in range(n)]


def test_new_words_are_encoded_end_to_end():
    deal = random.Random(7)
    words = ["".join(deal.choices("abcdeéñüß", k=9)) for _ in range(6000)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)] + odd_texts(1, 300)
    own = ByteBpe(PATH)
    library, own.tokenizer = own.tokenizer, Counted(own.tokenizer)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(own, texts) == want
    # one by one are the texts' first words and the odd texts' other pieces
    assert own.tokenizer.texts < 2500
    seen = own.tokenizer.texts
    assert encoded(own, texts) == want and own.tokenizer.texts == seen


def test_ids_that_cannot_be_parted_and_full_caches():
    texts = odd_texts(2, 3000)
    own = ByteBpe(PATH)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    own.token_bytes = np.ones_like(own.token_bytes)
    assert encoded(own, texts) == want
    small = ByteBpe(PATH)
    small.cache.most = 50
    assert [ids for k in range(0, len(texts), 100) for ids in encoded(small, texts[k : k + 100])] == want
