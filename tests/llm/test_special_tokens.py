import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import packing, queries


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a<|EndOfText|>b, <|endoftext|> Word.", "<|STARTOFTEXT|>."])
def test_marks_in_any_case_have_the_tokenizers_ids(text):
    want = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Tokens(queries.tokenizer_path()).ids(text.encode()), "<u4").tolist() == want


def test_words_between_signs_have_the_tokenizers_ids():
    path = queries.tokenizer_path()
    own, plain, rng = packing.Tokens(path), Tokenizer.from_file(path), random.Random(8)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = [*"abcXYZ\u00c0\u00d6\u00d8\u00de\u00df\u00e9\u00f6\u00f8\u00ff"]
    others = [*"019'\u00d7\u00f7\u00b5\u00aa\u2019\u0301\u0338\u03a3\u0130\u212a\u212b\u4e2d\u00a0\u2003\x00\x1c\x7f\U0001f600", "'s", "'LL", "<|", "|>", "<|endoftext|>", "<|EndOfText|>"]
    texts = ["".join(rng.choices(rng.choice((signs, letters, letters, others)), k=1)[0] for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += [a + b + c for a, b, c in itertools.product(["", *signs], ["w", "\u00dcb"], ["", *signs])]
    texts += [" ".join(rng.choices(texts, k=20)) for _ in range(300)] + ["x" * 100 + ". " + "X" * 100 + " (" + "y" * 64 + " " + "Y" * 65]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_words_of_letters_and_signs_go_to_the_merges_at_once():
    own, rng = packing.Tokens(queries.tokenizer_path()), random.Random(9)
    whole, words = [], {f"{rng.choice(['', '(', 'A', chr(0xc9)])}{''.join(rng.choices('abcdefgh', k=9))}{rng.choice([',', '!!', '.%%%', '&&&'])}" for _ in range(1000)}

    class Counted:
        model = own.tokenizer.model

        def encode(self, word, **kw):
            whole.append(word)
            return tokenizer.encode(word, **kw)

        def encode_batch_fast(self, words, **kw):
            whole.extend(words)
            return tokenizer.encode_batch_fast(words, **kw)

    tokenizer, own.tokenizer = own.tokenizer, Counted()
    own.ids(" ".join(words).encode())
    assert len(whole) <= 5  # the signs alone
