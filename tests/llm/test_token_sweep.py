"""Ids of every code point, at the end of a word, inside one and before punctuation, against the tokenizer."""

import unicodedata

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
POINTS = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]


@pytest.mark.parametrize("form", ["a{};", "{}. x", "a{}b", "{}", "{};{}.,", "A{}.)b"])
def test_every_code_point_is_coded_as_by_the_tokenizer(form):
    coder, plain = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for k in range(0, len(POINTS), 20_000):
        texts = [form.replace("{}", c) for c in POINTS[k:k + 20_000]]
        ids, each = coder.encode(pa.array(texts, pa.string()))
        want = [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
        cuts = [0]
        for n in each:
            cuts.append(cuts[-1] + int(n))
        wrong = [t for t, a, b, w in zip(texts, cuts, cuts[1:], want) if ids[a:b].tolist() != w]
        assert not wrong, [(t, [hex(ord(c)) for c in t]) for t in wrong[:5]]


def test_the_reported_word():
    ids, each = tokens.WordEncoder(PATH).encode(pa.array(["İ;", "x İ; y", "क़. z"]))
    want = [x.ids for x in Tokenizer.from_file(PATH).encode_batch_fast(["İ;", "x İ; y", "क़. z"], add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and each.tolist() == [len(w) for w in want]
