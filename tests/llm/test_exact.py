"""Encoders against the tokenizers library over Unicode, and long unspaced texts."""

import random
import time

import numpy as np
import pytest

from pressmill.llm import lexicon
from pressmill.llm.registry import vocabulary
from pressmill.llm.tokens import byte_bpe

PLACES = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x11000 or 0x1E000 <= c < 0x20000)]
MIXED = "ΛΟΓΟΣΟΔΟΣİIıßŉǅééͅΑ한글가가ก็‍‌👩‍👧½٣٤Ⅷ'S'Redon't\x1c\x1d\x85\xa0᠎ﬁ㎏　 <|endoftext|> <|startoftext|><| abcXYZ09.,'"


def texts():
    draw = random.Random(1)
    found = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}X" for c in PLACES]
    found += ["".join(draw.choice(MIXED) for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    found += ["".join(draw.choice("aeionrst") for _ in range(draw.randint(50, 300))) for _ in range(200)]
    found += ["".join(chr(draw.choice(lexicon._LOOKED_AT)) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    found += ["".join(draw.choice("éÉñÑüÜßœŒжЖЮяλΛ’“”—…«»¿¡°12 .,'\n") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    return found + ["ΣΑΣ ΛΟΓΟΣ.", "ΟΔΟΣ", "ΛΟΓΟΣ", "a" * 500, "漢字仮名" * 60, "xyzzy" * 100 + "!!!!" * 50]


def word_ids(text):
    bpe = lexicon.word_bpe(vocabulary("word_bpe_49k.json"))
    words = bpe.words_of(text)
    merged = iter(bpe.merge([w.encode() for w in words if isinstance(w, str)]))
    return [i for w in words for i in (next(merged) if isinstance(w, str) else [w])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_kind_of_character(name):
    from tokenizers import Tokenizer

    path, all_texts = vocabulary(name), texts()
    codec = Tokenizer.from_file(path)
    ours = word_ids if name.startswith("word") else lambda t: np.frombuffer(byte_bpe(path).ids(t), "<u4").tolist()
    for at in range(0, len(all_texts), 2000):
        part = all_texts[at : at + 2000]
        for text, want in zip(part, codec.encode_batch(part, add_special_tokens=False)):
            assert ours(text) == want.ids, text


def test_a_million_letters_take_seconds():
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.time()
    assert len(word_ids(text)) > 100_000
    assert time.time() - began < 60


def test_memory_is_bounded_in_characters(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(lexicon, "MEMORY_CHARS", 500)
    monkeypatch.setattr(lexicon, "_GROUP_CHARS", 300)
    path = vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(k, f"some words{k} and others{k % 7} " * 9) for k in range(60)], "doc_id long, text string")
    uri = lexicon.build_lexicon(df, path, 5)
    rows = [r.text for r in df.collect()]
    codec = Tokenizer.from_file(path)
    assert [list(map(int, ids.split())) for ids, _ in lexicon.encoded(rows, path, uri)] == [codec.encode(t, add_special_tokens=False).ids for t in rows]
