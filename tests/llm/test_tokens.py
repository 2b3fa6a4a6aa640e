"""Ids of random texts full of odd white space against the tokenizers library itself."""

import random

import numpy as np

from tidewater.llm.tokens import Encoder, default_path


def test_encoder_equals_library():
    rnd = random.Random(3)
    marks = [" ", "  ", "\t", "\n", "\r\n", "\x1c", "\x85", "\xa0", " ", " ", "​", " ", " ", " ", "　"]
    words = ["a", "Word", "don't", "12", "é", "Â", "漢字", "한", "«", "…", ".", ",", "!?", "👍", "‐", "ᚁ"]
    texts = ["".join(rnd.choice(marks if rnd.random() < 0.5 else words) for _ in range(rnd.randrange(40))) for _ in range(400)]
    encoder = Encoder(default_path())
    for some in (texts, texts[:1], ["\u3000"], [""]):
        raw = [t.encode() for t in some]
        flat, offs = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for t, a, b in zip(some, offs, offs[1:]):
            assert flat[a:b].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
