"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pandas as pd

from tidewater.llm.common import caches
from tidewater.llm.kernels import BYTES, U, range_hash

#: Distinct pieces of text a worker remembers before it starts anew.
REMEMBERED = 900_000
#: Bytes of text encoded at a time.
SLICE = (1 << 20) - 4096
#: White space outside ASCII, its UTF-8 bytes as one number (fixed values of Unicode).
_WIDE = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

_CLOSING = np.frombuffer(b".,!?;:", np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which a byte-level BPE is sure to begin a piece.

    Those are a document's start; the first and the last character of white space within the text;
    other text after white space that isn't a space; and closing punctuation after an ASCII letter.
    """
    n = len(data)
    ends = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    starts = ends
    # UTF-8 texts end with a whole character, so the bytes after a lead byte are there.
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        long = data[lead] != 0xC2
        code = (data[lead].astype(np.int64) << 8) | data[lead + 1]
        code[long] = (code[long] << 8) | data[lead[long] + 2]
        wide = np.isin(code, _WIDE)
        starts = ends.copy()
        starts[lead[wide]] = True
        ends[(lead + 1 + long)[wide]] = True
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.zeros(n, bool)
    before[1:] = ends[:-1]
    after = np.ones(n, bool)
    after[:-1] = starts[1:]
    after |= first[1:]
    plain = (data == 32) | ((data >= 9) & (data <= 13))
    line = np.zeros(n, bool)
    letter = np.zeros(n, bool)
    if n:
        line[1:] = (data[:-1] >= 9) & (data[:-1] <= 13)
        low = data | np.uint8(32)
        letter[1:] = (low[:-1] >= 97) & (low[:-1] <= 122)
    closing = np.isin(data, _CLOSING)
    return np.flatnonzero(first[:n] | (plain & ~(before & after)) | (line & ~starts) | (closing & letter))


class Encoder:
    """Ids equal to the library's ``encode(text, add_special_tokens=False)``, and id 0 after each document.

    Texts are cut where pieces are sure to begin, and the library encodes each distinct piece once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(set(t.content) & set(" \t\r\n") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token with white space in it is not supported")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents end to end as uint32, their offsets) for UTF-8 bytes and offsets."""
        docs = len(offs) - 1
        start = cuts(data, offs)
        end = np.append(start[1:], len(data))[: len(start)]
        which, _ = pd.factorize(range_hash(data.astype(U) + U(1), start, end, BYTES) if len(start) else np.zeros(0, U))
        top = np.maximum.accumulate(which) if len(which) else which  # numbers are given in order of first sight
        lead = np.flatnonzero(np.diff(top, prepend=-1))
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start[lead].tolist(), end[lead].tolist())]
        if len(self.known) + len(pieces) > REMEMBERED // 2:  # what the last half didn't meet is forgotten
            self.older, self.known = self.known, {}
        new = [p for p in pieces if p not in self.known]
        if self.older and new:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.known]
        if new:
            for p, e in zip(new, self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)):
                self.known[p] = array("I", e.ids).tobytes()
        each = [self.known[p] for p in pieces] + [bytes(4)]  # the last is the end of a document
        size = np.array([len(x) >> 2 for x in each])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        of = np.searchsorted(start, offs)
        order = np.insert(which, of[1:], len(each) - 1) if docs else which
        many = size[order]
        to = np.concatenate([[0], np.cumsum(many)])
        flat = np.frombuffer(b"".join(each), "<u4")[np.repeat(begin[order] - to[:-1], many) + np.arange(to[-1])]
        return flat, to[of + np.arange(docs + 1)]


_encoders: dict[str, Encoder] = caches["tokens"]


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; a worker keeps it over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
