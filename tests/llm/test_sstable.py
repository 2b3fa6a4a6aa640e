import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from tokenizers import Tokenizer

from tidewater.llm.common import fresh_path, text_buffers
from tidewater.llm.sstable import Reader, shard_digests, write_shards
from tidewater.llm.tokens import default_path, encoder


@lru_cache
def library():
    return Tokenizer.from_file(default_path())


def plain(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = ["", " ", "  ", "   ", "a b", "a  b", "a   b", " a", "a ", "a  ", "a\n b", "a \n b", "a\n  b", "a \nb", "a  \nb", "\t a", "it's  ok", "don't 12 3.5!", "é à  b", "x\x00 y", "a  b", "<|endoftext|> a", "a <|endoftext|>", "日本 語", "\r\n  x", "🙂 🙂  🙂"]


def test_encoder_equals_library():
    rnd = random.Random(0)
    texts = TEXTS + ["".join(rnd.choice(["a", "B", " ", " ", "\n", "'s", "1", ".", "é", "\t", " "]) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    t = Tokenizer.from_file(default_path())
    flat, offs = encoder(default_path()).encode(*text_buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        assert flat[offs[i] : offs[i + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i * 7 - 50, rnd.choice(TEXTS) + " ".join(str(rnd.randrange(999)) for _ in range(rnd.choice([0, 3, 500])))) for i in range(300)]
    rows.append((10**15, None))
    shuffled = rnd.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string")
    want, start = [], 0
    for d, text in sorted(rows):
        ids = np.array(plain(text), "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, shard_digests(df).collect())) == want


def test_lookup(spark):
    rows = [(i * 3, f"text {i} " * (i % 50)) for i in range(2000)] + [(30, "again")]
    folder = fresh_path(spark, "lookup")
    manifest = write_shards(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    files, root = fs.FileSystem.from_uri(folder)
    found = {}
    for m in manifest:
        r = Reader(files.open_input_file(f"{root}/{m.name}"))
        for d in (0, 30, 31, 3 * 777, 3 * 1999, -5):
            found.setdefault(d, []).extend(x.tolist() for x in r.get(d))
    assert found[31] == found[-5] == []
    assert found[3 * 777] == [plain(rows[777][1])] and found[3 * 1999] == [plain(rows[1999][1])] and found[0] == [plain("")]
    assert sorted(found[30]) == sorted([plain(rows[10][1]), plain("again")])


def test_edges(spark):
    schema = "doc_id long, text string, start long, name string"
    assert shard_digests(spark.createDataFrame([], schema)).count() == 0
    got = shard_digests(spark.createDataFrame([(None, "x", 0, ""), (4, None, None, None), (4, "x", 1, "")], schema)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(4, 1), (4, 2)]
