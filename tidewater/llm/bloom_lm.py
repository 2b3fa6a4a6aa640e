"""Language-model scoring with a log-frequency Bloom filter.

The filter holds every word pair of the training texts with its count quantised to powers of two:
a pair of level q is inserted q times, as (pair, 1) to (pair, q), and a probe asks for rising levels
until one is missing.  Pairs are counted over all documents; the filter has about ``BITS`` bits for each
insertion, so it grows with the corpus.  It is cut into segments by the pair's hash.  A filter of at most
``MOST_BYTES`` is broadcast to the workers, which probe it in place.  A larger one stays where it is: each
chunk of texts sends its distinct pairs to their segments and gets the levels back, so nothing is broadcast
and both work and traffic stay in proportion to the corpus.

Single words are counted exactly.  Texts are gathered into chunks with a vocabulary each; only
vocabularies meet globally, split by hash, and each chunk gets its own words' counts back.

Words and pairs are merged over several chunks before they are cut into buckets, at most ``2**FAN`` at once; more
buckets take a second merge and cut.  A chunk asks ranges of buckets, whose number follows the distinct words or the
filter's bytes.  So the rows that pass between them grow with the corpus, until some 67 million distinct words or a
filter of 1 GB take more than ``2**RANGES`` ranges; from there each chunk asks more of them.

score: sum over tokens of log10 of ``(c(v, w) + MU * p(w)) / (c(v) + MU)``, where v is the token before (a
start mark at first), c(v, w) the filter's count (at most c(v)) and p(w) the smoothed share of w.
base_score: sum of log10 p(w) = (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ids_of, materialise, only, slices, text_buffers, texts
from tidewater.llm.kernels import U, Words, mix

BITS, HASHES = 10, 5
MOST_BYTES = 192 << 20
MU = 30.0
#: Bytes of text in a chunk, and entries in a bucket of words or pairs.
CHUNK, BUCKET = 2 << 20, 1 << 19
#: Entries that are merged before a cut; bits of the buckets of one cut; least bits of the ranges that chunks ask.
MERGE, FAN, RANGES = 1 << 21, 8, 6
#: Distinct words and bytes of the filter in a range.
RANGE_WORDS, RANGE_BYTES = 1 << 20, 16 << 20
#: Bits of a pair's key.
KEY = 52
END, START = U(0x0E4D0E4D0E4D0E4D), U(0x57A2757A2757A275)  # stand-ins for the hashes of the end and of the start


def packed(x: np.ndarray) -> bytes:
    """An unsigned array as zstd-compressed byte planes."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def ascending(x: np.ndarray) -> bytes:
    """A sorted uint64 array, as differences."""
    return packed(np.diff(x, prepend=U(0)))


def ascended(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, U), dtype=U)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + mix(word)) >> U(64 - KEY)


def _chunks(size: int):
    names = ["chunk", "ids", "known_id", "held", "counts", "tokens", "words", "train"]

    def flush(number: int, held: list) -> pa.RecordBatch:
        ids, known, out, learn, lengths, hashes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        words, tokens = np.unique(hashes, return_inverse=True)
        train = np.bincount(tokens, np.repeat(learn, lengths), len(words)).astype(np.uint32)
        row = [number, ids.astype("<i8").tobytes(), known.tobytes(), out.tobytes(), packed(lengths.astype(np.uint32)), packed(tokens.astype(np.uint32)), ascending(words), packed(train)]
        return pa.record_batch([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*text_buffers(part.column("text")))
                ids, known = ids_of(part.column("doc_id"))
                out = np.asarray(part.column("held"))
                at = words.of[1:]
                held.append((ids, known, out, known & ~out, np.diff(words.of) + 1, np.insert(words.hash, at, END)))
                n += len(words.data)
                if n > size:
                    yield flush(number, held)
                    number, n = number + 1, 0
        if held:
            yield flush(number, held)

    return run


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")  # which merges sorted runs
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def edges(keys: np.ndarray, width: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys of ``width`` bits for each bucket, their first ``bits``, that holds any."""
    edge = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(width - bits)) if bits else 0, len(keys))
    some = np.flatnonzero(edge[1:] > edge[:-1])
    return list(zip(some.tolist(), edge[some].tolist(), edge[some + 1].tolist()))


def _train_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words, train = ascended(row["words"]), unpacked(row["train"], np.uint32)
    return words[train > 0], train[train > 0].astype(U)


def _train_pairs(row: dict) -> tuple[np.ndarray, None]:
    _, known, held, lengths, _, word, before = _documents(row)
    learn = np.repeat(known & ~held, lengths)
    return pair_keys(before[learn], word[learn]), None


def _cut_before(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return ascended(row["keys"]), unpacked(row["counts"], U)


_CUT = "bucket long, keys binary, counts binary"


def _cuts(of, width: int, bits: int, most: int):
    """Keys and counts ``of`` rows (no counts: one each), merged some ``most`` at a time and cut into buckets."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held])
        if held[0][1] is None:
            held.clear()
            keys, counts = np.unique(keys, return_counts=True)
        else:
            counts = np.concatenate([c for _, c in held])
            held.clear()
            keys, counts = merged(keys, counts)
        rows = [(b, ascending(keys[x:y]), packed(counts[x:y].astype(U))) for b, x, y in edges(keys, width, bits)]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        held, n = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(of(batch.slice(k, 1).to_pylist()[0]))
                n += len(held[-1][0])
                if n >= most:
                    yield from flush(held)
                    n = 0
        if held:
            yield from flush(held)

    return run


def _counted(rows: DataFrame, of, width: int, bits: int, merge: int, fan: int) -> DataFrame:
    """Rows (bucket, keys, counts), sorted by bucket in each partition, a bucket in one partition."""
    deal = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    done = min(bits, fan)
    out = deal(rows.mapInArrow(_cuts(of, width, done, merge), _CUT))
    while done < bits:
        done = min(bits, done + fan)
        out = deal(out.mapInArrow(_cuts(_cut_before, width, done, merge), _CUT))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a stream sorted by ``key``, gathered by its values."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's distinct words with their totals."""
    for bucket, rows in _grouped(batches, "bucket"):
        words, total = merged(*map(np.concatenate, zip(*map(_cut_before, rows))))
        row = (bucket, len(words), int(total.sum()), ascending(words), packed(total))
        yield pa.record_batch([pa.array([c], t) for c, t in zip(row, (pa.int64(),) * 3 + (pa.binary(),) * 2)], ["bucket", "v", "n", "keys", "counts"])


def _asked_words(bits: int):
    """The words of each chunk, cut by the range that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for chunk, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words"))):
                words = ascended(raw)
                rows = [(b, chunk, ascending(words[x:y]), None) for b, x, y in edges(words, 64, bits)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "counts"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of the words that chunks ask for, from rows sorted by (bucket, chunk); the vocabulary's rows have negative chunks."""
    only("powers")
    now, held = None, []
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["bucket"] != now:
                now, held = row["bucket"], []
            if row["chunk"] < 0:
                held.append(_cut_before(row))
                continue
            if len(held) > 1:
                held = [tuple(map(np.concatenate, zip(*held)))]
            keys = ascended(row["keys"])
            total = np.zeros(len(keys), U)
            if held:
                words, totals = held[0]
                at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                hit = words[at] == keys
                total[hit] = totals[at[hit]]
            out.append((row["chunk"], now, packed(total)))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "bucket", "totals"])


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, known, held, lengths, token numbers, word hashes, hash of the token before each)."""
    lengths, tokens, words = unpacked(row["counts"], np.uint32).astype(np.int64), unpacked(row["tokens"], np.uint32), ascended(row["words"])
    word = words[tokens]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known_id"], bool), np.frombuffer(row["held"], bool), lengths, tokens, word, before


def probes(keys: np.ndarray, level: int | np.ndarray, i: int) -> np.ndarray:
    h = mix(keys + (np.asarray(level).astype(U) << U(56)))
    return (h >> U(20)) + U(i) * (mix(h) >> U(20) | U(1))


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of a bucket's pairs."""
    level = np.floor(np.log2(counts)).astype(np.int64) + 1
    size = max(64, int(level.sum()) * BITS // 64 * 64 + 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= q]
        for i in range(HASHES):
            bits[probes(some, q, i) % U(size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _grouped(batches, "bucket"):
        raw = segment(*merged(*map(np.concatenate, zip(*map(_cut_before, rows)))))
        yield pa.record_batch([pa.array([bucket]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "bytes", "bits"])


class Filter:
    """Segments laid end to end in ``raw``; ``lengths`` are (bucket, bytes) in that order, buckets are the keys' first ``bits``."""

    def __init__(self, bits: int, lengths: list[tuple[int, int]], raw: bytes):
        self.bits, n = bits, 1 << bits
        self.at, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for b, z in lengths:
            self.at[b], self.size[b] = at, z * 8
            at += z
        self.raw = np.frombuffer(raw, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key that is present along with all below it; 0 for none."""
        out = np.zeros(len(keys), np.uint8)
        bucket = (keys >> U(KEY - self.bits)).astype(np.int64)
        live = np.flatnonzero(self.size[bucket] > 0)
        while len(live):
            h = mix(keys[live] + (out[live] + U(1) << U(56)))
            p, step = h >> U(20), mix(h) >> U(20) | U(1)  # as ``probes``, whose hashes serve all ``HASHES`` bits
            at, size = self.at[bucket[live]], self.size[bucket[live]].astype(U)
            for _ in range(HASHES):
                bit = (p % size).astype(np.int64)
                some = np.flatnonzero(self.raw[at + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1)
                live, at, size, step = live[some], at[some], size[some], step[some]
                p = p[some] + step
            out[live] += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return expected(self.levels(keys))


def expected(levels: np.ndarray) -> np.ndarray:
    """The mean count of each level: 0, then the middle of 2**(q - 1) to 2**q - 1."""
    return np.where(levels > 0, (3 * 2.0 ** (levels.astype(float) - 1) - 1) / 2, 0)


def _asked(bits: int):
    """The distinct pairs of each chunk, cut by the range of segments that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, _, _, word, before = _documents(row)
                keys = np.unique(pair_keys(before, word))
                rows = [(b, row["chunk"], ascending(keys[x:y])) for b, x, y in edges(keys, KEY, bits)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "chunk", "raw"])

    return run


def _answers(bits: int):
    """The levels of the pairs that chunks ask for, from rows sorted by (bucket, chunk); a segment has its number less ``2**bits`` as chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        now, lengths, raw, held = None, [], bytearray(), None
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["bucket"] != now:
                    now, lengths, raw, held = row["bucket"], [], bytearray(), None
                if row["chunk"] < 0:
                    lengths.append((row["chunk"] + (1 << bits), len(row["raw"])))
                    raw += row["raw"]
                    continue
                if held is None and lengths:
                    held = Filter(bits, lengths, raw)
                keys = ascended(row["raw"])
                levels = held.levels(keys) if held else np.zeros(len(keys), np.uint8)
                rows.append((row["chunk"], now, packed(levels)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "bucket", "levels"])

    return run


def _scores(shared, n: int, v: int, starts: int):
    """Scores of the chunks' texts; the filter is ``shared``, or each chunk has its pairs' levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        filter_ = Filter(*shared.value) if shared else None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, known, held, lengths, tokens, word, before = _documents(row)
                totals = np.concatenate([unpacked(t["totals"], U) for t in sorted(row["parts"], key=lambda t: t["bucket"])]).astype(float)
                c = totals[tokens]
                p = (c + 1) / (n + v + 1)
                context = np.empty(len(c))
                context[1:] = c[:-1]
                context[np.cumsum(lengths) - lengths] = starts
                keys, which = np.unique(pair_keys(before, word), return_inverse=True)
                levels = filter_.levels(keys) if filter_ else np.concatenate([unpacked(t["levels"], np.uint8) for t in sorted(row["answers"], key=lambda t: t["bucket"])])
                got = np.where((context > 0) & (c > 0), expected(levels)[which], 0)
                terms = np.log10((np.minimum(got, context) + MU * p) / (context + MU))
                at = np.cumsum(lengths) - lengths
                cols = [pa.array(ids, mask=~known), pa.array(held), pa.array(lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(ids), n)), pa.array(np.add.reduceat(np.log10(p), at)), pa.array(np.add.reduceat(terms, at))]
                yield pa.record_batch(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, most_bytes: int = MOST_BYTES, chunk: int = CHUNK, bucket: int = BUCKET, merge: int = MERGE, fan: int = FAN) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2.  A null or empty text is its end token.
    A row with a null doc_id is scored but not learnt from, and is not held out; repeated rows each count.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = texts(docs)
    docs = docs.withColumn("held", F.coalesce(fold == 2, F.lit(False)))
    schema = "chunk long, ids binary, known_id binary, held binary, counts binary, tokens binary, words binary, train binary"
    chunks = materialise(docs.mapInArrow(_chunks(chunk), schema), "chunks")
    size = chunks.select(F.sum(F.length("words")).alias("w"), F.sum(F.length("tokens")).alias("t")).first()
    # About ``bucket`` entries each: a word takes some five bytes here, a token some two.
    w_bits, p_bits = (max(1, int((s or 0) // per // bucket).bit_length()) for s, per in ((size.w, 5), (size.t, 2)))

    words = _counted(chunks.select("words", "train"), _train_words, 64, w_bits, merge, fan)
    words = materialise(words.mapInArrow(_vocabulary, "bucket long, v long, n long, keys binary, counts binary"), "words")
    sums = words.select(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n = sums.v or 0, sums.n or 0
    ranges = min(w_bits, max(RANGES, (v // RANGE_WORDS).bit_length()))
    own = words.select(F.shiftright("bucket", w_bits - ranges).alias("bucket"), (F.col("bucket") - (1 << w_bits)).alias("chunk"), "keys", "counts")
    asked = chunks.select("chunk", "words").mapInArrow(_asked_words(ranges), "bucket long, chunk long, keys binary, counts binary")
    asked = asked.union(own).repartition("bucket").sortWithinPartitions("bucket", "chunk")
    totals = materialise(asked.mapInArrow(_word_counts, "chunk long, bucket long, totals binary"), "totals")
    starts = docs.where("doc_id is not null and not held").count()

    pairs = _counted(chunks.select("ids", "known_id", "held", "counts", "tokens", "words"), _train_pairs, KEY, p_bits, merge, fan)
    parts = materialise(pairs.mapInArrow(_segments, "bucket long, bytes long, bits binary"), "segments")
    mine = totals.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals")).alias("parts"))
    both = chunks.drop("train").join(mine, "chunk")
    shared = None
    filter_bytes = parts.agg(F.sum("bytes")).first()[0] or 0
    if filter_bytes <= most_bytes:
        lengths, raw = [], bytearray()
        for r in parts.orderBy("bucket").toLocalIterator():  # at most ``most_bytes`` in all
            lengths.append((r.bucket, len(r.bits)))
            raw += r.bits
        shared = spark.sparkContext.broadcast((p_bits, lengths, raw))
        del raw
    else:
        ranges = min(p_bits, max(RANGES, (filter_bytes // RANGE_BYTES).bit_length()))
        asked = chunks.select("chunk", "ids", "known_id", "held", "counts", "tokens", "words").mapInArrow(_asked(ranges), "bucket long, chunk long, raw binary")
        own = parts.select(F.shiftright("bucket", p_bits - ranges).alias("bucket"), (F.col("bucket") - (1 << p_bits)).alias("chunk"), F.col("bits").alias("raw"))
        rows = asked.union(own).repartition("bucket").sortWithinPartitions("bucket", "chunk")
        answers = materialise(rows.mapInArrow(_answers(p_bits), "chunk long, bucket long, levels binary"), "answers")
        both = both.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "levels")).alias("answers")), "chunk")
    return both.mapInArrow(_scores(shared, n, v, starts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
