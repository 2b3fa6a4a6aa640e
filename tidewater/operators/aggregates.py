"""Histograms, percentiles over them, and sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import catalyst

#: Most bits of a Bloom filter with a chosen number of hashes whose words become one array (1 MB); a larger one is cut into segments.
BLOOM_BITS = 1 << 23
#: Bits of a segment; a value's bits all lie in one, so a probe of a larger filter is one join.
BLOOM_SEGMENT = 1 << 16


def histogram(df: DataFrame, groups: Sequence[str], value: str, freq: str | None = None) -> DataFrame:
    """Per group the array of (value, freq); counted in two steps so only distinct values are gathered.

    A null or negative ``freq`` fails the query; values whose frequencies sum to 0 are left out, and a group of such values only has a null.
    """
    if freq is None:
        n = F.count("*")
    else:
        bad = F.col(freq).isNull() | (F.col(freq) < 0)
        n = F.sum(F.when(bad, F.raise_error(F.lit("a frequency must not be null or negative")).cast("long")).otherwise(F.col(freq)))
    counts = df.groupBy(*groups, value).agg(n.alias("freq"))
    some = F.collect_list(F.when(F.col("freq") > 0, F.struct(F.col(value).alias("value"), "freq")))
    return counts.groupBy(*groups).agg(F.when(F.size(some) > 0, F.array_sort(some)).alias("histogram"))


def percentiles(value: Column, freq: Column, points: Sequence[float]) -> Column:
    """Aggregate: exact percentiles with linear interpolation of values with frequencies; zero frequencies don't count."""
    return F.percentile(value, F.array(*map(F.lit, points)), freq)


def hll_registers(df: DataFrame, groups: Sequence[str], value: str, precision: int = 9) -> DataFrame:
    """Registers (group, index, rank) of a HyperLogLog sketch by xxhash64; sketches merge by max(rank)."""
    if not 4 <= precision <= 18:
        raise ValueError("precision must be 4 to 18")
    h = F.xxhash64(value)
    index = F.shiftrightunsigned(h, 64 - precision)
    rest = F.shiftleft(h, precision).bitwiseOR(F.lit(1 << (precision - 1)).cast("long"))
    # With all bits below the highest one set, their number tells how many zeros lead.
    filled = rest
    for shift in (1, 2, 4, 8, 16, 32):
        filled = filled.bitwiseOR(F.shiftrightunsigned(filled, shift))
    rank = 65 - F.bit_count(filled)
    return df.where(F.col(value).isNotNull()).groupBy(*groups, index.alias("index")).agg(F.max(rank).alias("rank"))


def hll_merge(first: DataFrame, *others: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Registers of the union of what several sketches of one precision saw."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out.groupBy(*groups, "index").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, groups: Sequence[str], precision: int = 9) -> DataFrame:
    """Estimated distinct count per group from registers, with linear counting for small sets."""
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m) if m >= 128 else {16: 0.673, 32: 0.697, 64: 0.709}[m]
    s = F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    raw = F.lit(alpha * m * m) / (s + (F.lit(m) - F.count("*")))
    empty = F.lit(m) - F.count("*")
    est = F.when((raw <= 2.5 * m) & (empty > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / empty)).otherwise(raw)
    return registers.groupBy(*groups).agg(F.round(est).cast("long").alias("estimate"))


def _bloom_size(bits: int) -> int:
    unit = 64 if bits <= BLOOM_BITS else BLOOM_SEGMENT
    return -(-bits // unit) * unit


def _bloom_segment(col: Column, bits: int) -> Column:
    return F.pmod(catalyst.murmur3(col, seed=1).cast("long"), F.lit(bits // BLOOM_SEGMENT))


def _bloom_positions(col: Column, hashes: int, bits: int) -> Column:
    """The bits of a long: double hashing, the second hash seeded by the first, which chaining the column twice gives."""
    one, two = catalyst.murmur3(col, seed=0).cast("long"), catalyst.murmur3(col, col, seed=0).cast("long")

    def position(i: Column) -> Column:
        low = (one + i * two).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(low >= 2**31, F.lit(0xFFFFFFFF) - low).otherwise(low) % bits

    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(hashes).cast("long")), position)


def bloom_words(df: DataFrame, col: Column, hashes: int, bits: int) -> DataFrame:
    """Bloom filter of a bigint column with a chosen number of hashes, as its non-zero 64-bit words (word, bits).

    Nulls are skipped; ``bits`` is rounded up to a multiple of 64, beyond ``BLOOM_BITS`` to one of ``BLOOM_SEGMENT``.
    """
    if hashes < 1 or bits < 1:
        raise ValueError("hashes and bits must be positive")
    some, size = df.where(col.isNotNull()), _bloom_size(bits)
    if size <= BLOOM_BITS:
        at = some.select(F.explode(_bloom_positions(col, hashes, size)).alias("p"))
    else:
        at = some.select(_bloom_segment(col, size).alias("s"), F.explode(_bloom_positions(col, hashes, BLOOM_SEGMENT)).alias("p"))
        at = at.select((F.col("s") * BLOOM_SEGMENT + F.col("p")).alias("p"))
    return at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))


def bloom_merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Words of the union of what several filters with the same hashes and bits hold."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _bloom_arrays(words: DataFrame, size: int, *groups: Column) -> DataFrame:
    """All words in order, those that are 0 too, as one array a group."""
    dense = words.sparkSession.range(size // 64).select(F.col("id").alias("word")).join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w.bits).alias("words"))


def _bloom_hit(array: Column, col: Column, hashes: int, bits: int) -> Column:
    hit = lambda p: F.call_function("shiftright", F.get(array, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    at, out = _bloom_positions(col, hashes, bits), col.isNotNull()
    for i in range(hashes):
        out = out & hit(F.get(at, i))
    return F.when(col.isNotNull(), out)


def bloom_probe(words: DataFrame, col: Column, hashes: int, bits: int) -> Column:
    """Whether a filter of at most ``BLOOM_BITS`` may hold a value (null for null); the filter becomes one array. ``bloom_hits`` has no such bound."""
    size = _bloom_size(bits)
    if size > BLOOM_BITS:
        raise ValueError(f"a filter of more than {BLOOM_BITS} bits is probed by bloom_hits")
    return _bloom_hit(_bloom_arrays(words, size).scalar(), col, hashes, size)


def bloom_hits(df: DataFrame, words: DataFrame, col: Column, hashes: int, bits: int, name: str = "hit") -> DataFrame:
    """``df`` with a column that tells whether a filter of any size may hold a value (null for null); a filter beyond
    ``BLOOM_BITS`` is joined by segment, each an array of ``BLOOM_SEGMENT`` bits."""
    size = _bloom_size(bits)
    if size <= BLOOM_BITS:
        return df.withColumn(name, bloom_probe(words, col, hashes, bits))
    segments = _bloom_arrays(words, size, F.shiftright("word", (BLOOM_SEGMENT // 64).bit_length() - 1).alias("segment"))
    rows = df.select(F.struct("*").alias("row"), col.alias("value"), F.when(col.isNotNull(), _bloom_segment(col, size)).alias("segment"))
    return rows.join(segments, "segment", "left").select("row.*", _bloom_hit(F.col("words"), F.col("value"), hashes, BLOOM_SEGMENT).alias(name))
