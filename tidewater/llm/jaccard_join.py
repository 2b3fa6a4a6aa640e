"""N-gram Jaccard join: T-occurrence search with DivideSkip inside losslessly dealt blocks.

Every document becomes the set of 64-bit hashes of its word shingles.  Equal sets collapse to one
class.

Blocks: the hash space is cut into more parts than two linked sets can differ in elements, so
linked sets agree on some whole part (pigeonhole); sets that agree on a part meet in that part's
block.  The number of parts depends on the size class of the sets; a set takes part in the scheme
of its own class and of the next one, which covers all size ratios a link allows.

Sieve: each set has a parity sketch, whose Hamming distance never exceeds the number of elements
in which two sets differ.  A block's first member leads it; all that share blocks of one lead (for
leads with many members: of one lead and second member) form a group, so a sketch is sent once a group
and not once a block.  Members of a group that no chain of close
sketches connects part ways, still without losing a link.  What stays together, over all groups,
forms clusters.

Search: a work unit holds at most ``2 * CHUNK`` sets.  Within a unit each set queries inverted
lists: the longest are set aside, the short ones are merged with a heap, and sets that occur often
enough are probed in the long lists by binary search (DivideSkip), which gives exact overlaps.  A
cluster is a unit; a large one is first searched in chunks that share a few hub sets, which is linear
work and connects most copies.  Only what is apart after that, in large clusters and in groups too large
for one sieve, takes every two chunks, and compares only sets that are not connected yet.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, ids_of, materialise, only, slices, spread_join, text_buffers, texts
from tidewater.llm.graph import connected_components
from tidewater.llm.kernels import U, Words, mix

#: Sets in one chunk; a work unit of the search holds at most two chunks.
CHUNK = 128
#: Nodes in one chunk of a large group during the sieve, where a row holds only a sketch; at most two chunks are sieved at once.
SIEVE_CHUNK = 1024
#: Sets of a large cluster that every chunk of it is searched against first.
HUBS = 4
#: The constant of DivideSkip's rule for how many long lists to set aside.
MU = 0.0085


def sets_of(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    words = Words(*text_buffers(batch.column("text")))
    flat, offs = words.shingles(width)
    return [np.unique(flat[offs[i] : offs[i + 1]]) for i in range(batch.num_rows)]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, as two signed longs."""
    two = np.array([np.sum(mix(s ^ U(0xA5A5A5A5A5A5A5A5))), np.sum(mix(s + U(0x632BE59BD9B4E019))) ^ U(len(s))], U)
    a, b = mix(two).view(np.int64)
    return int(a), int(b)


def sketch(s: np.ndarray, bits: int | None = None) -> bytes:
    """Parity sketch of a set: by default as many bits as the power of two from its size (256 to 32768)."""
    if bits is None:
        bits = 256
        while bits < len(s) and bits < 32768:
            bits *= 2
    odd = np.bincount(((s >> U(17)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sieve(sizes: list[int], sketches: list[bytes], num: int, den: int) -> list[list[int]]:
    """Groups (two members or more) that chains of sketches close enough for a link connect."""
    least = min(map(len, sketches))
    rows = np.zeros((len(sizes), least // 8), U)
    for i, raw in enumerate(sketches):  # folding halves onto each other leaves a parity sketch of fewer bits
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(raw, U).reshape(-1, least // 8), axis=0)
    n = np.array(sizes)
    left, out = np.arange(len(sizes)), []
    while len(left):
        group, todo, left = [int(left[0])], [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            far = np.bitwise_count(rows[left] ^ rows[i]).sum(axis=1, dtype=np.int64)
            near = (den + num) * far <= (den - num) * (n[left] + n[i])
            todo += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        if len(group) > 1:
            out.append(group)
    return out


def size_classes(num: int, den: int, most: int) -> list[int]:
    """Upper ends of size classes such that two linked sets are in one class or in neighbouring ones."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return ends


def parts_of(c: int, ends: list[int], num: int, den: int) -> tuple[int, int]:
    """(most elements in which linked sets of scheme c differ, number of parts)."""
    d = (den - num) * 2 * ends[c] // (den + num)
    return d, d + 2 + d // 32


def signatures(s: np.ndarray, ends: list[int], num: int, den: int) -> np.ndarray:
    """Hashes of the parts of a sorted set, under the schemes of its size class and of the next."""
    n, out = len(s), []
    c0 = int(np.searchsorted(ends, n))
    if num * (n + 1) > den * n:  # no other set can be linked with so small a one
        return np.zeros(0, U)
    cum = np.zeros(n + 1, U)
    np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)), out=cum[1:])
    high = s >> U(32)
    for c in (c0, c0 + 1):
        d, k = parts_of(c, ends, num, den)
        part = (high * U(k)) >> U(32)
        edge = np.searchsorted(part, np.arange(k + 1, dtype=U))
        sig = mix((cum[edge[1:]] - cum[edge[:-1]]) + mix(np.arange(k, dtype=U) + U(c << 32)))
        full = edge[1:] > edge[:-1]
        # Linked sets agree on at least k - d parts; only a set with that many empty ones needs those too.
        out.append(sig if k - int(full.sum()) >= k - d else sig[full])
    return np.concatenate(out)


def _identify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part, width)
                keys = [set_key(s) for s in sets]
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "sketch"],
                )

    return run


def _postings(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        ends = size_classes(num, den, 1 << 40)
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sigs, nodes = [], []
                _, ok = ids_of(part.column("doc_id"))
                for s, good in zip(sets_of(part, width), ok):
                    if not len(s) or not good:
                        continue
                    node = set_key(s)[0]
                    if node in seen:  # a copy within this task adds nothing
                        continue
                    seen.add(node)
                    got = signatures(s, ends, num, den)
                    # 48 bits: sets that meet by chance part in the sieve, and rows compress better.
                    sigs.append(got >> U(16))
                    nodes.append(np.full(len(got), node, np.int64))
                if len(seen) > 1 << 20:
                    seen.clear()
                if sigs:
                    yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sigs).view(np.int64))], ["node", "sig"])

    return run


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (sig, node): each signature's first two nodes with every node after the first."""
    only("powers")
    sig_now = lead_now = second_now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        at = np.arange(len(sig))
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = sig_now != sig[0]
        begin = np.maximum.accumulate(np.where(new, at, -1))  # -1: the signature began in an earlier batch
        lead = np.where(begin < 0, lead_now, node[begin]) if begin[0] < 0 else node[begin]
        # The second node is the first that differs from the lead; copies may repeat a node.
        other = lead != node
        first = other.copy()
        first[1:] &= ~(other[:-1] & (sig[1:] == sig[:-1]))
        if begin[0] < 0 and second_now is not None:
            first[: len(sig) if not new.any() else int(np.argmax(new))] = False
        mark = np.maximum.accumulate(np.where(first, at, -1))
        second = np.where(mark < 0, second_now, node[mark]) if len(mark) and mark[0] < 0 and second_now is not None else node[mark]
        yield pa.record_batch([pa.array(x[other].astype(np.int64)) for x in (lead, second, node)], ["lead", "second", "node"])
        sig_now, lead_now = sig[-1], lead[-1]
        second_now = second[-1] if other[-1] else None


def _needed_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part, width)
                yield pa.record_batch(
                    [pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "shingles"],
                )

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int, joined: bool = True, parts: list[int | None] | None = None) -> list[tuple[int, int]]:
    """Links (i, j), i < j, among the sets: ``den * intersection >= num * union``.

    With ``joined`` sets already connected, by links found or by equal ``parts``, are not compared, so
    the links returned connect the same sets as all links would; without it every link is
    returned.  The inverted lists of a query hold the sets that its parity sketch admits.
    """
    m = len(sets)
    if m < 2:
        return []
    up = np.arange(m)  # the smallest index of the group that each set is in
    for i, part in enumerate(parts or ()):
        if part is not None:
            up[i] = parts.index(part)
    size = np.array([len(s) for s in sets])
    bits = 64
    while bits < 2 * size.max() and bits < 8192:
        bits *= 2
    rows = np.stack([np.frombuffer(sketch(s, bits), U) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(flat)]])
    names = flat[begin]
    links = []
    for q in range(m - 1):
        n = int(size[q])
        if joined and (up == up[0]).all():
            break
        if not n:
            continue
        far = np.bitwise_count(rows[q + 1 :] ^ rows[q]).sum(axis=1, dtype=np.int64)
        near = np.zeros(m, bool)
        near[q + 1 :] = (den + num) * far <= (den - num) * (size[q + 1 :] + n)
        if joined:
            near &= up != up[q]
        if not near.any():
            continue
        at = np.searchsorted(names, sets[q])
        b, ln = begin[at], end[at] - begin[at]
        of = np.repeat(np.arange(n), ln)
        who = owner[np.repeat(b - (np.cumsum(ln) - ln), ln) + np.arange(len(of))]
        of, who = of[near[who]], who[near[who]]
        ln = np.bincount(of, minlength=n)
        ends = np.cumsum(ln)
        t = -(-num * n // den)
        some = np.flatnonzero(ln)
        if len(some) < t:
            continue
        some = some[np.argsort(ln[some], kind="stable")]
        aside = min(len(some), t - 1, int(t / (MU * log2(max(2, int(ln[some[-1]]))) + 1)))
        who = who.tolist()
        lists = [who[x:y] for x, y in zip((ends - ln)[some].tolist(), ends[some].tolist())]
        cut, need, counts = len(lists) - aside, t - aside, {}
        last, seen = -1, 0
        for i in heapq.merge(*lists[:cut]):
            if i != last:
                if seen >= need:
                    counts[last] = seen
                last, seen = i, 0
            seen += 1
        if seen >= need:
            counts[last] = seen
        for i, overlap in counts.items():
            if joined and up[i] == up[q]:
                continue
            both = n + int(size[i])
            low, left = -(-num * both // (num + den)), aside
            for one in lists[cut:]:
                if overlap + left < low:
                    break
                left -= 1
                p = bisect_left(one, i)
                overlap += p < len(one) and one[p] == i
            if den * overlap >= num * (both - overlap):
                links.append((q, i))
                up[up == max(up[q], up[i])] = min(up[q], up[i])
    return links


def _sieved(num: int, den: int, most: int):
    """Of rows sorted by (group, salt), the lead's own first: sieved groups, and chunks of groups that are not sieved whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        now, nodes, sizes, raws, parted = (None, None), [], [], [], False

        def solve(rows: list) -> None:
            if len(nodes) > 1:
                if parted:
                    rows.append((now[0], True, sorted(nodes)))
                rows += [(now[0], False, sorted(nodes[i] for i in g)) for g in sieve(sizes, raws, num, den)]

        for batch in batches:
            rows: list = []
            for group, salt, split, node, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (group, salt) != now:
                    solve(rows)
                    now, nodes, sizes, raws, parted = (group, salt), [], [], [], split
                elif len(nodes) >= most:
                    parted = True
                    solve(rows)
                    # The next chunk has the lead too, so that all chunks' members may meet through it.
                    nodes, sizes, raws = nodes[:1], sizes[:1], raws[:1]
                nodes.append(node)
                sizes.append(n)
                raws.append(raw)
            yield _group_batch(rows)
        rows = []
        solve(rows)
        yield _group_batch(rows)

    return run


def _group_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.list_(pa.int64())))], ["group", "chunk", "members"])


def _units(num: int, den: int, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("powers")
        now, nodes, sets, parts = None, [], [], []

        def solve(rows: list) -> None:
            nonlocal nodes, sets, parts
            rows += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in divide_skip(sets, num, den, joined, parts)]
            nodes, sets, parts = [], [], []

        for batch in batches:
            rows: list = []
            for unit, node, part, s in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), batch.column("part").to_pylist(), batch.column("shingles")):
                if unit != now:
                    solve(rows)
                    now = unit
                elif node == nodes[-1]:  # a row that repeats its doc_id and text
                    continue
                nodes.append(node)
                parts.append(part)
                sets.append(np.frombuffer(s.as_buffer(), U))
            yield _pairs(rows)
        rows = []
        solve(rows)
        yield _pairs(rows)

    return run


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _chunked(units: DataFrame, members: str, size: int) -> DataFrame:
    """Rows of ``units`` whose array has at most 2 * size members, and every two chunks of the others."""
    small = units.where(F.size(members) <= 2 * size).select(members)
    big = units.where(F.size(members) > 2 * size)
    count = F.ceil(F.size(members) / size).cast("int")
    pair = F.expr(f"explode(flatten(transform(sequence(0, cast(ceil(size({members}) / {size}) as int) - 2), i -> transform(sequence(i + 1, cast(ceil(size({members}) / {size}) as int) - 1), j -> struct(i, j)))))")
    tiles = big.where(count > 1).select(members, pair.alias("p"))
    return small.union(tiles.select(F.expr(f"concat(slice({members}, p.i * {size} + 1, {size}), slice({members}, p.j * {size} + 1, {size}))").alias(members)))


def jaccard_links(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, classes, links).  ids: doc_id, n_shingles, h1, h2, where (h1, h2) is the key of the row's set.

    classes: a row per distinct non-empty set: node (its h1), h2, rep (the smallest doc_id), size (its number of rows).
    links: pairs (a, b) of nodes, a < b, whose sets have Jaccard similarity num/den or more, enough of
    them to connect what all of them connect.
    """
    docs = texts(docs)
    ids = materialise(docs.mapInArrow(_identify(width), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "ids")
    worded = ids.where("doc_id is not null and n_shingles > 0").withColumnRenamed("h1", "node")
    classes = worded.groupBy("node", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    sketches = classes.select("node", "n", "sketch")

    posted = docs.mapInArrow(_postings(width, num, den), "node long, sig long")
    met = posted.repartition("sig").sortWithinPartitions("sig", "node").select("sig", "node").mapInArrow(_leads, "lead long, second long, node long").distinct()
    met = materialise(met, "met")
    # Where a lead has too many members for one sieve, those of its blocks that agree in the second node, too, form a group.
    wide = F.when(F.col("size") > 2 * SIEVE_CHUNK, F.xxhash64("lead", "second")).otherwise(F.col("lead"))
    member = spread_join(met, met.groupBy("lead").agg(F.count("*").alias("size")), ["lead"]).select(wide.alias("group"), "lead", "node").distinct()
    member = materialise(member, "member")
    # Groups with a thousandth or more of all members (at most 1000 groups) are dealt in chunks from the start.
    least = max(2 * SIEVE_CHUNK, -(-member.count() // 1000))
    hot = F.broadcast(member.groupBy("group").count().where(F.col("count") >= least).select("group", F.ceil(F.col("count") / SIEVE_CHUNK).alias("chunks")))
    split = F.col("chunks").isNotNull()
    dealt = member.join(hot, "group", "left").select("group", F.when(split, F.pmod(F.xxhash64("node"), "chunks")).otherwise(0).alias("salt"), split.alias("split"), "node", F.lit(1).alias("order"))
    own = member.select("group", "lead").distinct().join(hot, "group", "left")
    own = own.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1).cast("long")) - 1)).alias("salt"), split.alias("split"), F.col("lead").alias("node"), F.lit(0).alias("order"))
    rows = dealt.union(own).join(sketches.hint("merge"), "node").repartition("group", "salt").sortWithinPartitions("group", "salt", "order")
    rows = rows.select("group", "salt", "split", "node", "n", "sketch")
    groups = materialise(rows.mapInArrow(_sieved(num, den, 2 * SIEVE_CHUNK), "group long, chunk boolean, members array<long>"), "groups")
    discard(met, member)

    def search(units: DataFrame) -> DataFrame:
        wanted = classes.join(units.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"))
        # A repeated doc_id has a set for each of its texts; only those whose node is asked for meet a unit.
        sets = docs.join(materialise(wanted.distinct(), "wanted"), "doc_id", "left_semi").mapInArrow(_needed_sets(width), "node long, shingles binary")
        rows = units.join(sets, "node").select("unit", "node", "part", "shingles").repartition("unit").sortWithinPartitions("unit", "node")
        return materialise(rows.mapInArrow(_units(num, den, True), "a long, b long").where("a <> b").distinct(), "links")

    first = F.element_at("members", 1)
    edges = groups.where("not chunk").select(first.alias("a"), F.explode(F.slice("members", 2, 1 << 30)).alias("b"))
    cluster = connected_components(edges.distinct()).withColumnRenamed("component", "unit")
    cluster = materialise(spread_join(cluster, cluster.groupBy("unit").agg(F.count("*").alias("size")), ["unit"]).select("node", "unit", "size"), "cluster")
    big = cluster.where(F.col("size") > 2 * CHUNK)
    units = cluster.where(F.col("size") <= 2 * CHUNK).select("unit", "node").union(_with_hubs(big))
    links = search(materialise(units.withColumn("part", F.lit(None).cast("long")), "units"))
    if not big.limit(1).count() and not groups.where("chunk").limit(1).count():
        return ids, classes, links  # every pair of every group was searched

    # Large clusters were searched around their hubs only, and large groups were sieved in chunks: what is still apart there.
    part = connected_components(links).withColumnRenamed("component", "part")
    mine = groups.where("not chunk").withColumn("node", first).join(big.select("node"), "node", "left_semi").select("members")
    chunks = groups.where("chunk").select("group", F.xxhash64("members").alias("id"), "members").distinct()
    held = chunks.select("group", F.explode("members").alias("node")).join(part, "node", "left").select("group", F.coalesce("part", "node").alias("part"))
    apart = held.groupBy("group").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("group")
    chunks = materialise(chunks.join(apart, "group", "left_semi"), "chunks")
    other = chunks.select("group", F.col("id").alias("id2"), F.col("members").alias("members2"))
    tiles = chunks.join(other, "group").where("id < id2").select(F.concat("members", "members2").alias("members"))
    blocks = tiles.select(F.xxhash64("members").alias("group"), F.explode(F.array_distinct("members")).alias("node"))
    rows = blocks.distinct().join(sketches, "node").select("group", F.lit(0).alias("salt"), F.lit(False).alias("split"), "node", "n", "sketch")
    rows = rows.repartition("group").sortWithinPartitions("group")
    tiled = rows.mapInArrow(_sieved(num, den, 1 << 30), "group long, chunk boolean, members array<long>").select("members")
    mixed = materialise(mine.union(tiled).distinct(), "mixed")
    # Members in order of their parts (a group has at most four chunks of the sieve), so most chunks hold one part and few pairs of chunks are mixed.
    member = mixed.select(F.xxhash64("members").alias("g"), F.explode("members").alias("node")).join(part, "node", "left")
    ordered = member.groupBy("g").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("part", "node").alias("part"), "node"))).alias("members"))
    parts = F.transform("members", lambda m: m.part)
    several = F.array_min(parts) != F.array_max(parts)
    tiles = _chunked(ordered.where(several), "members", CHUNK).where(several).distinct()
    units = tiles.select(F.xxhash64("members").alias("unit"), F.explode("members").alias("m")).select("unit", "m.node", "m.part")
    return ids, classes, links.union(search(materialise(units, "units")))


def _with_hubs(big: DataFrame) -> DataFrame:
    """Units of chunks of the large clusters, each with the cluster's hubs: its nodes that come first by hash."""
    order = F.struct(F.xxhash64("node", F.lit(7)).alias("o"), F.col("node"))
    some = big.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.lit(1), F.expr(f"cast(size / {CHUNK // 2} as long)"))))
    hubs = some.groupBy("unit", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(HUBS)).alias("h")).agg(F.min(order).getField("node").alias("node"))
    chunks = some.select("unit", "salt").distinct().join(hubs, "unit").select("unit", "salt", "node")
    both = some.select("unit", "salt", "node").union(chunks).distinct()
    return both.select(F.xxhash64("unit", "salt").alias("unit"), "node")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links, the row's own included.  A null or
    wordless text has the empty set and is linked with nothing; a null doc_id takes no part and
    has a null component.  Rows that repeat a doc_id are one document with several texts.
    """
    ids, classes, links = jaccard_links(docs, width, num, den)
    worded = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = ids.where(worded).select("doc_id", "n_shingles", F.col("h1").alias("node"), "h2")
    # Rows of one doc_id with different texts hold their classes together.
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    own = rows.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    placed = classes.select("node", "h2", "rep", "size").join(connected_components(links.union(own)), "node", "left")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    named = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    placed = spread_join(placed.withColumnRenamed("size", "rows"), named, ["component"]).select("node", "h2", F.col("rows").alias("size"), "component_id")
    out = spread_join(rows, placed, ["node", "h2"]).select("doc_id", "n_shingles", "component_id")
    return out.union(ids.where(~F.coalesce(worded, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
