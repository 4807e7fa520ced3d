"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands.

Texts are tokenised once, map-side, into pieces of at most ``capacity`` ids; only the pieces' lengths and checksums move.
The search starts from one best-fit-decreasing packing of all pieces. That needs no more than how often each length occurs, at most ``capacity`` numbers: bins of the same
contents are counted, not listed, and each piece learns its bin from its number among those of its length.
Whole bins of this packing are dealt by hash into blocks of about ``BLOCK`` pieces, so that work grows in proportion to the input and no task
holds more than a block. Each block is packed on several islands, rows of one table that any executor can take: an island
evolves packings whose genes are whole bins (Falkenauer's grouping genetic algorithm with replacement), the block's own bins among them, and between the epochs each
island's elite is sent on to the next island by a join. The best packing of each block is never worse than the bins it was dealt. All bins that are not full to the last place, of all blocks,
are then dealt into blocks of about ``REST`` pieces and packed again, until they are one block; so there are never more sequences than one best fit of everything needs.
"""

from __future__ import annotations

import base64
import math
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import Scratch

BLOCK = 3072
REST = 768  # pieces of a block of what isn't full, all of which the search moves
ROWS_PER_TASK = 6  # islands that a task evolves; their rows are so small that Spark would put them all in one task
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 5, 6
OPEN = 500  # pieces of a block that the search moves at least
SPECIAL = {"<|endoftext|>": 50256}  # the only one of byte_bpe_50k.json; the rank file has none
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_path: str):
    """The byte-level BPE of byte_bpe_50k.json from the same vocabulary's rank file, which gives the same ids faster; ``SPECIAL`` are the same special tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _cutter(capacity: int, end_id: int, ranks_path: str):
    def run(batches):
        enc = encoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                    ids = enc.encode_to_numpy(text or "", allowed_special="all")
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    count = -(-n // capacity)
                    first = n - capacity * (count - 1)
                    for p in range(count):
                        lo = 0 if p == 0 else first + capacity * (p - 1)
                        hi = first + capacity * p
                        rows.append((doc, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None) -> DataFrame:
    """Token pieces of every text, null as empty: of a text of n ids the first piece has what is over, all others ``capacity``."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_cutter(capacity, end_id, ranks_path or default_vocabulary()), PIECES)


class BestFit:
    """Open bins by room left; the fullest bin that still fits is found by one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []

    def open(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        if room:
            self.by_room[room].append(len(self.bins) - 1)
            self.mask |= 1 << room

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.open([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.by_room[room]
        b = at.pop()
        if not at:
            self.mask ^= 1 << room
        self.bins[b].append(item)
        if room > size:
            self.by_room[room - size].append(b)
            self.mask |= 1 << (room - size)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's sum of squared fills, which favours few well-filled bins; lower is better."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def best_fit(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    fit = BestFit(capacity)
    for i in order:
        fit.put(i, sizes[i])
    return fit.bins


def improve(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Fill bins better with displaced documents: in each, one document gives way to the largest displaced one that fits in its place, or
    two to one, or one to two. What is left over is smaller and so easier to place (Falkenauer's replacement)."""
    waiting = sorted((sizes[i], i) for i in displaced)
    out = []
    for x in bins:
        fill = sum(sizes[i] for i in x)
        x, tries = list(x), 0
        while fill < capacity and waiting and tries < 4:
            tries += 1
            room, best = capacity - fill, (0, None, None)
            for k, i in enumerate(x):  # one for one
                at = bisect_left(waiting, (sizes[i] + room + 1,)) - 1
                gain = waiting[at][0] - sizes[i] if at >= 0 else 0
                if gain > best[0]:
                    best = (gain, [k], [at])
                if gain < room and len(waiting) > 1 and sizes[i] > 2:  # one for two: a large one and the best beside it
                    for big in {at, at // 2}:
                        if big >= 0:
                            other = bisect_left(waiting, (sizes[i] + room - waiting[big][0] + 1,)) - 1
                            other = other - 1 if other == big else other
                            if other >= 0 and other != big and waiting[big][0] + waiting[other][0] - sizes[i] > best[0] and waiting[big][0] + waiting[other][0] - sizes[i] <= room:
                                best = (waiting[big][0] + waiting[other][0] - sizes[i], [k], sorted((big, other)))
                for k2 in range(k + 1, min(len(x), 6)):  # two for one
                    both = sizes[i] + sizes[x[k2]]
                    at = bisect_left(waiting, (both + room + 1,)) - 1
                    if at >= 0 and waiting[at][0] - both > best[0]:
                        best = (waiting[at][0] - both, [k, k2], [at])
            if best[1] is None:
                break
            came = [waiting[at][1] for at in best[2]]
            for at in reversed(best[2]):
                waiting.pop(at)
            went = [x[k] for k in best[1]]
            x = [i for k, i in enumerate(x) if k not in best[1]] + came
            for i in went:
                insort(waiting, (sizes[i], i))
            fill += best[0]
        out.append(x)
    return out, [i for _, i in waiting]


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject whole well-filled bins of ``b`` into ``a``: bins of ``a`` that share a document with them go, some of the worst filled are dissolved (mutation), and
    the documents so displaced first replace others where that fills a bin better and are then best-fitted, longest first."""
    fill = [sum(sizes[i] for i in x) for x in b]
    well = [x for x, f in zip(b, fill, strict=True) if f >= 0.98 * capacity and len(x) > 1]
    chosen = rng.sample(well, max(1, int(len(well) * rng.uniform(0.1, 0.5)))) if well else []
    inside = {i for x in chosen for i in x}
    whole, displaced = [list(x) for x in chosen], []
    worst = rng.random() * 0.1
    for x in a:
        f = sum(sizes[i] for i in x)
        if not inside.isdisjoint(x):
            displaced += [i for i in x if i not in inside]
        elif f < capacity and rng.random() < worst + 2 * (capacity - f) / capacity:
            displaced += x
        else:
            whole.append(x)
    whole, displaced = improve(whole, displaced, sizes, capacity)
    fit = BestFit(capacity)
    for x in whole:
        fit.open(x, capacity - sum(sizes[i] for i in x))
    displaced.sort(key=lambda i: -sizes[i])
    for i in displaced:
        fit.put(i, sizes[i])
    return fit.bins


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, generations: int, size: int, rng: random.Random) -> list[list[list[int]]]:
    """The population after some generations, best first; it stops at the lower bound."""
    least = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(population) < size:
        noise = 0 if not population else rng.random() * 0.2
        population.append(best_fit(sorted(order, key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5))) if noise else order, sizes, capacity))
    rank = lambda p: fitness(p, sizes, capacity)
    ranked = sorted(((rank(p), n, p) for n, p in enumerate(population)))[:size]
    count = len(population)
    for _ in range(generations):
        if not sizes or ranked[0][0][0] <= least:
            break
        for _ in range(max(1, size // 2)):
            child = crossover(ranked[min(rng.randrange(size), rng.randrange(size))][2], rng.choice(ranked)[2], sizes, capacity, rng)
            count += 1
            ranked.append((rank(child), count, child))
        ranked = sorted(ranked)[:size]
    return [p for _, _, p in ranked]


def closed(bins: list[list[int]], sizes: list[int], capacity: int, free: int = OPEN) -> list[list[int]]:
    """Those of the bins that are full to the last place, but for some so that at least ``free`` pieces stay in play. The same on every island."""
    full = [x for x in bins if sum(sizes[i] for i in x) == capacity]
    full.sort(key=lambda x: (len(x), x))  # single pieces first, which nothing can improve
    left = len(sizes) - sum(map(len, full))
    while full and left < free and len(full[-1]) > 1:
        left += len(full.pop())
    return full


def search(elites: list[list[int]], sizes: list[int], capacity: int, generations: int, size: int, rng: random.Random, seed: list[int] | None = None) -> list[list[list[int]]]:
    """``evolve`` over the pieces outside the closed bins of ``seed``, a packing (by default best fit's); ``elites`` and the result are packings of all pieces, the closed bins first."""
    full = closed(best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity) if seed is None else unflat(seed), sizes, capacity)
    inside = {i for x in full for i in x}
    open_ = [i for i in range(len(sizes)) if i not in inside]
    name = {i: n for n, i in enumerate(open_)}
    population = [[[name[i] for i in x] for x in unflat(e) if x[0] not in inside] for e in elites]
    found = evolve(population, [sizes[i] for i in open_], capacity, generations, size, rng)
    return [[*full, *([open_[n] for n in x] for x in p)] for p in found]


def flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def unflat(flat_bins: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(flat_bins):
        out.setdefault(k, []).append(i)
    return list(out.values())


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(contents, how many bins) of the best-fit-decreasing packing of ``counts`` pieces by length; contents are (length, how many). Equal bins are one group throughout, of which a
    length splits two at most, so that there are no more than a few groups per length however many pieces there are."""
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    mask = 0

    def keep(contents, n: int, room: int) -> None:
        nonlocal mask
        if n:
            by_room.setdefault(room, []).append((contents, n))
            mask |= (1 << room) if room else 0

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = mask >> size
            if fits:  # the fullest bins that the length fits in; each takes as many as it can, as it is then the fullest
                room = size + (fits & -fits).bit_length() - 1
                contents, n = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
            else:
                room, contents, n = capacity, (), -(-left // (capacity // size))
            each = room // size
            whole = min(n, left // each)
            keep((*contents, (size, each)), whole, room - each * size)
            left -= whole * each
            n -= whole
            if left and n:
                keep((*contents, (size, left)), 1, room - left * size)
                left, n = 0, n - 1
            if contents:
                keep(contents, n, room)
    return [group for groups in by_room.values() for group in groups]


def _bins(counts: dict[int, int], capacity: int):
    """Adds to pieces (doc_id, piece, start, length, ids_crc32, nth) the number of their bin in the best-fit packing."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, base = dict.fromkeys(counts, 0), 0
    for contents, n in patterns(counts, capacity):
        for size, each in contents:
            slots.setdefault(size, []).append((used[size], base, each))
            used[size] += n * each
        base += n
    held = {size: np.array(x, np.int64).T for size, x in slots.items()}

    def run(batches):
        for batch in batches:
            length, nth = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            bins = np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                first, base, each = held[int(size)]
                at = np.searchsorted(first, nth[mine], side="right") - 1
                bins[mine] = base[at] + (nth[mine] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins)], [*batch.schema.names[:5], "bin"])

    return run


def _seeded(cut: DataFrame, capacity: int, block: int) -> DataFrame:
    """The pieces with their bin in one best-fit packing of all. A length that many pieces share is numbered in parts, whose beginnings are sums of the counts before."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    parts = max(1, -(-sum(counts.values()) // (4 * block)))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("place", place).join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
    return numbered.select(*cut.columns, (F.col("place") + F.col("before")).cast("long").alias("nth")).mapInArrow(_bins(counts, capacity), f"{PIECES}, bin long")


ISLAND = "block long, island int, sizes array<int>, seed array<long>, elite array<array<int>>, bins int, fill double"


def _epoch(epoch: int, capacity: int, generations: int, size: int):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rng = random.Random(f"{r['block']} {r['island']} {epoch}")
                sizes = r["sizes"]
                found = search(r["elite"] or [r["seed"]], sizes, capacity, generations, size, rng, r["seed"])
                bins, fill = fitness(found[0], sizes, capacity)
                out.append({"block": r["block"], "island": r["island"], "sizes": sizes, "seed": r["seed"], "elite": [flat(x, len(sizes)) for x in found[:2]], "bins": bins, "fill": fill})
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", numbers), ("seed", pa.list_(pa.int64())), ("elite", pa.list_(numbers)), ("bins", pa.int32()), ("fill", pa.float64())]))

    return run


def _packed(scratch: Scratch, name: str, dealt: DataFrame, first_block: int, blocks: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """The pieces, which come with a bin, with the block and bin that they are put in, and that bin's fill."""
    dealt = dealt.withColumn("block", (F.pmod(F.xxhash64("bin"), F.lit(blocks)) + first_block).cast("long"))
    item = F.struct((-F.col("length")).alias("key"), "doc_id", "piece", "start", "ids_crc32", "bin")
    held = scratch.table(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), f"{name}-blocks")
    sizes, seed = F.transform("items", lambda x: (-x["key"]).cast("int")), F.transform("items", lambda x: x["bin"])
    each = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = held.select("block", each, sizes.alias("sizes"), seed.alias("seed"), F.lit(None).cast("array<array<int>>").alias("elite"))
    state = scratch.table(state.repartition(math.ceil(blocks * islands / ROWS_PER_TASK), "block", "island").mapInArrow(_epoch(0, capacity, generations, POPULATION), ISLAND), f"{name}-epoch-0")
    for e in range(1, epochs):
        sent = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guests"))
        met = state.join(sent, ["block", "island"]).select("block", "island", "sizes", "seed", F.concat("elite", "guests").alias("elite"))
        state = scratch.table(met.mapInArrow(_epoch(e, capacity, generations, POPULATION), ISLAND), f"{name}-epoch-{e}")
        scratch.drop(f"{name}-epoch-{e - 1}")
    best = state.groupBy("block").agg(F.min_by(F.col("elite")[0], F.struct("bins", "fill", "island")).alias("bin"))
    rows = held.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bin")).alias("x"))
    rows = rows.select("block", F.col("x.bin").alias("bin"), F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.piece").alias("piece"), F.col("x.items.start").alias("start"), (-F.col("x.items.key")).alias("length"), F.col("x.items.ids_crc32").alias("ids_crc32"))
    # a sequence has at most ``capacity`` pieces
    before = Window.partitionBy("block", "bin").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).withColumn("fill", F.sum("length").over(Window.partitionBy("block", "bin")))
    return scratch.table(rows.withColumn("bin", F.col("block") * F.lit(2**32) + F.col("bin")), f"{name}-rows")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Every text ends with ``end_id``; a null
    text is an empty one, that is one piece of length 1. Null ids, repeated ids and repeated rows are packed like any others.
    An empty table gives an empty result. There are never more sequences than one best-fit-decreasing packing of all pieces has.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(pieces(docs, id_col, text_col, capacity, end_id, ranks_path), "pieces")
    seeded = scratch.table(_seeded(cut, capacity, block), "seeded")
    alone = F.col("length") == capacity  # a sequence of its own
    out = seeded.where(alone).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("bin")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, level, first = seeded.where(~alone), 0, 0
    left = open_.count()
    while left:
        blocks = max(1, math.ceil(left / (min(block, REST) if level else block)))
        rows = _packed(scratch, f"level-{level}", open_, first, blocks, capacity, islands, epochs, generations)
        full = F.col("fill") == capacity
        open_ = rows.where(~full)
        before, left = left, open_.count()
        if blocks == 1 or 2 * left > before:  # all in one block, or lengths that fill few bins to the last place wherever they are
            full, left = F.lit(True), 0
        out = out.unionByName(rows.where(full).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"))
        level, first = level + 1, first + blocks
    return out
