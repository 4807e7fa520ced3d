"""Periodic runs of words: maximal stretches with a smallest period that fits in them several times.

Texts stay where they are read; each batch is worked on map-side, as runs never leave a document.

1. Every stretch of ``seed_words`` words inside a long run recurs in the same document (by the run's period, to the left or the right). So the words are covered by
   those n-grams that recur, found by one sort of rolling hashes, and what is covered in a row is a segment. A run lies in one segment, and where it ends it ends in
   the document too. A segment is shorter than its document, in plain prose there is none; nothing else is left out.
2. The segments of a batch are put one behind the other, a letter of its own between each two, so that no run spans two. A suffix array by prefix doubling and its LCP
   give the longest-previous-factor array, and that the LZ blocks.
3. Main: a run that crosses or touches a block's start is found by extending both ways from there, for all periods at once by Z arrays, in a window whose size is bounded by
   the two blocks beside it.
4. A run strictly inside a block has a copy in the block's previous occurrence; runs are kept in buckets by their starts and copied from there, left to right.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3  # words of a run at least, and periods that it has to hold
CHUNK = 1 << 17  # words of segments that are worked on together; a longer segment is one chunk
FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed binary, n_words long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def seed_words(least: int, times: int) -> int:
    """m such that any m words of a run of at least max(least, times * q) words recur q words away inside it: m - 1 <= length - 2 * q, for the longest such q."""
    if times < 3 or least < times:
        raise ValueError("a run has to hold its period three times at least")
    # length - 2 q is least where q = length // times
    return 1 + min(n - 2 * (n // times) for n in range(least, least + 2 * times))


def segments(codes: np.ndarray, m: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` words that are covered by m-grams which recur in ``codes`` (equal hashes count as equal, which only covers more)."""
    n = len(codes)
    if n < least:
        return []
    grams = np.zeros(n - m + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(m):
            grams = grams * _ODD + codes[i : i + n - m + 1]
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    at = np.searchsorted(again, grams)
    hit = again[np.minimum(at, len(again) - 1)] == grams
    edge = np.zeros(n + 1, np.int64)
    edge[: n - m + 1] += hit
    edge[m:] -= hit
    covered = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
    turn = np.flatnonzero(np.diff(covered))
    return [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2], strict=True) if b - a >= least]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, rank, lcp with the suffix before) by prefix doubling; the ranks of all lengths are kept, so that an LCP is read off from the longest down."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank, width = new, width * 2
        if not n or rank[order[-1]] == n - 1:
            break
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        # a rank of width w stands for w letters only if so many are left; the letter behind the text is its own, so that equal ranks mean it
        step = same.astype(np.int64) << level
        common, a, b = common + step, a + step, b + step
    return order, rank, np.concatenate(([0], common)) if n else common


def longest_previous(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """(length, place) of the longest factor at each position that also starts further left; from the last position on, each suffix is taken out of the list of suffixes in
    lexicographic order, where its neighbours are then its nearest earlier ones."""
    n = len(order)
    sa, at, up = order.tolist(), rank.tolist(), lcp.tolist() + [0]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    length, place = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = at[i]
        p, q = before[r], after[r]
        low, high = up[r], up[q]
        if low >= high:
            length[i], place[i] = low, sa[p] if low else -1
        else:
            length[i], place[i] = high, sa[q]
        if q < n:
            before[q] = p
            up[q] = low if low < high else high
        if p >= 0:
            after[p] = q
    return length, place


def blocks(length: list[int], place: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of the previous occurrence or -1) of the LZ blocks."""
    out, i = [], 0
    while i < len(length):
        size = max(1, length[i])
        out.append((i, i + size, place[i] if length[i] else -1))
        i += size
    return out


def z_array(s: list[int]) -> list[int]:
    """How many letters at each position agree with the text's beginning."""
    n = len(s)
    z, lo, hi = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def around(text: list[int], before: int, s: int, end: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Main's step: (start, end, period) of the runs that cross or touch ``s``, the start of the block up to ``end``, and end in it; ``before`` is the start of the block before it.

    A run [b, e) of period q with s < e <= end has b > before - q, as the block before would otherwise be longer; so times * q < (end - before) + q bounds q.
    Runs that end at s or start there and lie in a block have shorter periods still. What goes on behind ``end`` is found at a later block.
    """
    q_max = (end - before) // (times - 1)
    if (end - before) + q_max < least:
        return
    lo, hi = max(0, before - q_max), min(len(text), end + 1)
    left, right = text[lo:s], text[s:hi]
    both, back = text[lo:hi], text[lo:s][::-1]
    fore = z_array(right)  # of (s, s + q)
    fore_left = z_array([*right, -1, *both])  # of (s - q, s)
    back_left = z_array(back)  # of (s - 1, s - 1 - q)
    back_right = z_array([*back, -1, *both[::-1]])  # of (s - 1, s - 1 + q)
    n_left, n_right, n_both = len(left), len(right), len(both)
    for q in range(1, q_max + 1):
        found = []
        if q <= n_right:  # one period at least right of s
            ahead = fore[q] if q < n_right else 0
            behind = back_right[n_left + 1 + n_right - q] if n_left else 0
            found.append((s - behind, s + q + ahead))
        if q <= n_left:  # one at least left of s
            ahead = fore_left[n_right + 1 + n_left - q] if n_right else 0
            behind = back_left[q] if q < n_left else 0
            found.append((s - q - behind, s + ahead))
        for b, e in found:
            if e - b >= max(least, times * q) and s <= e <= end and (b > before - q or b == 0):
                yield b, e, q


def find_runs(text: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All (start, end, period) of maximal runs of at least max(least, times * period) letters, sorted. ``text``: numbers from 0."""
    if not text:
        return []
    letters = np.array([*text, max(text) + 1], np.int64)  # a last letter of its own ends every run before it
    cut = blocks(*longest_previous(*suffix_array(letters)))
    whole = letters.tolist()
    period: dict[tuple[int, int], int] = {}
    ends: dict[int, list[int]] = {}  # buckets: the ends of the runs that start at a place
    starts: list[int] = []

    def add(b: int, e: int, q: int) -> None:
        known = period.get((b, e))
        if known is None:
            if b not in ends:
                ends[b] = []
                insort(starts, b)
            insort(ends[b], e)
        if known is None or q < known:  # multiples of a period have the same stretch
            period[b, e] = q

    before = 0
    for s, end, source in cut:
        for b, e, q in around(whole, before, s, end, least, times):
            add(b, e, q)
        if source >= 0 and end - s > least:
            shift, at = s - source, bisect_right(starts, source)
            while at < len(starts) and starts[at] < source + end - s - 1:  # grows while a block copies from itself
                b = starts[at]
                inside = bisect_left(ends[b], source + end - s)
                for e in ends[b][:inside]:
                    add(b + shift, e + shift, period[b, e])
                at += 1
        before = s
    return sorted((b, e, q) for (b, e), q in period.items())


def runs_of_documents(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document's words."""
    m = seed_words(least, times)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list[bytes]]] = []

    def work() -> None:
        letters: list[int] = []
        spots, names = [], {}
        for doc, a, words in waiting:
            spots.append(len(letters))
            letters += [names.setdefault(w, len(names)) for w in words]
            letters.append(names.setdefault((doc, a), len(names)))  # a letter of its own
        for b, e, q in find_runs(letters, least, times):
            k = bisect_right(spots, b) - 1
            doc, a, _ = waiting[k]
            found[doc].append((b - spots[k] + a, e - spots[k] + a, q))
        waiting.clear()

    size = 0
    for doc, words in enumerate(texts):
        if len(words) < least:
            continue
        codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        for a, b in segments(codes, m, least):
            waiting.append((doc, a, words[a:b]))
            size += b - a
        if size >= CHUNK:
            work()
            size = 0
    work()
    return [sorted(f) for f in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for b, e, q in runs:
        edge[b + q] += 1
        edge[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _finder(least: int, times: int):
    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # so many rows at once as make a chunk of text, one at least
                rows = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * CHUNK)) - at)
                some = batch.slice(at, rows)
                texts = [(t or b"").split() for t in some.column(1).to_pylist()]  # bytes split at exactly the six white spaces
                found = runs_of_documents(texts, least, times)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                cols = [
                    pa.array([[{"start": b, "length": e - b, "period": q} for b, e, q in sorted(f, key=lambda r: (r[0], r[2]))] for f in found], kind),
                    pa.array([b" ".join(collapse(w, f)) for w, f in zip(texts, found, strict=True)], pa.binary()),
                    pa.array([len(w) for w in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols], ["id", "runs", "collapsed", "n_words"])
                at += rows

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, runs, collapsed, n_words) for each row of ``docs``, whose other columns may have any names and are left out.

    ``runs``: array of (start, length, period) by start, then period: the maximal stretches of words that hold their smallest period ``times`` times and at least ``least``
    words. ``collapsed``: the text's words joined by blanks, less those that a run holds behind its first period. A null or empty text has no words and no
    runs and collapses to an empty text. Rows that repeat an id, a null one too, each get their own result. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("_text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_finder(least, times), f"id {kind}, {FOUND}")
    return out.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"), "n_words")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, in which the words from place a on repeat with period p if the id's CRC-32 ends in 0: a and p are drawn from the CRC's other digits."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i))), " ")

    # the words are an array of one element, so that they are split once
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)))[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), F.coalesce(made, text)).otherwise(text)


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, of equals the first; null where there is none. Compared by cross products, exactly."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of a line ``start,length,period`` for each run."""
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)
