"""Media columns: payloads as media files, stored as content-defined chunks.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples of an 8-bit mono WAV file. What follows the file's header is cut
where a rolling gear hash of the last 32 bytes says so, within a least and a greatest chunk size; so equal passages give equal
chunks wherever they stand. The store has a row per different text, with its header, its ordered chunk list and the bytes of the chunks that only
it has; rows of packs, which hold each chunk that several texts have (or one text several times) once; and a row per document whose text others have too, which
names that text. Which texts and which chunks are met again is counted on 64-bit hashes; Bloom filters of fixed size carry the answer to the tasks that
read the texts. So texts that no other document has are stored where they are read and never shuffled; copies are shuffled once, shared
chunks once. What a filter lets through by mistake is only shuffled in vain. Reading back takes a text's own chunks from its row and fetches only the others by a
join on their digests, checks the digest of every chunk and of the whole file, and parses the file, once per different text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import Scratch

LEAST, MASK_BITS, GREATEST = 256, 8, 32768  # some 460 bytes a chunk, three in a document of middling size, so that passages shared by short documents are found
BLOOM_BITS = 1 << 26  # 8 MB, sent to all executors
RATE = 8000
HEADER = 44
PACK = 256  # shared chunks in a row of the store, which are compressed together
HOT = 512  # documents of one text that are given its features together


def _gear() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


GEAR = _gear()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def payload(text: str | None) -> tuple[bytes, int]:
    raw = utf8(text)
    return padded(raw), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples


def from_wav(media: bytes) -> bytes:
    kind, size, form = struct.unpack_from("<4sI4s", media)
    at = 12
    if kind != b"RIFF" or form != b"WAVE" or size != len(media) - 8:
        raise ValueError("not a WAV file")
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def cuts(media: bytes, least: int = LEAST, bits: int = MASK_BITS, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks. The gear hash after a byte is the sum, mod 2**32, of its last 32 bytes' values, each doubled once per byte since; it is computed for all places at once by doubling the span five times."""
    n = len(media)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(marks, start + least)
        end = int(min(marks[i] if i < len(marks) else n, start + greatest, n))
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    for end in cuts(media):
        part = media[at:end]
        out.append((xxhash.xxh3_128_digest(part), part))
        at = end
    return out


def features(samples: bytes) -> str:
    """Mean, standard deviation, zero crossings around the middle and the peak of the samples."""
    x = np.frombuffer(samples, np.uint8)
    side = x >= 128
    return f"n={len(x)};mean={x.mean():.4f};std={x.std():.4f};cross={int((side[1:] != side[:-1]).sum())};peak={int(x.max())}"


ROW = "kind string, doc_id long, key binary, n_bytes long, media_sha256 string, head binary, digests array<binary>, refs array<int>, own binary"
_ROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("head", pa.binary()), ("digests", pa.list_(pa.binary())), ("refs", pa.list_(pa.int32())), ("own", pa.binary())])
ONE, COPIED, SHARED, NAME = "one", "copied", "shared", "name"  # kinds of rows: the text of one document, a text of several, a pack of shared chunks, a document of a text of several
LEVEL = 3


def packed(parts: list[tuple[bytes, bytes]], gone: set[int], z: zstandard.ZstdCompressor) -> bytes:
    """The sizes of all chunks, 0 for those in ``gone``, and the bytes of the others, compressed together."""
    sizes = [0 if i in gone else len(p) for i, (_, p) in enumerate(parts)]
    return struct.pack(f"<{len(parts)}I", *sizes) + z.compress(b"".join(p for i, (_, p) in enumerate(parts) if i not in gone))


class Bloom:
    """Which 64-bit hashes may be met again, in a bit table of fixed size. More hashes than it is made for only make it say "may" more often."""

    def __init__(self, words: dict[int, int]):
        self.bits = np.zeros(BLOOM_BITS // 64, np.uint64)
        for at, word in words.items():
            self.bits[at] = np.uint64(word & (2**64 - 1))

    def may(self, hashes: np.ndarray) -> np.ndarray:
        h, out = hashes.astype(np.uint64), np.ones(len(hashes), bool)
        for p in (h & np.uint64(BLOOM_BITS - 1), h >> np.uint64(32) & np.uint64(BLOOM_BITS - 1)):
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(hashes: DataFrame) -> Bloom:
    """Of the values that the column ``h`` has more than once. At most one row per word of the table comes to the driver."""
    again = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    place = F.array(F.col("h").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BLOOM_BITS - 1))
    at = again.select(F.explode(place).alias("p")).select(F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = at.groupBy("at").agg(F.bit_or("bit").alias("word"))
    return Bloom({r["at"]: r["word"] for r in words.toLocalIterator()})


def _copies(copied, names: bool):
    """Of the rows whose text others may have too: (doc_id, key), or the texts, compressed for the shuffle."""

    def run(batches):
        z, seen = zstandard.ZstdCompressor(level=LEVEL), copied.value
        for batch in batches:
            batch = batch.filter(pa.array(seen.may(batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, 512):
                raw = [utf8(t) for t in batch.column(1)[at : at + 512].to_pylist()]
                keys = pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary())
                if names:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], keys], ["doc_id", "key"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array([z.compress(r) for r in raw], pa.binary())], ["key", "z"])

    return run


def _singles(copied):
    """A reader of rows (doc_id, text, h): lists of (kind, doc_id, bytes of the text) of the texts that no other row has."""

    def read(batches):
        seen = copied.value
        for batch in batches:
            batch = batch.filter(pa.array(~seen.may(batch.column(2).to_numpy())))
            for at in range(0, batch.num_rows, 512):
                yield [(ONE, d, utf8(t)) for d, t in zip(batch.column(0)[at : at + 512].to_pylist(), batch.column(1)[at : at + 512].to_pylist(), strict=True)]

    return read


def _unpacked(batches):
    """The same of rows (key, z)."""
    back = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield [(COPIED, None, back.decompress(z)) for z in batch.column(1)[at : at + 512].to_pylist()]


def hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _chunk_hashes(read):
    """A hash of every different chunk of a text."""

    def run(batches):
        for texts in read(batches):
            found = [hashes(list({d for d, _ in chunks(padded(raw))})) for _, _, raw in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["h"])

    return run


def shared_places(parts: list[tuple[bytes, bytes]], seen: Bloom) -> list[int]:
    """The chunks that other texts may have, or this one several times."""
    digests = [d for d, _ in parts]
    times = Counter(digests)
    return [i for i, (d, may) in enumerate(zip(digests, seen.may(hashes(digests)), strict=True)) if may or times[d] > 1]


def _lent(read, shared):
    """The shared chunks of the texts."""

    def run(batches):
        z, seen = zstandard.ZstdCompressor(level=LEVEL), shared.value
        for texts in read(batches):
            out = {}
            for _, _, raw in texts:
                parts = chunks(padded(raw))
                for i in shared_places(parts, seen):
                    out.setdefault(*parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array([z.compress(p) for p in out.values()], pa.binary())], ["digest", "data"])

    return run


def _pack(batches):
    z, back = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            parts = [(r["digest"], back.decompress(r["data"])) for r in batch.slice(at, PACK).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"kind": SHARED, "digests": [d for d, _ in parts], "refs": [], "own": packed(parts, set(), z)}], _ROW)


def _store(read, shared):
    """The rows of the texts."""

    def run(batches):
        z, seen = zstandard.ZstdCompressor(level=LEVEL), shared.value
        for texts in read(batches):
            out = []
            for kind, doc, raw in texts:
                samples = padded(raw)
                media, parts = to_wav(samples), chunks(samples)
                refs = shared_places(parts, seen)
                out.append({"kind": kind, "doc_id": doc, "key": xxhash.xxh3_128_digest(raw), "n_bytes": len(raw), "media_sha256": hashlib.sha256(media).hexdigest(), "head": media[:HEADER], "digests": [d for d, _ in parts], "refs": refs, "own": packed(parts, set(refs), z)})
            yield pa.RecordBatch.from_pylist(out, _ROW)

    return run


def own_chunks(row: dict) -> dict[int, bytes]:
    n = len(row["digests"])
    if not n:
        return {}
    sizes = struct.unpack_from(f"<{n}I", row["own"])
    data, at, out = zstandard.ZstdDecompressor().decompress(row["own"][4 * n :]), 0, {}
    for i, size in enumerate(sizes):
        if size:
            out[i] = data[at : at + size]
            at += size
    return out


def build_store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the chunk store of ``docs`` and return it: each different text's row, each distinct chunk's bytes once.

    A null text is an empty one. A document whose text no other row has is that text's row; rows that share a text, whatever their ids,
    are a row each that names it. Null ids stay null.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    send = docs.sparkSession.sparkContext.broadcast
    copied = send(bloom(rows.select("h")))
    # a text that a third of the rows have is combined in each task before it is sent
    texts = scratch.table(rows.mapInArrow(_copies(copied, False), "key binary, z binary").dropDuplicates(["key"]), "texts", "none")

    def of_all(make, schema):
        return rows.mapInArrow(make(_singles(copied)), schema).unionByName(texts.mapInArrow(make(_unpacked), schema))

    shared = send(bloom(of_all(_chunk_hashes, "h long")))
    lent = of_all(lambda read: _lent(read, shared), "digest binary, data binary").dropDuplicates(["digest"])
    parts = [lent.mapInArrow(_pack, ROW), of_all(lambda read: _store(read, shared), ROW)]
    names = rows.mapInArrow(_copies(copied, True), "doc_id long, key binary").withColumns({"kind": F.lit(NAME), "digests": F.array().cast("array<binary>"), "refs": F.array().cast("array<int>")})
    parts.append(docs.sparkSession.createDataFrame([], ROW).unionByName(names, True))
    store = [scratch.table(p, name, "none") for p, name in zip(parts, ("shared", "files", "names"), strict=True)]
    scratch.drop("texts")
    return store[0].unionByName(store[1]).unionByName(store[2])


def _chunks_of_packs(batches):
    z = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for r in batch.to_pylist():
            have = own_chunks(r)
            yield pa.RecordBatch.from_arrays([pa.array(r["digests"], pa.binary()), pa.array([z.compress(have[i]) for i in range(len(have))], pa.binary())], ["digest", "data"])


MEDIA = "doc_id long, key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = pa.schema([(x.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]]) for x in MEDIA.split(", ")])


def rebuilt(row: dict) -> bytes:
    """The media file of a store row with the chunks of others that were fetched; every digest is checked."""
    have = own_chunks(row)
    for x in row["fetched"] or ():
        have[x["i"]] = zstandard.ZstdDecompressor().decompress(x["data"])
    for i, digest in enumerate(row["digests"]):
        if i not in have or xxhash.xxh3_128_digest(have[i]) != digest:
            raise ValueError(f"chunk {i} of document {row['doc_id']} is missing or damaged")
    media = (row.get("head") or b"") + b"".join(have[i] for i in range(len(row["digests"])))
    if hashlib.sha256(media).hexdigest() != row["media_sha256"]:
        raise ValueError(f"document {row['doc_id']} is damaged")
    return media


def _read(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(at, 256).to_pylist():
                media = rebuilt(r)
                samples = from_wav(media)
                out.append({"doc_id": r["doc_id"], "key": r["key"], "n_bytes": r["n_bytes"], "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:]), "media_bytes": len(media), "media_sha256": r["media_sha256"], "feature": features(samples)})
            yield pa.RecordBatch.from_pylist(out, _MEDIA)


def read_features(store: DataFrame) -> DataFrame:
    """Read every text of the store back and describe it, and give each document what its text has."""
    lent = store.where(F.col("kind") == SHARED).select("digests", "own").mapInArrow(_chunks_of_packs, "digest binary, data binary")

    def described(kind):
        files = store.where(F.col("kind") == kind).drop("kind")
        borrows = F.size("refs") > 0
        refs = files.where(borrows).select("key", F.explode(F.transform("refs", lambda i: F.struct(i.alias("i"), F.get("digests", i).alias("digest")))).alias("x")).select("key", "x.i", "x.digest")
        # references to a chunk that a third of the texts have are split by Spark's skew join, which reads the chunk once per split
        met = refs.join(lent, "digest").groupBy("key").agg(F.collect_list(F.struct("i", "data")).alias("fetched"))
        plain = files.where(~borrows).withColumn("fetched", F.lit(None).cast("array<struct<i:int,data:binary>>"))
        return plain.mapInArrow(_read, MEDIA).unionByName(files.where(borrows).join(met, "key", "left").mapInArrow(_read, MEDIA))

    ones, copied = described(ONE).drop("key"), described(COPIED).drop("doc_id")
    named = store.where(F.col("kind") == NAME).select("doc_id", "key")
    # a text that a third of the documents have goes to several tasks; one row at most per HOT documents is broadcast
    parts = named.groupBy("key").agg(F.ceil(F.count("*") / HOT).alias("parts")).where("parts > 1")

    def dealt(rows, part):
        return rows.join(F.broadcast(parts), "key", "left").withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts")

    named, copied = dealt(named, lambda n: F.pmod(F.monotonically_increasing_id(), n)), dealt(copied, lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    named = named.join(copied, ["key", "part"], "left").drop("key", "part")
    lost = F.raise_error(F.lit("the text of a document is missing"))
    return ones.unionByName(named.withColumn("media_sha256", F.coalesce("media_sha256", lost)))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payloads of ``docs`` and return, per row, what reads back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text is an empty one, 64 bytes 0. Rows that repeat an id, or id and text, each give a row; null ids stay null. A text of any length is stored whole.
    Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    return read_features(build_store(docs, Scratch(docs.sparkSession, "media"), id_col, text_col))
