"""Removal of repeated passages: every window of WINDOW words that also starts in a document with a smaller key.

Fixed-block anchors. Non-overlapping blocks of BLOCK words (at multiples of BLOCK) are
indexed, and every rolling window of BLOCK words probes the index. A window of 13 words
always holds a whole block of 7, so two equal windows meet at the block of the earlier
document. The documents of a hit then extend it: they give the WINDOW-word windows around
it, which are compared as a whole, by two independent 64-bit hashes of the words' 64-bit hashes. Windows
that are repeated and overlap or adjoin are extended to one maximal repeat of their document.

Hashes travel packed: a row holds, for one bucket and one slice of documents, the
documents' keys and a few bytes for each of their windows. Of the windows that a slice holds several
times only that of the least key travels; the others are known to be repeats where they are. So a
passage that very many documents share is sent once for a slice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, slices, stored

WINDOW = 13
#: The longest block of which a window always holds a whole one.
BLOCK = (WINDOW + 1) // 2
#: Words whose hashes a worker keeps.
KEEP_WORDS = 200_000
#: Buckets are so many that the packed hashes of one stay near this size, BUCKETS_A_TASK for each shuffle partition, and LEAST_BUCKETS at least.
BUCKET_BYTES = 64 << 20
BUCKETS_A_TASK, LEAST_BUCKETS = 1, 64
#: Bytes of a block's hash that travel with a probe (equal ones are only candidates), of a window's two hashes, and of a repeated window of a document.
BLOCK_BYTES, WINDOW_BYTES, HIT_BYTES = 6, 16, 8
#: Of many rows, a table keeps those with the least keys whenever so many parts have come.
PARTS = 64
#: Texts are packed in slices of this many bytes.
PACK_BYTES = 12 << 20

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, kept for frequent ones."""
    global _known
    if len(_known) > KEEP_WORDS:
        _known = {}
    known, h64 = _known, xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = h64(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, size: int, factor: np.uint64 = _P1) -> np.ndarray:
    """Hashes of all windows of ``size`` words, from the words' hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out *= factor
            out += h[k : k + n]
        return _mix(out)


def block_hashes(h: np.ndarray) -> np.ndarray:
    """Of every rolling block; what doesn't travel is cut off. The upper bits choose the bucket."""
    return rolling(h, BLOCK)


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: two independent hashes of 64 bits."""
    return rolling(h, WINDOW), rolling(h, WINDOW, _P2)


def _pack(x: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes of each hash."""
    return x.tobytes() if size == 8 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(b: bytes, size: int) -> np.ndarray:
    if size == 8:
        return np.frombuffer(b, np.uint64)
    x = np.zeros((len(b) // size, 8), np.uint8)
    x[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return x.view(np.uint64).ravel()


#: kind 0: the index, the least key of each hash; kind 1: probes. keys, counts: the documents in order of the hashes.
_PACKED = "bucket long, kind int, keys array<long>, counts array<int>, hashes binary"


def _dealt(doc: np.ndarray, keys: np.ndarray, x: np.ndarray, kind: int, bits: int, pack: Callable[[int, int], bytes]) -> list[tuple]:
    """Packed rows, one for each bucket, of hashes in order of their buckets; within one, in order of the documents (indexes into keys)."""
    bucket = (x >> np.uint64(64 - bits)).astype(np.int64)
    out = []
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(x) else []
    for b, e in zip(cuts, [*cuts[1:], len(x)]):
        part = doc[b:e]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out.append((int(bucket[b]), kind, keys[part[first]], np.diff(np.r_[first, len(part)]).astype(np.int32), pack(b, e)))
    return out


def _by_bucket(doc: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """An order by bucket that keeps the documents' order."""
    return np.argsort((x >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64), kind="stable")


def _firsts(x: np.ndarray) -> np.ndarray:
    """The first place of each hash, in order of places."""
    order = np.argsort(x, kind="stable")
    sx = x[order]
    return np.sort(order[np.r_[True, sx[1:] != sx[:-1]]]) if len(x) else order


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "kind", "keys", "counts", "hashes"])


def _blocks(bits: int):
    """Texts to packed blocks: those at multiples of BLOCK are indexed, all of them probe."""

    def rows(got: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        got.sort(key=lambda g: g[0])
        keys = np.array([g[0] for g in got], np.int64)
        size = [len(g[1]) for g in got]
        doc = np.repeat(np.arange(len(got), dtype=np.int32), size)
        x = np.concatenate([g[1] for g in got])
        anchors = np.flatnonzero((np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)) % BLOCK == 0)
        got.clear()
        anchors = anchors[_firsts(x[anchors])]  # of equal ones, that of the least key
        out = []
        for kind, at in ((0, anchors), (1, slice(None))):
            d, h = doc[at], x[at]
            order = _by_bucket(d, h, bits)
            d, h = d[order], h[order]
            out += _dealt(d, keys, h, kind, bits, lambda b, e: _pack(h[b:e], BLOCK_BYTES))
        yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PACK_BYTES):
            got = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split() if key is not None and text.is_valid else ()
                if len(words) >= WINDOW:
                    got.append((key, block_hashes(word_hashes(words))))
            if got:
                yield from rows(got)

    return run


def _windows(bits: int):
    """Texts with their live blocks to packed windows: those that hold a live block, once for each slice, and those known to be repeats (kind 1)."""
    low = np.uint64((1 << 8 * BLOCK_BYTES) - 1)

    def rows(got: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        got.sort(key=lambda g: g[0])
        keys = np.array([g[0] for g in got], np.int64)
        doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(g[1]) for g in got])
        x, y = (np.concatenate([g[i] for g in got]) for i in (1, 2))
        got.clear()
        order = np.lexsort((y, x))  # stable: equal windows stay in order of their keys
        new = np.r_[True, (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])]
        first = order[new]
        least = keys[doc[first]][np.cumsum(new) - 1]
        later = order[keys[doc[order]] > least]
        first, later = np.sort(first), np.sort(later)
        first = first[_by_bucket(doc[first], x[first], bits)]
        a, b = x[first], y[first]
        out = _dealt(doc[first], keys, a, 0, bits, lambda s, e: a[s:e].tobytes() + b[s:e].tobytes())
        d, h = doc[later], x[later]
        cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]).tolist() if len(d) else []
        for s, e in zip(cuts, [*cuts[1:], len(d)]):  # dealt anywhere
            key = keys[d[s : s + 1]]
            out.append((int(key[0]) & (1 << bits) - 1, 1, key, np.array([e - s], np.int32), h[s:e].tobytes()))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PACK_BYTES):
            got = []
            for key, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = text.as_py().split() if text.is_valid else ()
                if len(words) < WINDOW:
                    continue
                h = word_hashes(words)
                live = np.isin(block_hashes(h) & low, _unpack(b"".join(hits.as_py()), BLOCK_BYTES))
                total = np.r_[0, np.cumsum(live)]
                near = total[WINDOW - BLOCK + 1 :] > total[: -(WINDOW - BLOCK + 1)]  # any of the blocks within a window
                if near.any():
                    x, y = window_hashes(h)
                    got.append((key, x[near], y[near]))
            if got:
                yield rows(got)

    return run


class _Hits:
    """Packed hashes by key, given out in batches."""

    def __init__(self, size: int) -> None:
        self.size, self.rows = size, []

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        """Hashes whose keys stand together."""
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
        raw, n = _pack(x, self.size), self.size
        self.rows += [(k, raw[n * s : n * e]) for k, s, e in zip(keys[cut].tolist(), cut, [*cut[1:], len(keys)])]

    def made(self, least: int = 20_000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], t) for i, t in enumerate((pa.int64(), pa.binary()))], names=["key", "hits"])
            self.rows = []


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """Bucket, kind, key of each hash, and the packed hashes."""
    for batch in batches:
        for row in range(batch.num_rows):
            b, kind, keys, counts, packed = (c[row] for c in batch.columns)
            yield b.as_py(), kind.as_py(), np.repeat(keys.values.to_numpy(), counts.values.to_numpy()), packed.as_py()


def _probe_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed blocks in order of bucket and kind: each probing document's blocks that a smaller key has as an anchor.

    The index of a bucket becomes a table from hash to least key; the probes stream past it. The document
    of that least key gets the blocks that others have hit as well.
    """
    bucket, parts, table, live = None, [], None, None
    out = _Hits(BLOCK_BYTES)

    def least(parts: list[tuple]) -> tuple:
        x, k = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((k, x))
        x, k = x[order], k[order]
        new = np.r_[True, x[1:] != x[:-1]]
        return x[new], k[new]

    def close() -> None:
        if table is not None and live.any():
            x, k = table[0][live], table[1][live]
            order = np.argsort(k, kind="stable")
            out.add(k[order], x[order])

    for b, kind, k, packed in _packed_rows(batches):
        if b != bucket:
            close()
            bucket, parts, table, live = b, [], None, None
        x = _unpack(packed, BLOCK_BYTES)
        if kind == 0:
            parts.append((x, k))
            if len(parts) >= PARTS:
                parts = [least(parts)]
            continue
        if not parts:
            continue
        if table is None:
            table = least(parts)
            live = np.zeros(len(table[0]), bool)
        at = np.minimum(np.searchsorted(table[0], x), len(table[0]) - 1)
        hit = (table[0][at] == x) & (table[1][at] < k)
        live[at[hit]] = True
        out.add(k[hit], x[hit])
        yield from out.made()
    close()
    yield from out.made(0)


def _probe_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed windows in order of bucket: each document's windows that a smaller key has.

    Whenever equal windows come together, all but those of the least key are repeats, and only that one is kept.
    """
    bucket, parts = None, []
    out = _Hits(HIT_BYTES)

    def least() -> list[tuple]:
        x, y, k = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((k, y, x))
        x, y, k = x[order], y[order], k[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        repeat = k > k[new][np.cumsum(new) - 1]
        rk, rx = k[repeat], x[repeat]
        order = np.argsort(rk, kind="stable")
        out.add(rk[order], rx[order])
        return [(x[new], y[new], k[new])]

    for b, kind, k, packed in _packed_rows(batches):
        if b != bucket:
            if parts:
                least()
            bucket, parts = b, []
        h = np.frombuffer(packed, np.uint64)
        if kind == 1:
            out.add(k, h)
        else:
            parts.append((h[: len(k)], h[len(k) :], k))
            if len(parts) >= PARTS:
                parts = least()
        yield from out.made()
    if parts:
        least()
    yield from out.made(0)


def _covered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with the windows to remove, to counts, the maximal repeats (words begin:end, comma-joined) and what is kept."""
    rows = []
    for text, hits in zip(batch.column(1), batch.column(2)):
        words = text.as_py().split() if text.is_valid else []
        keep, spans = words, ""
        found = hits.as_py() if hits.is_valid else []
        if found and len(words) >= WINDOW:
            x = rolling(word_hashes(words), WINDOW)
            # The windows found are the document's own, so 64 bits tell them apart.
            gone = np.isin(x, _unpack(b"".join(found), HIT_BYTES))
            edge = np.zeros(len(words) + 1, np.int64)
            edge[: len(x)] += gone
            edge[WINDOW : WINDOW + len(x)] -= gone
            covered = np.cumsum(edge) > 0
            keep = [w for w, c in zip(words, covered.tolist()) if not c]
            turns = np.flatnonzero(np.diff(covered[: len(words)].astype(np.int8), prepend=0, append=0))
            spans = ",".join(f"{b}:{e}" for b, e in turns.reshape(-1, 2).tolist())
        rows.append((len(words), len(words) - len(keep), spans, b" ".join(keep)))
    n, gone, spans, kept = zip(*rows)
    cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["key", "n_words", "n_removed", "repeats", "kept"])


def _digested(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = _covered(batch)
    return out.set_column(4, "kept_sha256", pa.array([hashlib.sha256(b.as_py()).hexdigest() for b in out.column(4)], pa.string()))


def _mark(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, hits): every row with the packed hashes of its windows that start in a smaller key's document."""
    spark = df.sparkSession
    docs = df.select(col(key).cast("long").alias("key"), col(text).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(32, max(1, math.ceil(math.log2(max(2, size * 1.3 / BUCKET_BYTES, BUCKETS_A_TASK * tasks, LEAST_BUCKETS)))))
    tasks = max(tasks, math.ceil(size / BUCKET_BYTES))  # so a task's share doesn't grow with the table

    def met(packed: DataFrame, probe: Callable) -> DataFrame:
        return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(probe, "key long, hits binary")

    live = stored(met(docs.mapInArrow(_blocks(bits), _PACKED), _probe_blocks), "blocks")
    lists = live.groupBy("key").agg(F.collect_list("hits").alias("hits"))  # bounded by a document's own windows
    some = docs.join(lists, "key").select("key", "text", "hits")
    gone = stored(met(some.mapInArrow(_windows(bits), _PACKED), _probe_windows), "windows")
    discard(live)
    return docs.join(gone.groupBy("key").agg(F.collect_list("hits").alias("hits")), "key", "left").select("key", "text", "hits")


def _each(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield fn(batch)

    return run


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_words, n_removed, repeats (word spans, ends exclusive), kept_sha256 (of the kept words, joined by one space).

    ``key`` is an integer. Null, empty and short texts (under WINDOW words) lose nothing, nor does a row with
    a null key, which also is no reference. Rows of one key are not smaller than one another, so a repeated row keeps
    what no smaller key has. Other columns are not read.
    """
    return _mark(df, key, text).mapInArrow(_each(_digested), f"`{key}` long, n_words long, n_removed long, repeats string, kept_sha256 string")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_removed, repeats, kept): as above, with the kept text itself."""
    marked = _mark(df, key, text).mapInArrow(_each(_covered), "key long, n_words long, n_removed long, repeats string, kept binary")
    return marked.select(F.col("key").alias(key), "n_words", "n_removed", "repeats", F.col("kept").cast("string").alias("kept"))
