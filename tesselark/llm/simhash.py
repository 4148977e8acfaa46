"""Near-duplicates by 64-bit SimHash, linked at three or fewer differing bits.

Meet-in-the-middle ball hashing. Two fingerprints at distance 3 have a common variant one
flip from one of them and two flips from the other, and differ in the parity of their bits.
So a fingerprint of even weight emits its variants within half the radius rounded down
(65), one of odd weight those within half rounded up (2,081): every pair within the
radius meets. Variants are shuffled by some of their bits. A fingerprint is sent once to each
bucket that any of its variants falls into, with the flips that lead there, and the rest of
its variants are made at the receiver; so the shuffle carries some dozens of rows for a
fingerprint instead of thousands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_text, stored
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets are made as many as keep the variants of one near this number (16 bytes each).
BUCKET_VARIANTS = 1 << 21
#: Variants of odd and even fingerprints, on average.
MEAN_VARIANTS = (65 + 2081) / 2
#: What would make more variants than this at once is split by further bits first.
SPLIT_VARIANTS = 3_000_000

_ONE = np.uint64(1)


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of UTF-8 text, A-Z lower-cased, repeats included; no word: zero."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(line[b:e], SEED) for b, e in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp): the fingerprint of every row's text as a signed long; null and empty texts have zero."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return map_text(df.select(col(key), col(text).cast("binary")), run, f"`{key}` {kind}, fp long")


def _bits(n: int) -> list[int]:
    """n bit positions spread over the fingerprint; buckets are told apart by these."""
    return [(i * 37 + 11) % 64 for i in range(n)]


def _take(x: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & _ONE).astype(np.int64) << i
    return out


def _flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """Masks of up to ``most`` flips among bits, with the number of flips."""
    out = [(0, 0)]
    if most >= 1:
        out += [(1 << b, 1) for b in bits]
    if most >= 2:
        out += [(1 << a | 1 << b, 2) for i, a in enumerate(bits) for b in bits[:i]]
    return out


def _radius(x: np.ndarray) -> np.ndarray:
    """Half the radius, rounded up for fingerprints of odd weight and down for others."""
    return np.where(np.bitwise_count(x) % 2 == 1, (RADIUS + 1) // 2, RADIUS // 2).astype(np.int8)


def _spread(x: np.ndarray, left: np.ndarray, bits: list[int]) -> tuple[np.ndarray, ...]:
    """Every way to flip up to ``left`` of ``bits``: index of the source, flipped value, flips left."""
    parts = []
    for mask, k in _flips(bits, int(left.max(initial=0))):
        at = np.flatnonzero(left >= k)
        parts.append((at, x[at] ^ np.uint64(mask), (left[at] - k).astype(np.int8)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _meet(x: np.ndarray, v: np.ndarray, left: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints x whose variants v may still flip ``left`` of the ``free`` bits.

    A common variant links to one centre: if an even fingerprint has it, all that have it are within
    the radius of that one; odd ones at one flip each are within two of each other. Two odd ones that
    meet at two flips may be four apart; if they are two apart they meet at one flip as well.
    """
    f = len(free)
    if free and np.array([1, 1 + f, 1 + f + f * (f - 1) // 2])[left].sum() > SPLIT_VARIANTS:
        at, w, rest = _spread(v, left, free[:1])
        inner, parts = x[at], []
        side = ((w >> np.uint64(free[0])) & _ONE).astype(bool)
        for s in (side, ~side):
            if s.sum() > 1:
                parts.append(_meet(inner[s], w[s], rest[s], free[1:]))
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (x[:0], x[:0])
    at, w, rest = _spread(v, left, free)
    own = x[at]
    used = np.bitwise_count(own ^ w)
    odd = np.bitwise_count(own) % 2 == 1
    order = np.argsort(w, kind="stable")
    w, own, used, odd = w[order], own[order], used[order], odd[order]
    same = np.zeros(len(w), bool)
    same[1:] = w[1:] == w[:-1]
    near = same.copy()
    near[:-1] |= same[1:]
    w, own, used, odd = w[near], own[near], used[near], odd[near]
    if not len(w):
        return x[:0], x[:0]
    # In each group the centre comes first: an even one if there is, else an odd one at one flip.
    order = np.lexsort((own, np.where(odd, np.where(used <= 1, 1, 2), 0), w))
    w, own, used, odd = w[order], own[order], used[order], odd[order]
    begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    first = np.repeat(begin, np.diff(np.r_[begin, len(w)]))
    centre = own[first]
    ok = (own != centre) & (np.bitwise_count(own ^ centre) <= RADIUS) & (~odd[first] | (used <= 1) & (used[first] <= 1))
    pairs = np.unique(np.stack([np.maximum(own[ok], centre[ok]), np.minimum(own[ok], centre[ok])], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``fp`` within RADIUS; a chain of links where not one."""
    fps = fps.select("fp").where("fp IS NOT NULL")
    n = fps.count()
    size = max(1, min(40, math.ceil(math.log2(max(2.0, n * MEAN_VARIANTS / BUCKET_VARIANTS)))))
    bits = _bits(size)
    free = [b for b in range(64) if b not in bits]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 20_000):
                part = x[i : i + 20_000]
                at, v, left = _spread(part, _radius(part), bits)
                cols = [pa.array(_take(v, bits)), pa.array(part[at].view(np.int64)), pa.array(v.view(np.int64)), pa.array(left.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "x", "v", "left"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        a, b = _meet(part["x"].to_numpy().view(np.uint64), part["v"].to_numpy().view(np.uint64), part["left"].to_numpy().astype(np.int8), free)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = fps.mapInArrow(send, "bucket long, x long, v long, left int")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, fingerprint (16 hex digits), component_id.

    component_id is the least key reachable over links, its own included. Texts without words (null,
    empty, blank) share the fingerprint zero and are linked. Rows with a null key get a fingerprint and
    the component's least known key (null if there is none). Repeated rows give repeated results.
    """
    prints = stored(fingerprints(df, key, text), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(classes))
    # Fingerprints without a link are their own component.
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = stored(grouped, "classes")
    linked = grouped.where("fp <> root OR root IS NULL").select("root").distinct()
    # Only components of more than one fingerprint have anything to sum.
    several = grouped.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    ids = grouped.join(several, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select(key, digits.alias("fingerprint"), "component_id")
