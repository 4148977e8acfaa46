"""Byte-level BPE by merge replay over a vocabulary of words.

Texts are cut into words by the tokenizer's pattern. The words of a slice of rows that
are not known yet are encoded together: their bytes lie in one array, an inverted index
leads from the rank of a token pair to the positions where the pair stands, and merges
are applied in order of rank, each touching only the pairs beside it. The results are
kept (up to a bound) for the worker's later slices, so a frequent word is merged once.
Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import col, map_text

#: Words kept by a worker, in each of two generations; a size of the cache only: a word that was
#: dropped is merged again when it comes again.
KEEP_WORDS = 120_000
#: Pairs of tokens whose rank is kept.
KEEP_PAIRS = 300_000
#: Words that are merged together: their positions stay in the processor's cache.
TOGETHER = 1000
#: Longer words are merged, but not kept.
KEEP_CHARS = 64


#: A larger vocabulary file is refused: every worker gets it.
VOCABULARY_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file's bytes."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class Replay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        # All tokens' bytes in a row, for decoding.
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.sizes[r] = len(t)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        # Ranks of the pairs of bytes.
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])

    def _rank(self, key: int) -> int:
        if len(self.pairs) > KEEP_PAIRS:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        return r

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. Within a word the lowest rank goes first, the leftmost of equals: so says the definition of BPE."""
        ranks = self.ranks
        out = [ranks.get(w, -1).to_bytes(4, "little", signed=True) if w else w for w in words]
        todo = [i for i, w in enumerate(out) if w == b"\xff\xff\xff\xff"]
        if not todo:
            return out
        # All bytes in one row; a word's last position is followed by -1, its first one preceded by -1.
        flat = np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)
        n = len(flat)
        ends = np.cumsum([len(words[i]) for i in todo])
        begins = np.r_[0, ends[:-1]]
        follow, before_ = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[ends - 1] = before_[begins] = -1
        ids, nexts, prevs = self.byte_ids[flat].tolist(), follow.tolist(), before_.tolist()
        ranked = np.full(n, -1)
        ranked[:-1] = self.first[flat[:-1].astype(np.int64) << 8 | flat[1:]]
        ranked[ends - 1] = -1
        pair = ranked.tolist()
        # The inverted index: from the rank of a pair to the positions where it begins.
        at = np.flatnonzero(ranked >= 0)
        at = at[np.argsort(ranked[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranked[at], prepend=-1)).tolist()
        places = at.tolist()
        index = {pair[places[b]]: places[b:e] for b, e in zip(cuts, [*cuts[1:], len(places)])}
        heap = list(index)
        heapq.heapify(heap)
        pop, push, known, rank = heapq.heappop, heapq.heappush, self.pairs, self._rank
        while heap:
            r = pop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            for k, p in enumerate(places):
                if pair[p] != r:
                    continue  # merged away meanwhile
                q = nexts[p]
                ids[p], ids[q], pair[q] = r, -1, -1
                nexts[p] = after = nexts[q]
                least = r
                if after >= 0:
                    prevs[after] = p
                    key = r << 32 | ids[after]
                    pair[p] = x = known[key] if key in known else rank(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            push(heap, x)
                        if x < least:
                            least = x
                else:
                    pair[p] = -1
                before = prevs[p]
                if before >= 0:
                    key = ids[before] << 32 | r
                    pair[before] = x = known[key] if key in known else rank(key)
                    if x >= 0:
                        if x in index:
                            index[x].append(before)
                        else:
                            index[x] = [before]
                            push(heap, x)
                        if x < least:
                            least = x
                if least < r and k + 1 < len(places):  # that pair goes first
                    if r in index:
                        index[r] += places[k + 1 :]
                    else:
                        index[r] = places[k + 1 :]
                        push(heap, r)
                    break
        row = np.array(ids, np.int64)
        stay = np.concatenate([[0], np.cumsum(row >= 0)])
        row = row[row >= 0].astype("<u4").tobytes()
        for i, b, e in zip(todo, (4 * stay[begins]).tolist(), (4 * stay[ends]).tolist()):
            out[i] = row[b:e]
        return out

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        if len(self.known) > KEEP_WORDS:  # words not used since the last time go
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in set().union(*cut):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        for begin in range(0, len(new), TOGETHER):
            part = new[begin : begin + TOGETHER]
            known.update(zip(part, self.merge([w.encode("utf-8", "replace") for w in part])))
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in new:
            if len(w) > KEEP_CHARS:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that encoded ids stand for."""
        which = np.frombuffer(ids, "<u4")
        size = self.sizes[which]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.begins[which] - ends + size, size) + np.arange(ends[-1])].tobytes()


_replays: dict[tuple[bytes, str], Replay] = {}


def replay_of(data: bytes, pattern: str) -> Replay:
    """The worker's encoder for the bytes of a vocabulary file, made once."""
    which = hashlib.sha256(data).digest(), pattern
    if which not in _replays:
        _replays[which] = Replay(read_ranks(data), pattern)
    return _replays[which]


def _shipped(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file at the driver's ``path``, for all workers."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: more than {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array column ``ids`` in place of ``text``; a null text has no ids (an empty array).

    Another column named like ``ids``, in any case, is replaced; the rest is kept.
    """
    keep = [c for c in df.columns if c == text or c.lower() != ids.lower()]
    df = df.select(*map(col, keep))
    at = keep.index(text)
    schema = StructType([StructField(ids, ArrayType(LongType())) if i == at else f for i, f in enumerate(df.schema.fields)])
    data = _shipped(df, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = replay_of(data.value, pattern).encode_batch([t or "" for t in batch.column(at).to_pylist()])
        column = pa.array([np.frombuffer(b, "<u4").astype("i8") for b in made], pa.list_(pa.int64()))
        return batch.set_column(at, ids, column)

    return map_text(df, run, schema, at)


def digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, n_tokens, SHA-256 of the ids and of the bytes decoded from them.

    A null text counts as empty (no ids). Repeated rows give repeated results; a null key is passed on.
    Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    data = _shipped(df, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = replay_of(data.value, pattern)
        made = coder.encode_batch([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(b) // 4 for b in made], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in made], pa.string()),
                pa.array([hashlib.sha256(coder.decode(b)).hexdigest() for b in made], pa.string()),
            ],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_text(df.select(col(key), col(text)), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
