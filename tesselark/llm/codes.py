"""Compression of vectors to codes: each of PARTS equal parts of a vector becomes the number of the nearest entry of that part's codebook.

Codebooks are fitted by Lloyd's rounds on whole numbers, so every distance, sum and mean is exact. An assignment is an exponion
search: it starts at the entry that the part had before, whose exact squared distance is u. An entry as near as that lies within
twice the distance of the starting entry, so of the starting entry's neighbours, kept in order of their squared distance, only those up to
4 u can win; all of them are compared, ties go to the lower number. In the first round, where no entry is known, the search
starts at the entry whose components have the nearest sum.

Rows stay where they are: a round maps them, and only the sums of the entries (parts times entries from each task) are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .vectors import matrix, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that are compared at once.
STEP = 2048
#: Labels whose sums are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors in consecutive parts (vector, part, component). Where they aren't equal, the first parts are one longer; zeros fill the others up."""
    width = x.shape[1]
    sizes = [width // parts + (p < width % parts) for p in range(parts)]
    out = np.zeros((len(x), parts, max(1, *sizes)), np.int64)
    begin = 0
    for p, n in enumerate(sizes):
        out[:, p, :n] = x[:, begin : begin + n]
        begin += n
    return out


@dataclass
class Codebooks:
    """Entries by part, number and component, with each entry's neighbours in order of distance."""

    entries: np.ndarray
    width: int
    order: np.ndarray = field(init=False)
    near: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)
    by_sum: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        c = self.entries
        d = ((c[:, :, None] - c[:, None]) ** 2).sum(axis=3)
        self.order = np.argsort(d, axis=2, kind="stable")
        self.near = np.take_along_axis(d, self.order, axis=2)
        self.by_sum = np.argsort(c.sum(axis=2), axis=1, kind="stable")
        self.sums = np.take_along_axis(c.sum(axis=2), self.by_sum, axis=1)

    def start(self, x: np.ndarray) -> np.ndarray:
        """An entry of a sum near each part's."""
        s, k = x.sum(axis=2), self.entries.shape[1]
        out = np.empty(s.shape, np.int64)
        for p in range(s.shape[1]):
            up = np.minimum(np.searchsorted(self.sums[p], s[:, p]), k - 1)
            low = np.maximum(up - 1, 0)
            nearer = np.abs(self.sums[p][low] - s[:, p]) <= np.abs(self.sums[p][up] - s[:, p])
            out[:, p] = self.by_sum[p][np.where(nearer, low, up)]
        return out

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each part, from the entries that they had before; and how many entries were compared."""
        n, parts, width = x.shape
        k = self.entries.shape[1]
        part = np.tile(np.arange(parts), n)
        flat, at = x.reshape(-1, width), before.reshape(-1) + part * k
        table = self.entries.reshape(-1, width)
        off = flat - table[at]
        u = np.einsum("ij,ij->i", off, off)
        reach = (self.near.reshape(-1, k)[at] <= 4 * u[:, None]).sum(axis=1)
        # Those that look at most neighbours first, so that each step works on the front.
        turn = np.argsort(-reach, kind="stable")
        flat, at, best, found = flat[turn], at[turn], u[turn], before.reshape(-1)[turn].copy()
        base, order, reach = part[turn] * k, self.order.reshape(-1, k), reach[turn]
        for j in range(int(reach[0]) if len(reach) else 0):
            m = int(np.searchsorted(-reach, -j, side="left"))
            other = order[at[:m], j]
            off = flat[:m] - table[base[:m] + other]
            d = np.einsum("ij,ij->i", off, off)
            better = np.flatnonzero((d < best[:m]) | ((d == best[:m]) & (other < found[:m])))
            best[better], found[better] = d[better], other[better]
        back = np.empty_like(turn)
        back[turn] = np.arange(len(turn))
        return found[back].reshape(n, parts), best[back].reshape(n, parts), int(reach.sum())

    def moved(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
        """Every entry that has parts becomes their mean, rounded down."""
        c = self.entries.copy()
        for (p, e), (total, count) in sums.items():
            c[p, e] = [int(s) // count for s in total]
        return Codebooks(c, self.width)

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
        parts = self.entries.shape[0]
        sizes = [self.width // parts + (p < self.width % parts) for p in range(parts)]
        return hashlib.sha256(",".join(str(v) for p, n in enumerate(sizes) for e in self.entries[p] for v in e[:n].tolist()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        parts = self.entries.shape[0]
        sizes = [self.width // parts + (p < self.width % parts) for p in range(parts)]
        return np.concatenate([self.entries[p][codes[:, p], :n] for p, n in enumerate(sizes)], axis=1)


def _least(n: int):
    """The n smallest different ids of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64)
        for batch in batches:
            held = np.unique(np.r_[held, batch.column(0).to_numpy(zero_copy_only=False)])[:n]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["id"])

    return run


def _assigned(books: Codebooks, first: bool, final: bool):
    """Rows to rows with their codes, and with their errors at last."""
    parts, k = books.entries.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, STEP):
                batch = whole_batch.slice(begin, STEP)
                x = cut(matrix(batch.column("v"), books.width), parts)
                before = books.start(x) if first else np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
                code, error, _ = books.assign(x, before)
                raw, n = code.astype(np.uint16).tobytes(), 2 * parts
                codes = pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())
                kept = [batch.column("id"), batch.column("label")]
                if final:
                    yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(error.sum(axis=1), pa.int64())], names=["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, batch.column("v"), codes], names=["id", "label", "v", "code"])

    return run


def _sums(parts: int, k: int, width: int):
    """Sums and counts by part and entry: one row for each that the task's rows use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = cut(matrix(batch.column("v"), width), parts)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
            at = (code + np.arange(parts) * k).reshape(-1)
            flat = x.reshape(len(at), -1)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            if total is None:
                total, count = np.zeros((parts * k, flat.shape[1]), np.int64), np.zeros(parts * k, np.int64)
            total[at[order][first]] += np.add.reduceat(flat[order], first, axis=0)
            count[at[order][first]] += np.diff(np.r_[first, len(at)])
        if total is not None:
            used = np.flatnonzero(count)
            cols = [pa.array(used // k, pa.int32()), pa.array(used % k, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64())), pa.array(count[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "total", "n"])

    return run


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Rows (id, label, code, error), one for every row kept, and the codebooks; code is ``parts`` unsigned 16-bit numbers, error the sum of the
    squared distances.

    A component x becomes floor(scale * x). Rows whose vector is null, holds null or non-finite components or has another length than
    most take no part. The codebooks begin as the vectors of the smallest ``entries`` ids (of a repeated id, its least vector; rows
    with a null id get codes but begin none); every round assigns all rows and moves each used entry to the mean of its parts. Repeated rows count as
    often as they are there. A table without vectors or ids gives no rows and no codebooks. Other columns are not read. Components so large
    that four times a squared distance doesn't fit in 64 bits raise ValueError.
    """
    spark = df.sparkSession
    rows = stored(whole(df, key, vector, label, scale), "whole")
    kind = rows.schema["label"].dataType.simpleString()
    final = f"id long, label {kind}, code binary, error long"
    seeds = [r.id for r in rows.where("id IS NOT NULL").select("id").mapInArrow(_least(entries), "id long").distinct().orderBy("id").limit(entries).collect()]
    if not seeds:
        return spark.createDataFrame([], final), None
    first = rows.where(F.col("id").isin(seeds)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    x = np.array([r.v for r in first], np.int64).reshape(len(first), -1)
    most = rows.agg(F.max(F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.lit(0.0)))).first()[0]
    c = cut(x, parts)
    if 16 * c.shape[2] * int(most) ** 2 >= 1 << 63:
        raise ValueError("components are too large for distances in 64 bits")
    books = Codebooks(np.ascontiguousarray(c.transpose(1, 0, 2)), x.shape[1])
    k = len(first)
    for r in range(rounds):
        before, rows = rows, stored(rows.mapInArrow(_assigned(books, r == 0, False), f"id long, label {kind}, v array<long>, code binary"), "coded")
        discard(before)
        part_sums = rows.select("v", "code").mapInArrow(_sums(parts, k, x.shape[1]), "part int, entry int, total array<long>, n long")
        wide = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(c.shape[2])]
        got = part_sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect()  # at most parts x entries
        books = books.moved({(g.part, g.entry): ([g[f"t{i}"] for i in range(c.shape[2])], g.n) for g in got})
    out = stored(rows.mapInArrow(_assigned(books, rounds == 0, True), final), "codes")
    discard(rows)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the sum of the errors of all rows of the same label, null being one label."""
    per = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_label")
    small = F.broadcast(per) if per.count() <= FEW_LABELS else per
    return coded.join(small, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def digest(df: DataFrame, **options) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256): codes as two hex digits for each part."""
    coded, books = compress(df, **options)
    parts = options.get("parts", PARTS)
    # The lower byte of each number comes first; two digits hold up to 256 entries.
    code = F.lower(F.concat(*[F.substring(F.hex("code"), 4 * p + 1, 2) for p in range(parts)]))
    sha = books.digest() if books else None
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> str:
    """The same in DuckDB SQL, by full comparison with every entry."""
    near = lambda e: (
        f"SELECT r, vec_id, label, p, x, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (SELECT k.r, k.vec_id, k.label, k.p, any_value(k.x) AS x, c.e, "
        f"CAST(list_sum(list_transform(list_zip(any_value(k.x), any_value(c.c)), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d FROM pieces k JOIN {e} c USING (p) GROUP BY k.r, k.vec_id, k.label, k.p, c.e) GROUP BY r, vec_id, label, p, x"
    )
    ctes = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS (SELECT r, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range(0, {parts}) t(p))",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM pieces QUALIFY e < {entries})",
    ]
    for i in range(rounds):
        ctes.append(f"a{i} AS ({near(f'c{i}')})")
        ctes.append(f"m{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 1000) t(j) WHERE j <= len(x) GROUP BY p, e, j) GROUP BY p, e)")
        ctes.append(f"c{i + 1} AS (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (p, e))")
    ctes.append(f"last AS ({near(f'c{rounds}')})")
    ctes.append("coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r, vec_id, label)")
    ctes.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM c{rounds})")
    return "WITH " + ", ".join(ctes) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, books"
