"""Benchmark passages in training documents, by a positional inverted index.

Documents are dealt in slices of a few MB, and each slice gets its own index: for each of its terms (64-bit hashes of words) the sorted
places where it stands, all documents of the slice laid out one after the other with a gap between them. The slices' indexes are written to
the shared folder, one row each, so a very frequent term is spread over all of them and postings are never shuffled.

Test items travel in blocks of bounded size to all slices. A window of an item is looked up from its rarest term in the slice: that
term's places, moved back by its offset, are the possible starts, and the lists of the other terms, rarest first, are intersected
with them in the same way, until a list leaves none. What is left are exact phrases. For proximity, the same places of the rarest
term are kept while every other term has a place near enough; then the shortest stretches that hold all terms are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, slices, stored
from .substrings import word_hashes

#: Words of a window, and of the longest stretch that counts as near.
WINDOW, WITHIN = 10, 20
#: Bytes of text of a slice, words of a block of items, and possible starts that are worked on at once.
SLICE, BLOCK, STARTS = 8 << 20, 1 << 20, 1 << 20

#: Bytes of UTF-8: A-Z to lower case; all ASCII but digits and letters separates words.
TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
TABLE = TABLE.lower()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and everything beyond ASCII."""
    return text.translate(TABLE).split() if text else []


def terms(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words."""
    return word_hashes(words(text))


class Postings:
    """One slice's index: sorted terms, where each one's places begin, and the places."""

    def __init__(self, term: np.ndarray, first: np.ndarray, place: np.ndarray) -> None:
        self.term, self.first, self.place = term, first, place
        #: Term number and place as one sorted number.
        self.span = int(place.max()) + 1 if len(place) else 1
        self.key = np.repeat(np.arange(len(term), dtype=np.int64), np.diff(first)) * self.span + place

    @classmethod
    def of(cls, tokens: np.ndarray, place: np.ndarray) -> Postings:
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
        return cls(t[begin], np.r_[begin, len(t)].astype(np.int64), place[order])

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for those that the slice lacks."""
        if not len(self.term):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        return np.where(self.term[at] == h, at, -1)

    def held(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms stand at the places."""
        want = number * self.span + place
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (place >= 0) & (place < self.span) & (self.key[at] == want)

    def after(self, number: np.ndarray, place: np.ndarray, none: int) -> np.ndarray:
        """The first place of each term at or after a place."""
        at = np.searchsorted(self.key, number * self.span + np.clip(place, 0, self.span))
        some = at < self.first[number + 1]
        return np.where(some, self.place[np.minimum(at, len(self.place) - 1)], none)

    def before(self, number: np.ndarray, place: np.ndarray, none: int) -> np.ndarray:
        """The last place of each term at or before a place."""
        at = np.searchsorted(self.key, number * self.span + np.minimum(place, self.span - 1), side="right") - 1
        return np.where((place >= 0) & (at >= self.first[number]), self.place[np.maximum(at, 0)], none)


def windows(size: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items laid out one after the other: each window's item, its words' places (window, word) and its length. Shorter windows repeat their first place."""
    begin = np.cumsum(size) - size
    number = np.where(size == 0, 0, np.maximum(size - window, 0) + 1)
    item = np.repeat(np.arange(len(size)), number)
    start = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
    length = np.minimum(size[item], window)
    offset = np.arange(window)
    offset = np.where(offset < length[:, None], offset, 0)
    return item, (begin[item] + start)[:, None] + offset, length


def phrases_and_stretches(index: Postings, tokens: np.ndarray, places: np.ndarray, length: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of items (places into ``tokens``): kind (0 phrase, 1 near), window, first place and end of each match."""
    number = index.number(tokens)
    count = np.where(number >= 0, index.first[np.maximum(number, 0) + 1] - index.first[np.maximum(number, 0)], 0) if len(index.term) else np.zeros(len(tokens), np.int64)
    counts = count[places] if len(places) else np.zeros((0, places.shape[1]), np.int64)
    live = np.flatnonzero((counts > 0).all(axis=1))
    order = np.argsort(counts[live], axis=1, kind="stable")  # rarest first
    at = np.take_along_axis(places[live], order, axis=1)
    offset = at - places[live, :1]
    term = number[at]
    many = counts[live, order[:, 0]] if len(live) else np.empty(0, np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(many) // STARTS)) + 1, len(live)] if len(live) else [0]
    for b, e in zip(cuts[:-1], cuts[1:]):
        w = np.repeat(np.arange(b, e), many[b:e])
        if not len(w):
            continue
        rank = np.arange(len(w)) - np.repeat(np.cumsum(many[b:e]) - many[b:e], many[b:e])
        place = index.place[index.first[term[w, 0]] + rank].astype(np.int64)
        start, v = place - offset[w, 0], w
        keep = start >= 0
        start, v = start[keep], v[keep]
        for j in range(1, term.shape[1]):
            keep = index.held(term[v, j], start + offset[v, j])
            start, v = start[keep], v[keep]
            if not len(v):
                break
        yield 0, live[v], start, start + length[live[v]]
        if not within:
            continue
        # Near: places of the rarest term that no phrase of the window begins with.
        phrases = np.sort(v * index.span + start)
        keep = ~np.isin(w * index.span + place - offset[w, 0], phrases)
        v, place = w[keep], place[keep]
        for j in range(1, term.shape[1]):
            keep = index.after(term[v, j], place - within + 1, 1 << 40) <= place + within - 1
            v, place = v[keep], place[keep]
            if not len(v):
                break
        if not len(v):
            continue
        # From each place up to the rarest term: the stretch that ends when all terms have come, if none of it can be left out in front.
        for s in range(0, len(v), 4096):
            x, p = v[s : s + 4096], place[s : s + 4096]
            x, p = np.repeat(x, within), (p[:, None] - np.arange(within)).ravel()
            x, p = x[p >= 0], p[p >= 0]
            far = np.max([index.after(term[x, j], p, 1 << 40) for j in range(term.shape[1])], axis=0)
            ok = far - p < within
            x, p, far = x[ok], p[ok], far[ok]
            tight = np.min([index.before(term[x, j], far, -1) for j in range(term.shape[1])], axis=0) == p
            # A stretch that shares a word with a phrase of the window goes: no phrase may begin from (p - length) + 1 to its end.
            n = length[live[x]]
            tight &= np.searchsorted(phrases, x * index.span + np.maximum(p - n + 1, 0)) == np.searchsorted(phrases, x * index.span + far, side="right")
            yield 1, live[x[tight]], p[tight], far[tight] + 1


def _indexed(window_gap: int):
    """Texts to one row for each slice: the documents' keys and word counts, and the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            found = [terms(t.as_py()) for t in batch.column(1)]
            size = np.array([len(f) for f in found], np.int64)
            tokens = np.concatenate(found)
            del found
            place = (np.arange(len(tokens)) + np.repeat(np.arange(len(size)) * window_gap, size)).astype(np.int32)
            p = Postings.of(tokens, place)
            row = [batch.column(0).to_pylist()], [size.tolist()], [p.term.tobytes()], [p.first.astype(np.int32).tobytes()], [p.place.tobytes()]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], names=["keys", "sizes", "term", "first", "place"])

    return run


_MATCH = "slice long, row int, item long, kind int, begin int, end int"


def _matched(block, window: int, within: int, gap: int):
    """Slices of the index to matches with one block of items: overlapping or adjoining ones of an item and kind are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size, tokens = block.value
        item, places, length = windows(size, window)
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[r].as_py(), np.int64)
                raw = [batch.column(c)[r].as_buffer() for c in ("term", "first", "place")]
                index = Postings(np.frombuffer(raw[0], np.uint64), np.frombuffer(raw[1], np.int32).astype(np.int64), np.frombuffer(raw[2], np.int32))
                begins = np.cumsum(sizes + gap) - sizes - gap
                got = [(np.full(len(w), kind), w, s, e) for kind, w, s, e in phrases_and_stretches(index, tokens, places, length, within) if len(w)]
                if not got:
                    continue
                kind, w, s, e = (np.concatenate(c) for c in zip(*got))
                row = np.searchsorted(begins, s, side="right") - 1
                of = item[w]
                order = np.lexsort((e, s, row, of, kind))
                kind, of, row, s, e = kind[order], of[order], row[order], s[order], e[order]
                new = np.r_[True, (kind[1:] != kind[:-1]) | (of[1:] != of[:-1]) | (row[1:] != row[:-1])]
                # The furthest end so far of the same item and document: ends are made to grow from group to group.
                group = np.cumsum(new) - 1
                lift = group * (index.span + window + within + 1)
                far = np.maximum.accumulate(e + lift)
                new[1:] |= (s + lift)[1:] > far[:-1]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(s)] - 1
                begin = s[first] - begins[row[first]]
                end = far[last] - lift[last] - begins[row[first]]
                n = len(first)
                cols = [pa.array([batch.column("slice")[r].as_py()] * n, pa.int64()), pa.array(row[first].astype(np.int32)), pa.array(numbers[of[first]], pa.int64()), pa.array(kind[first].astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["slice", "row", "item", "kind", "begin", "end"])

    return run


class Contamination:
    """The index of documents and its matches with test items.

    documents: rows (slice, row, key, n_words), one for each document. found: rows (slice, row, item_id, kind, begin, end), word spans
    (ends exclusive) of phrases (kind 0) and of stretches of at most ``within`` words that hold all words of a window in any order (kind 1;
    shortest ones, that share no word with a phrase of the window); overlapping spans of one item and kind are one.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int = WITHIN, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> None:
        spark = docs.sparkSession
        gap = max(window, within) + 1
        raw = docs.select(col(key).cast("long").alias("key"), col(text).cast("binary").alias("text"))
        made = raw.mapInArrow(_indexed(gap), "keys array<long>, sizes array<long>, term binary, first binary, place binary")
        index = stored(made.select(F.monotonically_increasing_id().alias("slice"), "*"), "postings")
        both = index.select("slice", F.posexplode(F.arrays_zip("keys", "sizes")).alias("row", "d"))
        self.documents = both.select("slice", "row", F.col("d.keys").alias("key"), F.col("d.sizes").alias("n_words"))

        def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [terms(t.as_py()) for t in batch.column(1)]
                cols = [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "n", "tokens"])

        tests = items.where(col(item_key).isNotNull()).select(col(item_key).cast("string").alias("item_id"), col(item_text).cast("binary").alias("text"))
        tests = tests.mapInArrow(parsed, "item_id string, n long, tokens binary").where("n > 0").select(F.monotonically_increasing_id().alias("item"), "*")
        tests = stored(tests, "items")
        # Items go to blocks by their numbers, near BLOCK words each; a longer item is a block by itself.
        total, = tests.agg(F.sum("n")).first()
        number = max(1, -(-(total or 0) // BLOCK))
        blocks = tests.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(number)))
        found = None
        for b in range(number):
            part = blocks.where(F.col("block") == b).select("item", "n", "tokens").orderBy("item").toPandas()  # some BLOCK words
            held = spark.sparkContext.broadcast((part["item"].to_numpy(np.int64), part["n"].to_numpy(np.int64), np.frombuffer(b"".join(map(bytes, part["tokens"])), np.uint64)))
            got = index.select("slice", "sizes", "term", "first", "place").mapInArrow(_matched(held, window, within, gap), _MATCH)
            found = got if found is None else found.union(got)
        self.found = stored(found.join(tests.select("item", "item_id"), "item").select("slice", "row", "item_id", "kind", "begin", "end"), "matches")


def matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, item_id, kind, begin, end): word spans of documents that hold windows of items, as phrases ("phrase") or near each other ("near").

    Words are those of ``words``. A window is ``window`` consecutive words of an item; an item of fewer words is one window, one without words has
    none. Documents and items with a null text have no words; items with a null id take no part; documents with a null key and repeated
    rows are matched row by row. Empty tables give an empty result. Other columns are not read.
    """
    c = Contamination(docs, items, **options)
    kind = F.when(F.col("kind") == 0, "phrase").otherwise("near")
    return c.found.join(c.documents, ["slice", "row"]).select(F.col("key").alias("doc_id"), "item_id", kind.alias("kind"), "begin", "end")


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit (words within phrases), n_items, items_sha256, contaminated, n_near (words of near stretches)."""
    c = Contamination(docs, items, **options)
    # Words in any span of a document: each span adds what lies beyond the furthest end before it.
    far = F.max("end").over(Window.partitionBy("slice", "row", "kind").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = c.found.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(far, F.lit(0)))))
    words_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("new")).otherwise(0))
    per = spans.groupBy("slice", "row").agg(words_of(0).alias("hit"), words_of(1).alias("near"), F.sort_array(F.collect_set(F.when(F.col("kind") == 0, F.col("item_id")))).alias("ids"))
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = c.documents.join(per, ["slice", "row"], "left")
    return out.select(
        F.col("key").alias("doc_id"), "n_words", n("hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n("hit") > 0).alias("contaminated"), n("near").alias("n_near"),
    )


def oracle_sql(window: int = WINDOW, within: int = WITHIN) -> str:
    """The same in DuckDB SQL: windows as strings, stretches by joins of the documents that hold all words of a window."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), {word})"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {split} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT row_number() OVER () AS wid, * FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - {window - 1}, 1) + 1), lambda k: w[k : k + {window - 1}])) AS q, least(len(w), {window}) AS n FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, s WHERE len(w) >= n),
h AS (SELECT r, k, x.n, item, wid FROM (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS t FROM p) x JOIN (SELECT *, array_to_string(q, ' ') AS t FROM g) USING (n, t)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
wt AS (SELECT DISTINCT wid, unnest(q) AS term FROM g),
tk AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM d),
tv AS (SELECT * FROM tk SEMI JOIN wt USING (term)),
al AS (SELECT r, wid, any_value(k) AS k FROM (SELECT DISTINCT r, term FROM tv) JOIN wt USING (term) JOIN (SELECT wid, count(*) AS k FROM wt GROUP BY wid) USING (wid) GROUP BY r, wid HAVING count(*) = any_value(k)),
m AS (SELECT r, wid, k, pos, term FROM al JOIN wt USING (wid) JOIN tv USING (r, term)),
e AS (SELECT r, wid, pos, term, max(far) AS far FROM (SELECT a.r, a.wid, a.k, a.pos, a.term, b.term AS other, min(b.pos) AS far FROM m a JOIN m b ON a.r = b.r AND a.wid = b.wid AND b.pos BETWEEN a.pos AND a.pos + {within - 1} GROUP BY ALL) GROUP BY r, wid, k, pos, term HAVING count(*) = k),
v AS (SELECT e.r, e.wid, e.pos, far FROM e ANTI JOIN m ON m.r = e.r AND m.wid = e.wid AND m.term = e.term AND m.pos > e.pos AND m.pos <= e.far),
u AS (SELECT v.* FROM v ANTI JOIN h ON h.r = v.r AND h.wid = v.wid AND h.k <= v.far AND h.k + h.n > v.pos),
y AS (SELECT r, count(DISTINCT x) AS n_near FROM (SELECT r, unnest(range(pos, far + 1)) AS x FROM u) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN y USING (r)"""
