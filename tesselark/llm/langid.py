"""Language identification with interpolated Kneser-Ney character models.

Each language gets a model of the characters of its words (lower-cased runs of letters and
their marks, with a start and an end sign). N-grams are 64-bit hashes in sorted arrays, one per
order, with a column for each language, and are found by binary search. The language
with the lowest cross-entropy per character is chosen; a text whose best entropy is far
above what labelled texts of its length show is marked as rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import col, discard, map_rows, map_text, others, slices, stored

ORDER = 4
#: The classifier is fitted on at most so many labelled documents of a language (whole texts, chosen by a hash of the key) ...
FIT_DOCS = 1000
#: ... and its confidence and rejection are set on at most so many others.
CALIBRATE_DOCS = 300
#: Of every 13 documents of a language, in order of their hashes, these calibrate, at every size of the table.
CALIBRATING = (4, 8, 12)
#: A language with fewer calibration texts takes the cut of all languages' texts.
OWN_CUT = 20
#: The classifier has a column for each language; a table with more labels than this is refused.
MAX_LANGS = 1024
#: A text is rejected when its standardised excess entropy is over SLACK times this quantile of the calibration texts.
REJECT_QUANTILE, SLACK = 0.999, 2.0
#: A text's entropy varies with its length up to so many signs; beyond, texts differ more than by chance.
CHANCE_SIGNS = 1000
#: Words whose scores a worker keeps; others are scored again.
KEEP_WORDS = 100_000

# Up to U+024F, and among general punctuation and currency signs, there are no combining marks, and only these numbers that
# are word characters but neither digits nor letters: superscripts and fractions.
_PLAIN = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+").findall
_BEYOND = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]").search
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters with the marks that follow them."""
    text = text.lower()
    return _LETTERS(text) if _BEYOND(text) else _PLAIN(text)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every sign of ``words``: its word, its place in the word, and the hashes of the 1..ORDER-grams that end there."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    signs = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(signs)) - begins[word]
    out = []
    with np.errstate(over="ignore"):
        h = _mix(signs + np.uint64(1))
        out.append(h)
        for _ in range(1, ORDER):
            shifted = np.empty_like(h)
            shifted[0], shifted[1:] = 0, h[:-1]
            h = _mix(shifted * np.uint64(0x9E3779B97F4A7C15) + signs + np.uint64(1))
            out.append(h)
    return word, place, signs, out


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h in sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)


@dataclass
class Model:
    langs: list[str]
    #: By order: sorted hashes of grams with their discounted probabilities, and of contexts with their back-off weights.
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    temperature: float = 1.0
    #: By language: the calibration texts' mean entropy, and the standardised excess over it from which a text is rejected.
    mean: np.ndarray | float = 0.0
    cut: np.ndarray | float = float("inf")
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "scores": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        word, place, _, hashes = _grams(words)
        p = np.broadcast_to(self.base, (len(place), len(self.langs))).copy()
        for n in range(ORDER):
            use = np.flatnonzero(place >= max(1, n))
            keys, values = self.grams[n]
            at, ok = _find(keys, hashes[n][use])
            a = values[at] * ok[:, None]
            if n == 0:
                back = self.contexts[0][1][0]
            else:
                ckeys, cvalues = self.contexts[n]
                cat, cok = _find(ckeys, hashes[n - 1][use - 1])
                back = np.where(cok[:, None], cvalues[cat], 1.0)
            p[use] = a + back * p[use]
        logs = np.log(p)
        logs[place == 0] = 0
        sizes = np.bincount(word, minlength=len(words))
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0).astype(np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per sign of each text by language, and the number of signs (0: no letter)."""
        cut = [words_of(t) if t else [] for t in texts]
        if self.scores is None:
            self.scores = np.zeros((0, len(self.langs)), np.float32)
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        if len(self.known) + len(new) > KEEP_WORDS:
            self.known, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(w for ws in cut for w in ws))
        if new:
            parts = [self.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            first = len(self.known)
            self.known.update((w, first + i) for i, w in enumerate(new))
            self.scores = np.concatenate([self.scores, *parts])
        get = self.known.__getitem__
        h, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for i, ws in enumerate(cut):
            if ws:
                n[i] = sum(map(len, ws)) + len(ws)
                h[i] = -self.scores[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64) / n[i]
        if len(self.known) > KEEP_WORDS:
            self.known, self.scores = {}, None
        return h, n

    def forget(self) -> None:
        """Drops the scores kept for words."""
        self.known, self.scores = {}, None

    def confidence(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / self.temperature
        e = np.exp(z)
        return (e.max(axis=1) / e.sum(axis=1)) if h.shape[1] else np.zeros(len(h))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language (``und`` without letters), confidence in 0..1, and whether the text is rejected."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        h, n = self.entropies(texts)
        best, sure = h.argmin(axis=1), self.confidence(h, n)
        mean, cut = (np.broadcast_to(v, len(self.langs))[best] for v in (self.mean, self.cut))
        odd = (h.min(axis=1) - mean) * np.sqrt(np.minimum(n, CHANCE_SIGNS)) > cut
        return (
            [self.langs[b] if k else "und" for b, k in zip(best, n)],
            [float(s) if k else 0.0 for s, k in zip(sure, n)],
            [bool(o) or not k for o, k in zip(odd, n)],
        )


def fit(counts: dict[str, Counter]) -> Model:
    """Models from the word counts of each language; absolute discounts from the counts of counts of each order."""
    langs = sorted(k for k, c in counts.items() if c)
    per: list[dict] = []
    signs: set[int] = set()
    for lang in langs:
        words = sorted(counts[lang])
        times = np.array([counts[lang][w] for w in words], dtype=np.float64)
        word, place, s, hashes = _grams(words)
        signs.update(np.unique(s).tolist())
        tables = []
        for n in range(ORDER):
            use = place >= max(1, n)
            context = hashes[n - 1][np.flatnonzero(use) - 1] if n else np.zeros(use.sum(), np.uint64)
            keys, first, back = np.unique(hashes[n][use], return_index=True, return_inverse=True)
            tables.append({"keys": keys, "context": context[first], "count": np.bincount(back, weights=times[word[use]]), "first": np.flatnonzero(use)[first]})
        for n in range(ORDER - 1):  # lower orders count the distinct signs before, but for grams at a word's start
            up = tables[n + 1]
            inner = hashes[n][up["first"]]
            at, ok = _find(tables[n]["keys"], inner)
            kinds = np.bincount(at[ok], minlength=len(tables[n]["keys"])).astype(np.float64)
            starts = place[tables[n]["first"]] < n + 1
            tables[n]["count"] = np.where(starts & (kinds == 0), tables[n]["count"], np.maximum(kinds, 1.0))
        for t in tables:
            ones, twos = (t["count"] == 1).sum(), (t["count"] == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ckeys, back = np.unique(t["context"], return_inverse=True)
            total, kinds = np.bincount(back, weights=t["count"]), np.bincount(back)
            t["p"] = np.maximum(t["count"] - d, 0) / total[back]
            t["contexts"] = ckeys, np.minimum(d * kinds / total, 1.0)
        per.append({"tables": tables})

    def merged(parts: list[tuple[np.ndarray, np.ndarray]], empty: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        values = np.full((len(keys), len(parts)), empty)
        for j, (k, v) in enumerate(parts):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    grams, contexts = [], []
    for n in range(ORDER if langs else 0):
        grams.append(merged([(x["tables"][n]["keys"], x["tables"][n]["p"]) for x in per], 0.0))
        contexts.append(merged([x["tables"][n]["contexts"] for x in per], 1.0))
    return Model(langs, grams, contexts, np.full(len(langs), 1.0 / (len(signs) + 1000)))


def held_out(key: Column) -> Column:
    """Rows that are not learned from: crc32 of the key as text leaves 1 modulo 3 (a null key: false)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the labelled rows that are not held out; rows with a null key, text or label teach nothing.

    A key's repeated rows of a language teach once, by the least of their texts. The table is read twice: keys and
    labels to count the keys of each language, then the texts of the keys under a hash that leaves somewhat more of a
    language than are wanted.
    """
    rows = df.select(col(key).alias("key"), col(text).alias("text"), col(lang).alias("lang"))
    rows = rows.where("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("key")))
    h = F.xxhash64("key")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages among the labels; the classifier has a column for each")
    if not sizes:
        return fit({})
    wanted = FIT_DOCS + CALIBRATE_DOCS
    share = lambda n: min(1.0, 1.25 * (wanted + 50) / n)
    most = [(r.lang, min((1 << 63) - 1, int(share(r.n) * (1 << 64)) - (1 << 63))) for r in sizes]
    below = F.broadcast(df.sparkSession.createDataFrame(most, "lang string, most long"))  # a row for each language
    near = rows.join(below, "lang").where(h <= F.col("most")).groupBy("key", "lang").agg(F.min("text").alias("text"))
    near = stored(near.withColumn("h", h), "labelled")
    # At most some 1.3 * (FIT_DOCS + CALIBRATE_DOCS) keys of a language; the texts stay where they are.
    by_lang: dict[str, list] = {}
    for r in near.select("lang", "h", "key").collect():
        by_lang.setdefault(r.lang, []).append((r.h, r.key))
    ranks = [(g, k, i % 13 not in CALIBRATING) for g, rows in by_lang.items() for i, (_, k) in enumerate(sorted(rows)[:wanted], 1)]
    kind = df.schema[key].dataType.simpleString()
    chosen = F.broadcast(df.sparkSession.createDataFrame(ranks, f"lang string, key {kind}, fit boolean"))
    sample = near.join(chosen, ["lang", "key"]).select("fit", "text", "lang")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, Counter] = {}
        for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            seen.setdefault(g, Counter()).update(words_of(t))
        out = [(g, w, k) for g, c in seen.items() for w, k in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted = map_text(sample.where("fit"), words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, Counter] = {g: Counter(dict(zip(part["word"], part["n"]))) for g, part in counted.groupby("lang")}
    model = fit(counts)
    if not model.langs:
        discard(near)
        return model

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        hs, n = model.entropies(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(hs.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    seen = map_text(sample.where("NOT fit"), judged, "lang string, h array<double>, n long").where("n > 0").collect()
    discard(near)
    return calibrate(model, seen)


def calibrate(model: Model, seen: list) -> Model:
    """Sets the confidence's temperature (least log loss) and the rejection's threshold from rows (lang, h, n)."""
    at = {g: i for i, g in enumerate(model.langs)}
    seen = [(at[g], h, n) for g, h, n in seen if g in at]
    if not seen:
        return model
    y, h, n = np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), np.array([s[2] for s in seen])
    losses = {}
    for t in np.geomspace(0.05, 20, 40):
        z = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / t
        losses[t] = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean()
    model.temperature = float(min(losses, key=lambda t: (losses[t], t)))
    least, best = h.min(axis=1), h.argmin(axis=1)
    mean = lambda of: (least[of] * n[of]).sum() / n[of].sum()
    model.mean = np.full(len(model.langs), mean(np.full(len(n), True)))
    for g in np.unique(best):
        model.mean[g] = mean(best == g)
    excess = (least - model.mean[best]) * np.sqrt(np.minimum(n, CHANCE_SIGNS))
    cut = lambda of: max(5.0, SLACK * np.quantile(excess[of], REJECT_QUANTILE))
    model.cut = np.full(len(model.langs), cut(np.full(len(n), True)))
    for g, texts in zip(*np.unique(best, return_counts=True)):
        if texts >= OWN_CUT:
            model.cut[g] = cut(best == g)
    return model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred, score, rejected`` to every row (columns of these names, in any case, are replaced).

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text
    if nothing was learned. Ties go to the language that comes first. Repeated rows are judged alike.
    """
    keep = others(df, "lang_pred", "score", "rejected")
    df = df.select(*map(col, keep))
    at = keep.index(text)
    schema = StructType(df.schema.fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the fitted sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            lang, score, odd = shared.value.predict(batch.column(at).to_pylist())
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "rejected"])
        shared.value.forget()
        pa.default_memory_pool().release_unused()

    return map_rows(df, run, schema)


def predictions(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key, held_out, lang_pred, score, rejected: learned from the rows that are not held out, given for all."""
    model = train(df, key, text, lang)
    rows = df.select(col(key).alias("doc_id"), col(text).alias("text"))
    out = identify(rows, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
