"""The methods inside the operators, clashing columns, and odd rows of every pipeline stage."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from tesselark.llm import bpe, images, langid, mixing, neighbours, pii, queries, secrets, simhash, substrings, urlfilter

from test_text_operators import classes, docs, odd_texts

# ---- 1 -----------------------------------------------------------------------------------------------------------


def cheapest(supply, quota):
    """Size and cost of a cheapest largest flow: shortest paths by Bellman and Ford, one after the other."""
    names = ["start", "end", *supply, *[("source", s) for s in quota]]
    at = {n: i for i, n in enumerate(names)}
    arcs = []

    def arc(a, b, room, cost):
        arcs.extend([[at[a], at[b], room, cost], [at[b], at[a], 0, -cost]])

    for p, n in supply.items():
        for cost in mixing.REPEAT_COST:
            arc("start", p, n, cost)
        for s in p:
            arc(p, ("source", s), 10**9, 0)
    for s, n in quota.items():
        arc(("source", s), "end", n, 0)
    size = cost = 0
    while True:
        far, via = [math.inf] * len(names), [-1] * len(names)
        far[0], changed = 0, True
        while changed:
            changed = False
            for k, (a, b, room, c) in enumerate(arcs):
                if room and far[a] + c < far[b]:
                    far[b], via[b], changed = far[a] + c, k, True
        if far[1] == math.inf:
            return size, cost
        path, u = [], 1
        while u:
            path.append(via[u])
            u = arcs[via[u]][0]
        push = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= push
            arcs[k ^ 1][2] += push
        size, cost = size + push, cost + push * far[1]


def test_flow_is_cheapest_and_largest():
    r = random.Random(1)
    for _ in range(400):
        sources = "abcde"[: r.randint(1, 5)]
        supply = {tuple(sorted(r.sample(sources, r.randint(1, len(sources))))): r.randint(0, 12) for _ in range(r.randint(1, 7))}
        quota = {s: r.randint(0, 40) for s in sources}
        flow = mixing.min_cost_flow(supply, quota)
        given, used = Counter(), Counter()
        for (p, s), n in flow.items():
            assert s in p and n > 0
            given[s] += n
            used[p] += n
        assert all(given[s] <= quota[s] for s in quota)
        cost = 0
        for p, n in used.items():
            for price in mixing.REPEAT_COST:
                cost, n = cost + min(n, supply[p]) * price, n - min(n, supply[p])
            assert n == 0
        assert (sum(flow.values()), cost) == cheapest(supply, quota)


def test_overlapping_sources_get_the_words_of_the_flow(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 30))), r.choice([["a"], ["a", "b"], ["b", "c"], ["c"], ["a", "b", "c"], [], None, ["b", None]])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = {x.doc_id: x for x in mixing.mix(d, F.col("sources")).collect()}
    pattern = lambda s: tuple(sorted(set(s or [None]), key=lambda x: (x is None, x or "")))
    supply, taken, quota = Counter(), Counter(), Counter()
    for i, t, s in rows:
        n = len(t.split())
        assert got[i]["size"] == n and got[i].taken == got[i].copies * n and 0 <= got[i].copies <= 3
        supply[pattern(s)] += n
        taken[pattern(s)] += got[i].taken
    for p, n in supply.items():
        for s in p:
            quota[s] += n
    goal = mixing.targets(list(quota.items()))
    scale = sum(supply.values()) / sum(quota.values())
    flow = mixing.min_cost_flow(dict(supply), {s: round(t * scale) for s, t in goal.items()})
    want = Counter()
    for (p, _), n in flow.items():
        want[p] += n
    # Documents of every size up to 30 words are at hand, so exchanges bring each pattern to its flow.
    assert all(abs(taken[p] - want[p]) <= 1 for p in supply), (taken, want)
    for p, n in supply.items():  # within a pattern, copies differ by one at most
        assert max(c := [got[i].copies for i, _, s in rows if pattern(s) == p]) - min(c) <= 1


# ---- 2 -----------------------------------------------------------------------------------------------------------


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Alpha", 10), ("beta", 5), ("beta", 3), ("gamma", 5), ("delta", 0), (None, 9), ("", 9)], "term string, weight int")
    found = urlfilter.vocabulary(terms)
    assert found == (("alpha", 10), ("beta", 5), ("gamma", 5))
    urls = ["http://x/ALPHA", "http://x/beta/beta", "http://x/beta-gamma", "http://x/alphabet", "http://x/delta"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.n_strict, r.n_soft, r.weight, r.verdict) for r in urlfilter.filter_urls(df, rules=(), terms=found).collect()}
    assert list(map(got.get, urls)) == [(1, 0, 10, "block"), (0, 1, 5, "allow"), (0, 2, 10, "block"), (0, 0, 0, "allow"), (0, 0, 0, "allow")]
    assert urlfilter.vocabulary(terms.limit(0)) == ()
    assert urlfilter.filter_urls(df, rules=(), terms=()).where("verdict <> 'allow'").count() == 0


# ---- 3 -----------------------------------------------------------------------------------------------------------


def test_field_finds_forms_on_texts_it_has_not_seen():
    precision, recall = pii.accuracy(pii.train(), 300, seed=99)
    assert precision >= 0.97 and recall >= 0.9, (precision, recall)


def test_best_reading_is_the_best_of_all():
    """The dynamic programme against all readings of short chains, transitions included."""
    r = random.Random(4)
    kinds = len(pii.KINDS)
    for _ in range(60):
        n = r.randint(1, 5)
        found = [(i, j, [f"f{i}.{j}"]) for i in range(n) for j in range(i + 1, n + 1) if r.random() < 0.6]
        names = [f[2][0] for f in found]
        field = pii.Field(names, np.array([[r.gauss(0, 2) for _ in range(kinds)] for _ in names]).reshape(-1, kinds), np.array([[r.gauss(0, 1) for _ in range(kinds + 1)] for _ in range(kinds + 1)]))
        scores = field.scores(found)

        def readings(place, label):
            if place == n:
                yield 0.0, []
                return
            for rest, spans in readings(place + 1, 0):
                yield field.turn[label, 0] + rest, spans
            for row, (i, j, _) in enumerate(found):
                if i == place:
                    for y in range(1, kinds + 1):
                        for rest, spans in readings(j, y):
                            yield field.turn[label, y] + scores[row, y - 1] + rest, [(i, j, pii.LABELS[y]), *spans]

        every = list(readings(0, 0))
        assert field.read(n, found) == max(every, key=lambda x: x[0])[1]
        done, _, first, _ = pii._chains(n, pii._by_end(n, found), scores.tolist(), field.turn.tolist())
        top = max(x for x, _ in every)
        assert pii._sum(done[n]) == pytest.approx(top + math.log(sum(math.exp(x - top) for x, _ in every)))


# ---- 4 -----------------------------------------------------------------------------------------------------------


def described(texts):
    owner, place, d = images.describe([images.read_netpbm(images.drawn(t)) for t in texts])
    ends = np.searchsorted(owner, range(len(texts) + 1))
    return [(place[b:e], d[b:e].view("<i8")) for b, e in zip(ends, ends[1:])]


def edited(r, t, how):
    if how == "cut":
        return t[72 * r.randint(1, 3) :]
    lines = [t[i : i + 72] for i in range(0, len(t), 72)]
    for _ in range(max(1, len(lines) // 10)):
        k = r.randrange(len(lines))
        lines[k] = "".join(r.choice("abcdefgh ") for _ in range(len(lines[k])))
    return "".join(lines)


def pages_with_copies(r, n=40):
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    footer = "".join(word() + " " for _ in range(60))[:288]
    out = []
    for i in range(n):
        t = " ".join(word() for _ in range(r.randint(150, 500)))
        t = t[: len(t) // 72 * 72] + (footer if i % 2 else "")
        out += [t] + [edited(r, t, how) for how in r.sample(["cut", "edit", "edit"], 2)] * (i % 3 > 0)
    return out


def test_classes_are_those_of_all_links(spark):
    r = random.Random(11)
    points = described(pages_with_copies(r))
    least = lambda a, b: max(images.LEAST_VOTES, images.LEAST_SHARE * min(len(a[0]), len(b[0])))
    every = {(i, k) for i in range(len(points)) for k in range(i) if images._votes(points[i], points[k]) >= least(points[i], points[k])}
    kind = "image long, points array<struct<at:bigint,lo:bigint,hi:bigint>>"
    df = spark.createDataFrame([(i, [tuple(map(int, (a, *x))) for a, x in zip(*p)]) for i, p in enumerate(points)], kind)
    links = {(x.a, x.b) for x in images.matches(df).collect()}
    assert links <= every and len(links) >= 0.9 * len(every) > 40
    roots, found = images.classes(df)
    got = {x.node: x.root for x in roots.collect()}
    want = classes(list(enumerate(range(len(points)))), lambda i, k: (max(i, k), min(i, k)) in links)
    assert {i: got.get(i, i) for i in range(len(points))} == want
    assert {(x.a, x.b) for x in found.collect()} <= links


def test_copies_of_one_image_are_compared_with_one_of_them(spark):
    r = random.Random(12)
    t = "".join(r.choice("abcdefghijk ") for _ in range(72 * 60))
    line = lambda k: t[: 72 * k] + "".join(r.choice("abcdefgh ") for _ in range(72)) + t[72 * k + 72 :]
    points = described([t] + [line(r.randrange(60)) for _ in range(60)])
    kind = "image long, points array<struct<at:bigint,lo:bigint,hi:bigint>>"
    df = spark.createDataFrame([(i, [tuple(map(int, (a, *x))) for a, x in zip(*p)]) for i, p in enumerate(points)], kind)
    roots, found = images.classes(df)
    assert {x.root for x in roots.collect()} == {0} and roots.count() == 61
    assert found.count() <= 3 * 61  # not 1830


POINTS = "image long, points array<struct<at:bigint,lo:bigint,hi:bigint>>"


def test_meetings_of_unlike_images_are_not_shuffled(spark):
    """Images of one common descriptor, too little for a link: what tasks send follows the images, not their pairs."""
    r = np.random.default_rng(14)
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda found: [found.apply(i) for i in range(found.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    def sent(n):
        d = r.integers(-(1 << 63), 1 << 63, (n, 6, 2))
        d[:, 0] = 77
        rows = [(i, [((13 * k << 20) | 7 * k, int(a), int(b)) for k, (a, b) in enumerate(x)]) for i, x in enumerate(d)]
        before = written()
        roots, found = images.classes(spark.createDataFrame(rows, POINTS))
        assert not roots.count() and not found.count()
        return written() - before

    few, many = sent(300), sent(1200)
    assert many < 6 * few  # not 16


def test_classes_and_links_do_not_depend_on_blocks(spark, monkeypatch):
    points = described(pages_with_copies(random.Random(15), 24))
    df = spark.createDataFrame([(i, [tuple(map(int, (a, *x))) for a, x in zip(*p)]) for i, p in enumerate(points)], POINTS)
    seen = []
    for corners in (1 << 19, sum(len(p[0]) for p in points) // 4, sum(len(p[0]) for p in points) // 3):
        monkeypatch.setattr(images, "BLOCK_CORNERS", corners)
        monkeypatch.setattr(images, "SENT", 1)
        roots, found = images.classes(df)
        every = {tuple(x) for x in images.matches(df).collect()}
        assert {tuple(x) for x in found.collect()} <= every
        seen.append((set(map(tuple, roots.collect())), every))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) > 20
    by = {(i, k): images._votes(points[i], points[k]) for i, k, _ in seen[0][1]}
    assert by == {(i, k): v for i, k, v in seen[0][1]}


def test_images_are_described_in_stacks(monkeypatch):
    """Sums over squares are made for many images at once, and are the same for one image at a time."""
    r = random.Random(16)
    texts = ["".join(r.choice("abcdefghijk ") for _ in range(r.randint(60, 4000))) for _ in range(40)]
    box, calls = images._box, []
    monkeypatch.setattr(images, "_box", lambda *a: calls.append(1) or box(*a))
    whole = described(texts)
    assert len(calls) < 4 * images.LEVELS * len(texts) / 4
    for t, (at, d) in zip(texts, whole):
        ((alone, e),) = described([t])
        assert (at == alone).all() and (d == e).all() and len(at)


def test_matches_differ_in_few_bits_of_folded_descriptors():
    """No match of two images is lost by the look at folded descriptors, in lines of either image."""
    r = np.random.default_rng(17)
    d = r.integers(-(1 << 63), 1 << 63, (2, 40, 2))
    for k in range(30):  # k bits apart, in both halves
        flips = np.zeros(128, np.uint8)
        flips[r.choice(128, k, replace=False)] = 1
        d[1, k] = d[0, k] ^ np.packbits(flips).view("<i8")
    one, two = d[0], np.concatenate([d[1], r.integers(-(1 << 63), 1 << 63, (60, 2))])
    for pair in ((one, two), (two, one)):
        rows = [(i, 0, images._pack(np.arange(len(x), dtype=np.int64), x), None) for i, x in enumerate(pair)]
        task = images._Task(pa.table({k: pa.array(v, kind) for k, v, kind in zip(("image", "side", "data", "root"), zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64()))}))
        row, other = np.array([1]), np.array([0])
        pairs, i, k = task.matched([(np.array([0]), *task.near(1, [0]))], row, other)
        plain = np.bitwise_count(task.d[task.size[0] :, None].view(np.uint64) ^ task.d[: task.size[0]].view(np.uint64)).sum(axis=2) <= images.MOST_BITS
        assert sorted(zip((i - task.size[0]).tolist(), k.tolist())) == list(zip(*map(np.ndarray.tolist, np.nonzero(plain)))) and plain.sum() == images.MOST_BITS + 1
        for need, may in ((images.MOST_BITS + 1, True), (images.MOST_BITS + 2, False)):
            assert task.may_vote(*(slice(b, b + n) for b, n in zip(task.begin[::-1].tolist(), task.size[::-1].tolist())), need) is may


def test_images_that_repeat_themselves():
    board = np.kron(np.indices((30, 30)).sum(axis=0) % 2 * 255.0, np.ones((20, 20)))
    owner, place, d = images.describe([board, board[20:, :]])
    assert len(place) > 2000
    ends = np.searchsorted(owner, range(3))
    one, two = ((place[b:e], d[b:e].view("<i8")) for b, e in zip(ends, ends[1:]))
    whole = images._votes(one, two)
    assert whole >= images.LEAST_SHARE * len(two[0])


def test_votes_do_not_depend_on_the_steps(monkeypatch):
    r = random.Random(13)
    t = "".join(r.choice("ab ") for _ in range(72 * 20)) * 3
    one, two = described([t, t[: 72 * 5] + "x" * 72 + t[72 * 6 :]])
    whole = images._votes(one, two)
    for step in (1, 7, 500):
        monkeypatch.setattr(images, "MATCHES", step)
        assert images._votes(one, two) == whole > 0


# ---- 5 -----------------------------------------------------------------------------------------------------------


def test_neighbours_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 256)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 64)
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)  # cells of several parts
    r = np.random.default_rng(2)
    x = (r.normal(size=(40, 32))[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 32))).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    counter = spark.sparkContext.accumulator(0)
    got = defaultdict(list)
    for g in neighbours.nearest(df, counter=counter).collect():
        got[g.query_id].append((g["rank"], g.vec_id, g.score))
    x = x.astype(float)
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(4000), -s))[:20].tolist())
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(s[f[1]], abs=1e-9) for f in found)
        hits += len(best & {f[1] for f in found})
    assert len(got) == 200 and hits / 4000 >= 0.9
    assert counter.value / (200 * 4000) < 0.5


def test_chi_square_quantiles():
    # Of a chi-square table.
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_quantile(0.9, 16) == pytest.approx(23.542, abs=1e-3)


# ---- 10 ----------------------------------------------------------------------------------------------------------


def test_letters():
    assert langid.words_of("Der Hund² und ½ Katze①") == ["der", "hund", "und", "katze"]
    assert langid.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert langid.words_of("“it’s” — café_9x Ⅷ") == ["it", "s", "café", "x"]
    m = langid.fit({"en": Counter({"the": 3, "cat": 1}), "de": Counter({"der": 2, "hund": 1})})
    assert m.predict(["² ½", "①", "the"])[0] == ["und", "und", "en"]


def kneser_ney(words, signs_known):
    """A function from a word to its log-probability, by the definition, with dictionaries."""
    order = langid.ORDER
    raw = [Counter() for _ in range(order)]
    begins = [set() for _ in range(order)]
    for w, n in words.items():
        s = "\x01" + w + "\x02"
        for k in range(order):
            for e in range(max(1, k), len(s)):
                raw[k][s[e - k : e + 1]] += n
                if e == k:
                    begins[k].add(s[: e + 1])
    counts = [None] * order
    counts[-1] = {g: float(c) for g, c in raw[-1].items()}
    for k in range(order - 1):
        kinds = Counter(g[1:] for g in raw[k + 1])
        counts[k] = {g: float(kinds[g]) if kinds[g] else float(c) if g in begins[k] else 1.0 for g, c in raw[k].items()}
    tables = []
    for c in counts:
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables.append((c, d, total, kinds))

    def score(w):
        s = "\x01" + w + "\x02"
        out = 0.0
        for e in range(1, len(s)):
            p = 1.0 / (signs_known + 1000)
            for k in range(min(order - 1, e) + 1):
                c, d, total, kinds = tables[k]
                g = s[e - k : e + 1]
                h = g[:-1]
                p = max(c.get(g, 0.0) - d, 0) / total[h] + min(d * kinds[h] / total[h], 1.0) * p if total[h] else p
            out += math.log(p)
        return out

    return score


def test_model_is_interpolated_kneser_ney():
    r = random.Random(6)
    counts = {g: Counter({"".join(r.choice(signs) for _ in range(r.randint(1, 7))): r.randint(1, 9) for _ in range(80)}) for g, signs in (("x", "abcd"), ("y", "cdef"))}
    model = langid.fit(counts)
    known = len({s for c in counts.values() for w in c for s in w}) + 2
    words = [w for c in counts.values() for w in c] + ["".join(r.choice("abcdefz") for _ in range(r.randint(1, 8))) for _ in range(100)]
    got = model.word_scores(words)
    for i, lang in enumerate(model.langs):
        score = kneser_ney(counts[lang], known)
        assert np.allclose(got[:, i], [score(w) for w in words], rtol=1e-4, atol=1e-3)


def test_many_labels_are_refused_and_repeats_teach_once(spark, monkeypatch):
    rows = [(i, "abc def", f"l{i}") for i in range(0, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGS", 5)
    with pytest.raises(ValueError, match="languages"):
        langid.train(d)
    monkeypatch.undo()
    same = spark.createDataFrame([(2, f"text {'ab'[i % 2]}", "en") for i in range(500)] + [(3 * i + 5, "the dog", "en") for i in range(3)] , "doc_id long, text string, lang string")
    assert langid.train(same).langs == ["en"]


# ---- columns that clash ------------------------------------------------------------------------------------------------


def test_clashing_columns(spark):
    import public_tokenizers as P

    names = "_terms Host found weight _found _copies _key mixed_key MIXED_COPIES Score Rejected H p size taken copies ids IDs2 bucket hits fp component_id spans n_email kind image points rank query_id v cell part".split()
    base = docs(spark, odd_texts()[:12] + [(100 + i, "the cat and the dog", "en", "s") for i in range(20)])
    d = base.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)), F.lit(1).alias("a.b"), F.lit(2).alias("back`tick"))
    n = d.count()
    mixed = mixing.take(d, F.array("source"))
    assert mixed.columns == d.columns and mixed.count() > 0
    assert mixing.mix(d, F.array("source")).count() == n
    judged = langid.identify(d, langid.train(d))
    assert judged.count() == n and judged.columns[-3:] == ["lang_pred", "score", "rejected"]
    assert {c.lower() for c in judged.columns} == {c.lower() for c in d.columns} | {"lang_pred"}
    coded = bpe.encode(d, P.path(queries.RANKS), P.PATTERN)
    assert coded.count() == n and [c for c in coded.columns if c.lower() == "ids"] == ["ids"]
    assert bpe.digest(d, P.path(queries.RANKS), P.PATTERN).count() == n
    assert secrets.mask_secrets(d).columns == d.columns and secrets.mask_secrets(d).count() == n
    assert secrets.scan_secrets(d).count() == pii.find_pii(d).count() == n
    assert simhash.near_duplicates(d).count() == n
    assert substrings.repeated_passages(d).count() == n
    urls = d.withColumn("url", F.lit("http://x/casino")).withColumn("Verdict", F.lit(1))
    got = urlfilter.filter_urls(urls)
    assert got.count() == n and [c for c in got.columns if c.lower() in ("host", "verdict")] == ["host", "verdict"]
    pics = d.select("doc_id", "_terms", "bucket", "points", "rank", F.lit(bytearray(b"no image")).alias("pic"))
    assert images.image_copies(pics, "doc_id", "pic").count() == n
    vectors = d.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), F.col("doc_id").alias("vec_id"))
    assert neighbours.nearest(vectors).count() > 0


# ---- the stages of the pipeline ----------------------------------------------------------------------------------------


def stage_rows(spark):
    same = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day"
    rows = odd_texts() + [(200 + i, same + f" {i // 8}", "en", ["s", None, "t"][i % 3]) for i in range(24)]
    rows += [(300, "password = hunter2hunter2 " + same, None, None), (301, "word " * 60_000, "en", "long"), (302, "client_id: shop-4711\nZx81kQ0pLmN4rT7u", "en", "")]
    return docs(spark, rows).union(docs(spark, [(None, None, None, None)] * 2))


@pytest.mark.parametrize("name", ["language", "near_duplicates", "secrets", "mixing", "tokens"])
def test_stages_take_odd_rows(spark, name):
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    d = stage_rows(spark)
    out = stage(spark, d, "")
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == d.count() and sum(r.n_tokens for r in rows if r.doc_id == 0) == 0
    else:
        assert out.columns == d.columns
    ids = Counter(r.doc_id for r in d.collect())
    got = Counter(r.doc_id for r in rows)
    if name == "language":  # a text without letters goes; so do those unlike what was learned
        assert not {0, 1, 2} & set(got) and got[201] == 1 and all(got[i] <= ids[i] for i in got)
    if name == "near_duplicates":  # rows without a key stay
        assert got[None] == ids[None] and got[200] == 1 and len(got) < len(ids)
    if name == "secrets":
        assert got == ids and all("hunter2" not in (r.text or "") for r in rows)
        assert {r.n_chars for r in rows if r.doc_id == 0} == {None}
    if name == "mixing":
        assert all(got[i] <= 3 * ids[i] for i in got) and got[0] == ids[0]
    empty = stage(spark, d.limit(0), "")
    assert empty.count() == 0


def test_stages_compose_and_match_brute_force(spark):
    import corpus_pipeline as P
    import public_tokenizers
    import tiktoken

    d = stage_rows(spark)
    kept = dict(P.STAGES)["near_duplicates"](spark, d, "")
    masked = {(r.doc_id, r.text) for r in dict(P.STAGES)["secrets"](spark, kept, "").collect()}
    assert masked == {(r.doc_id, secrets.mask(r.text)) for r in kept.collect()}
    ranks = bpe.read_ranks(open(public_tokenizers.path(queries.RANKS), "rb").read())
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in kept.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in dict(P.STAGES)["tokens"](spark, kept, "").collect()) == want
