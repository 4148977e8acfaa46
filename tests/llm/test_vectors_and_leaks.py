"""Hard negatives, decontamination and vector codes against plain code, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tesselark.llm import codes, decontaminate, hardneg

V = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, width=8, labels=3, copies=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    rows = [(i, (centres[i % 5] + 0.3 * r.normal(size=width)).astype(np.float32).tolist(), int(r.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[3][1], int(r.integers(labels))) for i in range(copies)]


def odd(width=8):
    v = [0.5] * width
    return [(None, v, 1), (9001, None, 1), (9002, v, None), (9003, [*v[1:], None], 1), (9004, [*v[1:], float("nan")], 1), (9005, [*v[1:], float("inf")], 2), (9006, v[1:], 1), (9007, [0.0] * width, 1), (9100, v, 0), (9100, v, 0), (9200, [-x for x in v], 2)]


def clean(rows, width=8):
    good = [(i, v, g) for i, v, g in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.floor(256 * np.array(v, float)).astype(np.int64), g) for i, v, g in good]


# ---- hard negatives ----------------------------------------------------------------------------------------------


def mined_plainly(rows, every=100, p=5, n=5):
    rows = list({(i, tuple(v.tolist()), g): (i, v, g) for i, v, g in rows if i is not None and g is not None}.values())
    out = []
    for a, av, ag in rows:
        if a % every:
            continue
        scored = sorted((-int(av @ v), i, g) for i, v, g in rows if i != a)
        for s, i, g in [x for x in scored if x[2] == ag][:p]:
            hard = [x for x in scored if x[2] != ag and 80 * -s <= 100 * -x[0] <= 100 * -s][:n]
            out += [(a, i, r, x[1], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("seed, n, copies, cell", [(1, 700, 0, 2048), (2, 900, 400, 64), (3, 400, 0, 32)])
def test_hard_negatives(spark, monkeypatch, seed, n, copies, cell):
    monkeypatch.setattr(hardneg, "CELL_ROWS", cell)
    monkeypatch.setattr(hardneg, "PART_ROWS", 4 * cell)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    rows = vectors(seed, n, copies=copies) + odd()
    df = spark.createDataFrame(rows, V)
    got = hardneg.mine(hardneg.from_table(df), every=20).select(COLUMNS).collect()
    want = mined_plainly(clean(rows), every=20)
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], V)
    assert hardneg.mine(hardneg.from_table(empty)).count() == 0
    lone = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)], V)
    assert hardneg.mine(hardneg.from_table(lone)).count() == 0  # no positive
    # Labels of any type, clashing columns.
    named = spark.createDataFrame([(0, [1.0], "a", 1), (1, [1.0], "a", 2), (2, [0.9], "b", 3), (3, [0.7], "b", 3)], "vec_id long, embedding array<double>, label string, ids int")
    assert [tuple(r) for r in hardneg.mine(hardneg.from_table(named)).select(COLUMNS).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    huge = spark.createDataFrame([(100, [1e30], 1)], V)
    with pytest.raises(ValueError, match="too large"):
        hardneg.mine(hardneg.from_table(huge))


def test_scores_beyond_doubles(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(60_000_000, 90_000_000, 4).astype(np.int64), int(i % 2)) for i in range(200)]
    df = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in rows], "id long, v array<long>, label int")
    assert sorted(map(tuple, hardneg.mine(df, every=50).select(COLUMNS).collect())) == mined_plainly(rows, every=50)


def test_tree_prunes_and_keeps_ties():
    r = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([r.normal(size=(400, 6)) * 0.05 + c for c in r.normal(size=(10, 6)) * 3]))
    label = np.arange(len(x)) % 2
    x[7], x[11] = x[5], x[5]
    ids = r.permutation(len(x))
    tree = hardneg.BallTree(x, label)
    q, ql = x[:40], label[:40]
    low, high = np.full((40, 1), hardneg.NONE + 1), np.full((40, 1), -hardneg.NONE)
    rows, scores, scored = tree.search(q, ql, True, low, high, ids, 6)
    for i in range(40):
        s = [(-int(q[i] @ x[j]), ids[j], j) for j in range(len(x)) if label[j] == ql[i]]
        assert rows[i, 0].tolist() == [j for _, _, j in sorted(s)[:6]]
    assert scored < 0.25 * 40 * len(x)
    high = np.floor(scores[:, 0, 2:3] * 0.9).astype(np.int64)
    low = np.ceil(high * 0.5).astype(np.int64)
    rows, _, scored = tree.search(q, ql, False, low, high, ids, 5)
    for i in range(40):
        s = [(-int(q[i] @ x[j]), ids[j], j) for j in range(len(x)) if label[j] != ql[i] and low[i, 0] <= q[i] @ x[j] <= high[i, 0]]
        assert [j for j in rows[i, 0].tolist() if j >= 0] == [j for _, _, j in sorted(s)[:5]]
    assert scored < 0.5 * 40 * len(x)


# ---- codes -------------------------------------------------------------------------------------------------------


def coded_plainly(rows, parts=16, entries=64, rounds=2):
    seeds = {}
    for i, v, _ in rows:
        if i is not None:
            seeds[i] = min(seeds.get(i, v.tolist()), v.tolist())
    x = np.array([v for _, v, _ in rows])
    first = np.array([seeds[i] for i in sorted(seeds)[:entries]])
    books = np.array_split(first, parts, axis=1)
    pieces = np.array_split(x, parts, axis=1)

    def near(p):
        d = ((pieces[p][:, None] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = near(p)
            books[p] = np.array([pieces[p][at == e].sum(axis=0) // (at == e).sum() if (at == e).any() else books[p][e] for e in range(len(first))])
    found = [near(p) for p in range(parts)]
    code = ["".join(f"{found[p][0][r]:02x}" for p in range(parts)) for r in range(len(rows))]
    error = sum(f[1] for f in found)
    per = {}
    for (_, _, g), e in zip(rows, error):
        per[g] = per.get(g, 0) + int(e)
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(i, c, int(e), per[g], sha) for (i, _, g), c, e in zip(rows, code, error)]


@pytest.mark.parametrize("width, n, copies", [(32, 300, 100), (20, 150, 0), (16, 30, 0)])
def test_codes(spark, width, n, copies):
    rows = vectors(width, n, width, copies=copies) + odd(width)
    got = codes.digest(spark.createDataFrame(rows, V)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(coded_plainly(clean(rows, width)), key=key)


def test_codes_of_odd_tables(spark, monkeypatch):
    assert codes.digest(spark.createDataFrame([], V)).count() == 0
    assert codes.digest(spark.createDataFrame([(None, [1.0] * 16, 1), (2, None, 1)], V)).count() == 0  # no id to begin with
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], V))
    monkeypatch.setattr(codes, "FEW_LABELS", 0)  # labels joined by a shuffle
    rows = vectors(9, 60, 16) + odd(16)
    got = codes.digest(spark.createDataFrame(rows, V))
    assert {r.vec_id: r.label_error for r in got.collect()} == {r[0]: r[3] for r in coded_plainly(clean(rows, 16))}


def test_exponion_compares_few_entries():
    r = np.random.default_rng(8)
    x = codes.cut((r.normal(size=(500, 64)) * 256).astype(np.int64) + 2000 * r.integers(0, 40, size=(500, 1)), 16)
    books = codes.Codebooks(np.ascontiguousarray(x[:64].transpose(1, 0, 2)), 64)
    want = ((x[:, :, None] - books.entries[None]) ** 2).sum(axis=3)
    for before in (books.start(x), r.integers(0, 64, size=x.shape[:2])):
        code, error, looked = books.assign(x, before)
        assert (code == want.argmin(axis=2)).all() and (error == want.min(axis=2)).all()
    code, _, looked = books.assign(x, code)
    assert looked < 0.2 * want.size
    again = books.decode(code)
    assert (((codes.cut(again, 16) - x) ** 2).sum(axis=(1, 2)) == error.sum(axis=1)).all()


# ---- leaks -------------------------------------------------------------------------------------------------------


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks_plainly(docs, items, window=10, within=20):
    out = []
    for key, text in docs:
        w = split(text)
        hit, near, ids = set(), set(), set()
        for i, t in items:
            q = split(t)
            if i is None or not q:
                continue
            for s in range(max(1, len(q) - window + 1)):
                g = q[s : s + window]
                at = [k for k in range(len(w) - len(g) + 1) if w[k : k + len(g)] == g]
                for k in at:
                    hit |= set(range(k, k + len(g)))
                    ids.add(str(i))
                for b in range(len(w)):
                    if w[b] in g:
                        e = next((e for e in range(b + 1, min(len(w), b + within) + 1) if set(g) <= set(w[b:e])), None)
                        if e and w[b] not in w[b + 1 : e] and not any(k < e and k + len(g) > b for k in at):
                            near |= set(range(b, e))
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), len(near)))
    return out


def leaky():
    r = random.Random(6)
    names = [r.choice("abcdefgh") + r.choice(["", "é", "1", "ño"]) for _ in range(25)]
    item = lambda n: [r.choice(names) for _ in range(n)]
    tests = [(i, item(n)) for i, n in enumerate([30, 12, 10, 4, 1, 3, 25, 25])] + [(30, item(11)), (31, []), (None, item(12))]
    tests += [(7, tests[0][1][5:20]), (33, tests[1][1])]
    docs = []
    for k in range(120):
        w = item(r.randint(0, 60))
        if k % 3 == 0:
            q = r.choice(tests)[1]
            b = r.randint(0, max(0, len(q) - 10))
            part = q[b : b + r.randint(5, 15)]
            if k % 2:
                part = part[:]
                r.shuffle(part)
            w[r.randint(0, len(w)) :] = part + item(3)
        docs.append((k, r.choice([" ", ", ", "\n\t-"]).join(x.upper() if r.random() < 0.3 and x.isascii() else x for x in w)))
    docs += [(None, " ".join(tests[0][1])), (200, None), (201, ""), (202, "?! \x00"), (5, " ".join(tests[2][1])), (5, " ".join(tests[2][1])), (203, " ".join(item(20_000)) + " " + " ".join(tests[0][1]))]
    return docs, [(i, None if i == 31 else " ".join(q)) for i, q in tests]


@pytest.mark.parametrize("slice_bytes, block, starts", [(8 << 20, 1 << 20, 1 << 20), (300, 20, 50)])
def test_leaks(spark, monkeypatch, slice_bytes, block, starts):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "STARTS", starts)
    monkeypatch.setattr(decontaminate, "SLICE", slice_bytes)
    docs, items = leaky()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, slice int")
    t = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    got = decontaminate.digest(d, t).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(leaks_plainly(docs[:-1], items), key=key)
    assert sorted((tuple(r) for r in got if r.doc_id != 203), key=key) == want
    assert sum(r[2] > 0 for r in want) > 20 and sum(r[6] > 0 for r in want) > 5
    long = next(r for r in got if r.doc_id == 203)
    assert long.n_words == 20_030 and long.n_hit >= 30 and long.contaminated


def test_leaks_as_spans(spark):
    d = spark.createDataFrame([(1, "x one two three y"), (2, "three and two, then one")], "doc_id long, text string")
    t = spark.createDataFrame([("q", "One two THREE")], "item_id string, text string")
    got = {tuple(r) for r in decontaminate.matches(d, t).collect()}
    assert got == {(1, "q", "phrase", 1, 4), (2, "q", "near", 0, 5)}
    assert decontaminate.matches(d.limit(0), t).count() == 0 and decontaminate.matches(d, t.limit(0)).count() == 0
    assert decontaminate.digest(d, t.limit(0)).where("n_hit = 0 AND NOT contaminated AND n_items = 0").count() == 2
