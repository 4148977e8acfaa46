"""Each operator against plain code that follows its definition."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tesselark.llm import bpe, images, langid, mixing, neighbours, pii, queries, secrets, simhash, substrings, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    full = [(i, t, *(r[2:] if len(r := x) > 2 else ("en", "s"))) for x in rows for i, t in [x[:2]]]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in full], SCHEMA)


def odd_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(50)]
    base = [r.choice(words) for _ in range(60)]
    out = [(None, "no key"), (0, None), (1, ""), (2, " \n\t"), (3, "x" * 50_000), (4, "a b"), (5, "A b C")]
    for i in range(6, 60):
        t = base[:] if i % 3 == 0 else [r.choice(words) for _ in range(r.randint(1, 80))]
        if i % 3 == 1:
            k = r.randint(0, 40)
            t += base[k : k + r.randint(5, 30)]
        if i % 6 == 0:
            t[r.randint(0, len(t) - 1)] = "zz"
        out.append((i, r.choice([" ", "  ", "\n"]).join(t)))
    return out + [(8, "the key eight again"), out[20]]


def parts(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- 1 -----------------------------------------------------------------------------------------------------------


def test_mix_targets_are_met(spark, sf_dir):
    got = queries.op1_mix_sources(spark, sf_dir).toPandas()
    src = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(src)
    got["source"] = [src[i][0] for i in got.doc_id]
    assert all(n == len(parts(src[i][1])) for i, n in zip(got.doc_id, got["size"]))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, g in got.groupby("source"):
        assert g.source_size.nunique() == 1 and g.source_size.iloc[0] == g["size"].sum()
        # Ten documents a source here; whole documents can't come nearer.
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.05 * g.target.iloc[0], g["size"].min())
    assert got.target.groupby(got.source).first().sum() == pytest.approx(got["size"].sum())
    again = queries.op1_mix_sources(spark, sf_dir).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()


def test_targets_by_hand():
    # 60 words; weights 1, 2, 3; c may take 3 * 5, the other 45 are shared 1 : 2.
    assert mixing.targets([("a", 35), ("b", 20), ("c", 5)]) == {"c": 15.0, "a": 15.0, "b": 30.0}
    # Null comes last; its weight is 2 here.
    assert mixing.targets([(None, 50), ("z", 50)]) == {"z": pytest.approx(100 / 3), None: pytest.approx(200 / 3)}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flow_prefers_words_not_taken_yet():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 10})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 12
    assert sum(v for (_, s), v in flow.items() if s == "b") == 10
    used = defaultdict(int)
    for (p, _), v in flow.items():
        used[p] += v
    assert used == {("a",): 10, ("a", "b"): 10, ("b",): 2}  # everything once, nothing twice
    assert sum(mixing.min_cost_flow({("a",): 10}, {"a": 99}).values()) == 30


def test_mix_odd_rows(spark):
    import pyspark.sql.functions as F

    d = docs(spark, [(1, "a b c", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (4, "x y", "en", "s"), (4, "x y", "en", "s"), (None, "q", "en", "t")])
    rows = mixing.mix(d, F.array("source")).collect()
    assert len(rows) == 6 and len({r.taken for r in rows if r.doc_id == 4}) == 1
    assert mixing.mix(docs(spark, []), F.array("source")).count() == 0
    assert mixing.take(d, F.array("source")).columns == d.columns
    both = mixing.mix(d, F.array("source", F.lit("s")))  # overlapping sources
    assert both.count() == 6


# ---- 2 -----------------------------------------------------------------------------------------------------------


def test_urls(spark):
    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:k], rest[k:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0])) if fit else (None, None)
        u = (url or "").lower()
        on = lambda t: re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", u) is not None
        weight = sum(w for t, w in urlfilter.VOCABULARY if on(t))
        return host, path, rule, verdict or ("block" if weight >= 10 else "allow")

    urls = [None, "", "x", "http://", "http://a.NET/b", "http://net", "http://net/", "https://Example.com/de/x?y#z", "http://m.example.net/en/q", "http://example.org/fr/casino",
            "http://free-bets.example.com/", "http://freebets.example.com/bets", "http://a.com/casino", "http://a.com/casinos", "http://a.com?u=http://b.net/", "ftp://x.example.com#/de/", "http://free.com/free", "http://İ.com/ADULT/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, urls[5])], "page_id long, url string")
    for r in urlfilter.filter_urls(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


# ---- 3 and 7 ------------------------------------------------------------------------------------------------------


def pii_brute(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (pii.KINDS.index(s[2]), s[0]))


def test_pii_base_is_the_patterns():
    r = random.Random(1)
    pieces = ["a@b.c", "@", ".", "-", "+", "1", "23", "4.5", "@d.e", " ", "x_%", "+1 (23) 45-678 90", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "é", "\n", "00012.1.1.1"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        got = sorted(pii.base_spans(t), key=lambda s: (pii.KINDS.index(s[2]), s[0]))
        assert got == pii_brute(t), t
    pii.base_spans("9" * 200_000 + "a" * 200_000 + "@" * 2000)


def test_pii_method_adds_what_patterns_miss():
    w = pii.train()
    find = lambda t: [(k, t[b:e]) for b, e, k in pii.scan(t, w)[1]]
    assert find("please call (212) 555-7788 today") == [("phone", "(212) 555-7788")]
    assert find("write to jane.doe (at) example (dot) com soon") == [("email", "jane.doe (at) example (dot) com")]
    assert find("card 4111.1111.1111.1111 was used") == [("card", "4111.1111.1111.1111")]
    assert find("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up") == [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]
    for t in ("on 2024-01-05 at 10:30:22 we met", "version 1.20.3456 of 12345678", "ids 1234 5678 9012 345", "the 3,141,592 people", "no numbers at all", "isbn 12345-67890-1"):
        assert find(t) == [], t
    # Nothing is added over a base span, and base spans stay.
    t = "mail a@b.de or +1 (743) 555-3824 now"
    assert pii.scan(t, w)[0] == pii.scan(t, w)[1] == pii_brute_sorted(t)


def pii_brute_sorted(t):
    return pii_brute(t)


def secret_brute(t):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.BASE_KINDS.index(s[2])))


def test_secrets_base_is_the_patterns():
    r = random.Random(2)
    pieces = ["token", "API_KEY", "apikey", "passwd", "Secret", "=", ": ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "é", "ſecret", "zz"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
        assert secrets.base_spans(t) == secret_brute(t), t


def test_weak_parts_need_one_another():
    one, two = "client_id = shop-4711", "Zx81kQ0pLmN4rT7u"
    spans = lambda t: [(k, t[b:e]) for b, e, k in secrets.scan(t)[1]]
    assert spans(one) == spans(two) == spans("https://api.example.com/v1") == []
    assert spans(f"{one}\n{two}") == [("identifier", "shop-4711"), ("secret", two)]
    assert spans(f"{one}\n\n{two}") == []  # another scope
    far = [("identifier", "shop-4711"), ("secret", two)]
    assert spans(f"{one} {'word ' * 100} {two}") == spans(f"{one}\n{'some words here\n' * 400}{two}") == far  # anywhere in the scope
    assert spans("login: alice42 see https://example.com/page") == []  # no secret
    assert spans(f"login: alice42 see https://example.com/page {two}") == [("identifier", "alice42"), ("endpoint", "https://example.com/page"), ("secret", two)]
    assert spans(f"login: alice42 see https://example.com/page\n \npassword: hunter22") == [("assign", "password: hunter22")]
    assert spans("login: alice42\npassword: hunter22") == [("identifier", "alice42"), ("assign", "password: hunter22")]
    assert spans(f"use https://api.example.com/v1 with {two}") == [("endpoint", "https://api.example.com/v1"), ("secret", two)]
    assert secrets.mask(f"{one}\n{two} end") == "client_id = [SECRET]\n[SECRET] end"
    assert secrets.mask(None) is None and secrets.mask("plain") == "plain"


def test_weak_parts_are_whole_runs():
    r = random.Random(9)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123456789+/") for _ in range(86)) + "=="
    spans = lambda t: [(k, t[b:e]) for b, e, k in secrets.scan(t)[1]]
    t = f"AccountKey={key} account_id: shop-4711 https://blob.example.com/v1"
    assert spans(t) == [("secret", f"AccountKey={key}"), ("identifier", "shop-4711"), ("endpoint", "https://blob.example.com/v1")]
    late = "abcdefghijklmnopqrst" * 4 + "7"  # its only digit is far in
    assert spans(f"client_id: shop-4711 {late}")[1] == ("secret", late)
    user, url = "u1." * 100, "https://example.com/" + "a.b/" * 1000
    assert secrets.mask(f"user: {user} {url} {late} end") == "user: [SECRET] [SECRET] [SECRET] end"
    for t in ("user: abcd https://example.com/a a1b2c3d4e5f6g7h8i9 " * 20_000, "a1" * 200_000, "user=" * 80_000, "s3://" * 80_000, "jdbc:" * 80_000, "=" * 400_000, "jdbc:" + "a" * 400_000):
        secrets.scan(t)  # in time that grows with the length


@pytest.mark.parametrize("op, brute", [("op3_pii", pii_brute), ("op7_secrets", secret_brute)])
def test_scans_over_the_table(spark, sf_dir, op, brute):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.OPERATORS[op](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, e, k in base).encode()).hexdigest()
        assert {f"{k}:{b}:{e}" for b, e, k in base} <= set(r.spans.split(","))


def test_scans_odd_rows(spark):
    d = docs(spark, odd_texts())
    for out in (pii.find_pii(d), secrets.scan_secrets(d)):
        assert out.count() == d.count()
    assert pii.find_pii(docs(spark, [])).count() == secrets.scan_secrets(docs(spark, [])).count() == 0
    assert secrets.mask_secrets(d).columns == d.columns


# ---- 5 -----------------------------------------------------------------------------------------------------------


def test_neighbours(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in queries.op5_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    hits = total = 0
    vec = dict(rows)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        true = sorted(((-float(vec[q] @ v), i) for i, v in rows if i != q))[:20]
        assert [f[2] for f in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(vec[q] @ vec[i]), abs=1e-12) for i, s, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits, total = hits + len({i for _, i in true} & {f[0] for f in found}), total + 20
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 1.0]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0]), (44, [None, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (60, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[40] == list(range(20))
    assert set(got) == {0, 20, 40}
    few = spark.createDataFrame(rows[:1] + rows[40:41], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few).orderBy("query_id").collect()] == [(0, 40), (40, 0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


# ---- 6 -----------------------------------------------------------------------------------------------------------


def simhash_brute(t):
    w = parts("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, near):
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(items):
        for j, y in items[:a]:
            if near(x, y):
                a1, b1 = sorted((find(i), find(j)))
                root[b1] = a1
    return {i: find(i) for i, _ in items}


def test_simhash(spark):
    rows = odd_texts()
    keyed = [(i, simhash_brute(t)) for i, t in rows if i is not None]
    want = classes(keyed, lambda x, y: bin(x ^ y).count("1") <= 3)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = defaultdict(list)
    for i, t in rows:
        prints[i].append(f"{simhash_brute(t):016x}")
    for r in got:
        assert r.fingerprint in prints[r.doc_id]
    for r in got:
        if r.doc_id is not None and r.doc_id != 8:  # the key of two texts
            assert r.component_id == want[r.doc_id], r
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_connect_all_within_the_radius(spark, monkeypatch):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(5):
        for f in list(fps[:150]):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    fps = sorted(set(fps))
    want = classes([(f, f) for f in fps], lambda x, y: (x ^ y).bit_count() <= 3)
    for most in (3_000_000, 5000):
        monkeypatch.setattr(simhash, "SPLIT_VARIANTS", most)
        x = np.array(fps, np.uint64)
        a, b = simhash._meet(x, x, simhash._radius(x), list(range(64)))
        assert all((int(i) ^ int(j)).bit_count() <= 3 for i, j in zip(a, b))
        link = {(int(i), int(j)) for i, j in zip(a, b)}
        got = classes([(f, f) for f in fps], lambda x, y: (max(x, y), min(x, y)) in link)
        assert got == want
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    link = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()}
    assert classes([(f, f) for f in fps], lambda x, y: (x, y) in link or (y, x) in link) == want


# ---- 8 -----------------------------------------------------------------------------------------------------------


def test_bpe_is_tiktoken(spark, sf_dir):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, sf_dir).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    coder = bpe.replay_of(open(P.path(queries.RANKS), "rb").read(), P.PATTERN)
    r = random.Random(5)
    odd = ["", "aaaaaaaaaaaaaaa", "  \n\n  x", "日本語テキスト", "🎉🎉é́", "don't 'll 123456789", "x" * 3000, "ab" * 500]
    odd += ["".join(r.choice("abcde é\n'1.ñ日") for _ in range(60)) for _ in range(300)]
    for t, b in zip(odd, coder.encode_batch(odd)):
        assert np.frombuffer(b, "<u4").tolist() == enc.encode_ordinary(t), t
        assert coder.decode(b) == t.encode()


def test_bpe_odd_rows(spark):
    import public_tokenizers as P

    d = docs(spark, odd_texts())
    assert bpe.digest(d, P.path(queries.RANKS), P.PATTERN).count() == d.count()
    out = bpe.encode(d, P.path(queries.RANKS), P.PATTERN)
    assert out.where("ids IS NULL").count() == 0 and out.count() == d.count()
    assert bpe.digest(docs(spark, []), P.path(queries.RANKS), P.PATTERN).count() == 0


# ---- 9 -----------------------------------------------------------------------------------------------------------


def repeats_brute(rows):
    first = {}
    for i, t in rows:
        w = parts(t)
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = parts(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone |= set(range(k, k + 13))
        spans = ",".join(f"{k}:{next(e for e in range(k, len(w) + 1) if e not in gone)}" for k in sorted(gone) if k - 1 not in gone)
        out.append((i, len(w), len(gone), spans, hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark):
    rows = odd_texts()
    got = sorted(map(tuple, substrings.repeated_passages(docs(spark, rows)).collect()), key=str)
    assert got == repeats_brute(rows)
    assert any(r[2] for r in got)
    assert substrings.repeated_passages(docs(spark, [])).count() == 0


def test_repeats_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op9_repeats(spark, sf_dir).collect()), key=str)
    assert got == repeats_brute(rows)


# ---- 10 ----------------------------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op10_language(spark, sf_dir).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) == 0


@pytest.mark.parametrize("n", [60, 2400])
def test_unlike_texts_are_rejected_at_every_size(spark, n):
    r = random.Random(10)
    word = lambda signs: "".join(r.choice(signs) for _ in range(r.randint(2, 8)))
    texts = {g: [word(signs) for _ in range(300)] for g, signs in (("en", "abcdefgh"), ("de", "ijklmnop"))}
    rows = [(i, " ".join(r.choices(texts[g], k=60)), g) for i in range(n) for g in [("en", "de")[i % 8 == 0]]]
    odd = [(10**6 + i, " ".join(word("бгджзлпф") for _ in range(60)), None) for i in range(20)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.train(d)
    assert np.shape(model.cut) == np.shape(model.mean) == (2,) and np.isfinite(model.cut).all()
    got = {x.doc_id: x.rejected for x in langid.identify(d, model).collect()}
    assert all(got[i] for i, _, _ in odd) and not any(got[i] for i, _, _ in rows)


def test_language_odd_rows(spark, sf_dir):
    base = [(100 + i, t, g, "s") for i, (t, g) in enumerate([("the cat and the dog went over there", "en"), ("der hund und die katze gehen dorthin", "de")] * 20)]
    d = docs(spark, base + [(1, None), (2, ""), (3, "123 !?"), (None, "the dog"), (4, "the dog", None, "s")])
    got = {r.doc_id: r for r in langid.predictions(d).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "en"]
    assert got[1].score == 0 and got[3].rejected
    assert {r.lang_pred for r in langid.predictions(docs(spark, [(1, "abc", None, "s")])).collect()} == {"und"}
    assert langid.predictions(docs(spark, [])).count() == 0


def test_kneser_ney_is_a_distribution():
    from collections import Counter

    m = langid.fit({"x": Counter({"ab": 3, "abc": 2, "b": 1, "cab": 4}), "y": Counter({"zz": 5, "za": 1})})
    p = lambda w: np.exp(m.word_scores([w])[0].astype(float))
    assert (p("ab") > p("zz"))[0] and (p("zz") > p("ab"))[1]
    known = sum(p(a + b) for a in ["a", "b", "c", "z"] for b in ["", "a", "b", "c", "z"])
    assert (known < 1).all()


# ---- 4 -----------------------------------------------------------------------------------------------------------


def test_images_find_edited_and_cropped_copies(spark):
    r = np.random.default_rng(0)

    def scene():
        a = np.zeros((160, 200))
        for _ in range(120):
            y, x, h, w = r.integers(0, 150), r.integers(0, 190), r.integers(4, 40), r.integers(4, 40)
            a[y : y + h, x : x + w] = r.integers(0, 256)
        return a

    a, b = scene(), scene()
    crop, bright, turned = a[20:140, 30:180], a * 0.8 + 10, np.rot90(a).copy()
    put = lambda x: images.write_pgm(x)
    rows = [(1, put(a)), (2, put(crop)), (3, put(bright)), (4, put(turned)), (5, put(b)), (6, put(a)), (7, b"no image"), (8, None), (9, put(scene())), (10, b"no image"), (11, b"")]
    df = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in rows], "page_id long, image binary")
    got = {r.page_id: r for r in images.image_copies(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].class_id for i in range(1, 7)] == [1, 1, 1, 1, 5, 1]
    assert got[7].class_id == got[10].class_id == 7 and got[8].class_id == 8 and got[9].class_id == 9
    assert got[6].n_links == got[1].n_links == 3
    assert images.image_copies(df.limit(0)).count() == 0


def test_links_pass_by_lower_images_that_share_passages(spark):
    r = np.random.default_rng(7)
    kind = "image long, points array<struct<at:bigint,lo:bigint,hi:bigint>>"
    copy = r.integers(-(1 << 63), 1 << 63, (60, 2)).tolist()
    put = lambda d: [((13 * i << 20) | 7 * i, *map(int, x)) for i, x in enumerate(d)]
    rows = [(100, put(copy)), (101, put(copy)), (102, put(copy))]
    for k in range(14):  # each shares 4 descriptors with the copies and has 56 of its own
        own = r.integers(-(1 << 63), 1 << 63, (56, 2)).tolist()
        rows.append((k, put(own + copy[4 * k : 4 * k + 4])))
    rows.append((20, put(r.integers(-(1 << 63), 1 << 63, (90, 2)).tolist() + copy[::-1])))  # all of them, in other places
    got = {(x.a, x.b): x.votes for x in images.matches(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(101, 100): 60, (102, 100): 60, (102, 101): 60}


@pytest.mark.parametrize("n", [100, 300, 1700])
def test_edited_copies_of_short_pages_are_linked(n):
    r = random.Random(8)
    page = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))[:n]
    a, other = page(), page()
    k = a.index(" ", n // 2)
    pages = [a, f"{a[:k]}, edited,{a[k + 9:]}", other]
    owner, place, d = images.describe([images.read_netpbm(images.drawn(t)) for t in pages])
    ends = np.searchsorted(owner, range(4))
    one, edited, unlike = ((place[b:e], d[b:e].view("<i8")) for b, e in zip(ends, ends[1:]))
    linked = lambda x: images._votes(one, x) >= max(images.LEAST_VOTES, images.LEAST_SHARE * min(len(one[0]), len(x[0])))
    assert linked(edited) and not linked(unlike)


def test_descriptors_meet_at_every_distance_up_to_the_most():
    r = np.random.default_rng(6)
    at = np.arange(40, dtype=np.int64) * 13 << 20 | np.arange(40) * 7
    d = r.integers(-(1 << 63), 1 << 63, (40, 2))
    for n, want in ((4, 40), (images.MOST_BITS, 40), (images.MOST_BITS + 1, 0)):
        flips = np.zeros((40, 128), np.uint8)
        for row in flips:
            row[np.concatenate([r.choice(32, n // 4 + (k < n % 4), replace=False) + 32 * k for k in range(4)])] = 1
        assert images._votes((at, d), (at, d ^ np.packbits(flips, axis=1).view("<i8"))) == want


def test_netpbm_round_trip():
    a = np.arange(600).reshape(20, 30) % 256
    assert (images.read_netpbm(images.write_pgm(a)) == a).all()
    assert images.read_netpbm(b"P6 1 1 255\n\x00\x03\x06").tolist() == [[3.0]]
    assert images.read_netpbm(b"P5 9 9 255\nxx") is None and images.read_netpbm(None) is None


# ---- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_by_stage(spark, sf_dir):
    import corpus_pipeline as P

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs_.collect()}
    first = P.language(spark, docs_, sf_dir).cache()
    assert first.columns == docs_.columns and {r.doc_id for r in first.collect()} == set(rows)
    second = P.near_duplicates(spark, first, sf_dir).cache()
    want = classes(sorted((i, simhash_brute(r.text)) for i, r in rows.items()), lambda x, y: bin(x ^ y).count("1") <= 3)
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(want.values()))
    third = P.secret_scan(spark, second, sf_dir).cache()
    assert all(not secret_brute(r.text) and r.n_chars == len(r.text) for r in third.collect())
    fourth = P.mixture(spark, third, sf_dir).cache()
    assert fourth.columns == docs_.columns and 0 < fourth.count()
    assert max(r["count"] for r in fourth.groupBy("doc_id").count().collect()) <= 3
    assert P.tokens(spark, fourth, sf_dir).count() == fourth.count()
    assert P.run(spark, sf_dir).count() == fourth.count()
