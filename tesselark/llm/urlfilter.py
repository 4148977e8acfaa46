"""URL filter: path rules first, then a weighted vocabulary searched with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: A url is rejected when the weights of its distinct terms reach this: one strict term, two strong soft ones, or three of which one is weak.
REJECT_AT = 10
STRICT, STRONG, WEAK = 10, 5, 4
# Terms that reject by themselves, and terms that reject only together.
STRICT_TERMS = (
    "adult", "adultvideo", "casino", "escort", "escorts", "gambling", "hardcore", "hentai", "malware", "milf", "nsfw", "onlinecasino",
    "phishing", "porn", "porno", "pornography", "ransomware", "sexcam", "spam", "viagra", "warez", "xxx",
)
STRONG_TERMS = ("ads", "bet", "bets", "betting", "bonus", "cheap", "cialis", "free", "freespins", "jackpot", "keygen", "loan", "lottery", "nude", "payday", "pills", "poker", "roulette", "slots", "track", "win")
WEAK_TERMS = ("banner", "click", "coupon", "crack", "dating", "deal", "deals", "discount", "download", "lucky", "popup", "prize", "promo", "sexy", "torrent", "tracker", "winner")
VOCABULARY = tuple((t, w) for terms, w in ((STRICT_TERMS, STRICT), (STRONG_TERMS, STRONG), (WEAK_TERMS, WEAK)) for t in terms)
#: Every worker builds its automaton from the vocabulary; a table of more terms is refused.
MOST_TERMS = 1_000_000

# Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host plus path; the earlier of equals) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def vocabulary(df: DataFrame, term: str = "term", weight: str = "weight") -> tuple[tuple[str, int], ...]:
    """Terms and whole weights of a table, A-Z lower-cased; of a repeated term the largest weight. Rows with a null or empty term, or no weight over zero, are left out.

    More than MOST_TERMS terms are refused.
    """
    rows = df.select(F.translate(col(term).cast("string"), UPPER, LOWER).alias("term"), col(weight).cast("long").alias("weight")).where("term <> '' AND weight > 0")
    found = rows.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms; every worker holds them all")
    return tuple((r.term, r.weight) for r in found)


def _counter(terms: Broadcast):
    """A pandas UDF: distinct strict and soft terms of each url, between characters other than letters and digits, and the sum of their weights."""

    @F.pandas_udf("strict int, soft int, weight long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for term, weight in terms.value:
            machine.add_word(term, (len(term), term, weight))
        if len(machine):
            machine.make_automaton()
        low = str.maketrans(UPPER, LOWER)
        inner = set(LOWER + "0123456789")
        for urls in parts:
            rows = []
            for url in urls:
                found: dict[str, int] = {}
                if isinstance(url, str) and len(machine):
                    text = url.translate(low)
                    last = len(text) - 1
                    for end, (size, term, weight) in machine.iter(text):
                        begin = end - size
                        if (begin < 0 or text[begin] not in inner) and (end == last or text[end + 1] not in inner):
                            found[term] = weight
                strict = sum(w >= REJECT_AT for w in found.values())
                rows.append((strict, len(found) - strict, sum(found.values())))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return count


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, terms: tuple[tuple[str, int], ...] = VOCABULARY) -> DataFrame:
    """Adds ``host, path, rule, n_strict, n_soft, weight, verdict`` to every row (columns of these names, in any case, are replaced; the url is kept).

    The longest fitting rule decides; without one, the vocabulary does: ``block`` where the weights of the url's
    distinct terms reach REJECT_AT (a term of that weight is strict, others are soft), else ``allow``. Terms count between
    characters other than letters and digits. A null or empty url has no parts and no terms: allow.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    host, path = url_parts(col(url))
    rule, by_rule = best_rule(host, path, rules)
    names = ("host", "path", "rule", "n_strict", "n_soft", "weight", "verdict")
    rest = [c for c in df.columns if c == url or c.lower() not in names]
    found = _counter(df.sparkSession.sparkContext.broadcast(tuple(terms)))(col(url))
    made = fresh(df, "found")
    out = df.select(*map(col, rest), host.alias("host"), path.alias("path"), rule.alias("rule"), by_rule.alias("verdict"), found.alias(made))
    by_terms = F.when(F.col(f"{made}.weight") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        *map(col, rest), "host", "path", "rule",
        F.col(f"{made}.strict").alias("n_strict"), F.col(f"{made}.soft").alias("n_soft"), F.col(f"{made}.weight").alias("weight"),
        F.coalesce(F.col("verdict"), by_terms).alias("verdict"),
    )


def oracle_sql() -> str:
    """The same judgement as DuckDB SQL over ``pages``, term by term with regular expressions."""

    def hits(terms: tuple[tuple[str, int], ...], weighted: bool = False) -> str:
        one = "CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){}($|[^a-z0-9])') THEN {} ELSE 0 END"
        return " + ".join(one.format(t, w if weighted else 1) for t, w in terms)

    strict, soft = (tuple(x for x in VOCABULARY if (x[1] >= REJECT_AT) == kind) for kind in (True, False))

    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    pick = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)
    say = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS (
  SELECT *, CAST({hits(strict)} AS INTEGER) AS n_strict, CAST({hits(soft)} AS INTEGER) AS n_soft, CAST({hits(VOCABULARY, True)} AS BIGINT) AS weight FROM parts)
SELECT page_id, host, path, CASE {pick} END AS rule, n_strict, n_soft, weight,
       CASE {say} WHEN weight >= {REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""
