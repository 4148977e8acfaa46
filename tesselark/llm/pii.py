"""Personal data: exact base patterns, plus spans that a semi-Markov conditional random field finds.

A reading of a text is a chain of labelled segments: entities of at most ``MAX_TOKENS`` tokens, and single
tokens outside of them. The field scores whole candidate segments (not single tokens), whose digits,
checksum, groups, separators and the words before are features of the segment as one, and the
transition from each segment's label to the next one's. A dynamic programme over token boundaries and labels
chooses boundaries and types jointly. Tokens that the base patterns cover are
barred from it, so base spans always stay and added spans never overlap them.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns. The look-behinds only spare hopeless starts within a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def _emails(text: str) -> list[tuple[int, int, str]]:
    """From each ``@``: the run of local characters before it, back to the last match, and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)  # no match can span this @
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, leftmost and non-overlapping per kind, in order of kind, then start."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# ---- the field -------------------------------------------------------------------------------------------------

MAX_TOKENS = 15
#: An added span must beat the best reading without it by this much (log score).
MARGIN = 2.0

_TOKEN = re.compile(r"[^\W_]+|[^\s]")
#: Where an entity may be: seven digits near together, an at sign or a word for it, or a chain of hex groups and colons.
_HOT = re.compile(r"[0-9](?:[^0-9\n]{0,2}[0-9]){6}|@|[\[({] ?at ?[\])}]|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]", re.IGNORECASE | re.ASCII)
_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_MAIL = re.compile(r"[\w.%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[\w-]+(?: ?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]|\bdot\b) ?[\w-]+)+", re.IGNORECASE)
_CUES = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"),
}


def _features(s: str, before: str, left: str, right: str) -> list[str]:
    """Features of a whole segment ``s``; ``before`` is the text just before it, left and right the adjacent characters."""
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    n = len(digits)
    out = ["bias", f"digits{min(n, 20)}", f"groups{min(len(groups), 7)}"]
    if 2 <= len(groups) <= 6:
        out.append("shape" + ".".join(str(min(len(g), 9)) for g in groups))
    if n >= 13:
        out.append("luhn" if luhn(digits) else "notluhn")
    if 13 <= n <= 19:
        out.append("cardlong")
    if 9 <= n <= 15:
        out.append("phonelong")
    kinds = {c for c in s if not c.isalnum()}
    out += [f"has{c}" for c in sorted(kinds & set(" -.()/+:@"))]
    out.append("seps" + str(min(len(kinds), 4)))
    out.append("letters" if any(c.isalpha() for c in s) else "noletters")
    if s[0] == "+" or s.startswith("00"):
        out.append("intl")
    if re.fullmatch(r"\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ .-][0-9]{3,4}", s):
        out.append("local")
    if len(groups) >= 4 and len({len(g) for g in groups[:-1]}) == 1 and len(groups[0]) == 4:
        out.append("fours")
    if ". " in s:
        out.append("dotspace")
    if len(groups) > 2 and s.count(" - ") == len(groups) - 1:
        out.append("dashes")
    if _MAIL.fullmatch(s):
        out.append("mailform")
    if _AT.search(s):
        out.append("at")
    if re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)[0-9A-Fa-f:]{5,39}", s) and s.count(":") >= 3 and n:
        out.append("hexgroups")
    if re.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}.*", s):
        out.append("date")
    if left and (left.isalnum() or left in "_-+."):
        out.append("leftopen")
    if right and (right.isalnum() or right in "_@%-"):
        out.append("rightopen")
    near = set(re.findall(r"[^\W\d_]+", before.lower())[-3:])
    out += [f"cue_{k}" for k, words in _CUES.items() if near & set(words)]
    return out


def _segments(text: str, lo: int, hi: int, barred: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of text[lo:hi], and candidate segments (first token, last token + 1, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    begins = [b for b, _ in barred]
    bad = [bool((i := bisect.bisect_left(begins, e)) and barred[i - 1][1] > b) for b, e in tokens]
    found = []
    for i, (b, _) in enumerate(tokens):
        if bad[i] or not (text[b].isalnum() or text[b] in "+(:"):
            continue
        digits = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            tb, te = tokens[j]
            if bad[j] or j > i and (tb - tokens[j - 1][1] > 1 or text[tokens[j - 1][1] : tb] == "\n"):
                break
            digits += sum(map(str.isdigit, text[tb:te]))
            if not text[te - 1].isalnum() or j == i and digits < 7:
                continue
            s = text[b:te]
            if digits >= 7 or _AT.search(s) or s.count(":") >= 3:
                found.append((i, j + 1, _features(s, text[max(0, b - 40) : b], text[b - 1] if b else "", text[te] if te < len(text) else "")))
    return tokens, found


#: Labels of segments: 0 is a token outside of entities.
OUTSIDE = "outside"
LABELS = (OUTSIDE, *KINDS)


def _sum(terms: list[float]) -> float:
    """Log of the sum of exponentials."""
    top = max(terms, default=-math.inf)
    if len(terms) < 2 or top == -math.inf:
        return top
    return top + math.log(sum([math.exp(t - top) for t in terms]))


def _by_end(n: int, found: list) -> list[list[tuple[int, int]]]:
    """By last token + 1: first token of each candidate segment, and its row of ``scores``."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for row, (i, j, _) in enumerate(found):
        out[j].append((i, row))
    return out


def _chains(n: int, ends: list, scores: list[list[float]], turn: list[list[float]]) -> tuple[list, list, list, list]:
    """Log sums over readings, by token boundary and label: of the tokens before that end with a segment of the label; of those
    and the turn to the label; of the tokens after that begin with a segment of the label; and of those after a segment of the label.

    ``scores``: of each candidate segment by kind; ``turn``: from each label to another. A text begins as after a token outside.
    """
    every, kinds = range(len(LABELS)), range(1, len(LABELS))
    starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for j, segments in enumerate(ends):
        for i, row in segments:
            starts[i].append((j, row))
    no = -math.inf
    done, into = [[0.0] + [no] * len(KINDS)], []
    for j in range(n + 1):
        if j:
            done.append([into[j - 1][0]] + [_sum([into[i][y] + scores[row][y - 1] for i, row in ends[j]]) for y in kinds])
        into.append([_sum([done[j][a] + turn[a][y] for a in every if done[j][a] > no]) for y in every])
    after, first = [[0.0] * len(LABELS)], [[no] * len(LABELS)]
    for i in range(n - 1, -1, -1):
        back = n - 1 - i  # both lists run backwards
        first.append([after[back][0]] + [_sum([scores[row][y - 1] + after[n - j][y] for j, row in starts[i]]) for y in kinds])
        after.append([_sum([turn[a][y] + first[-1][y] for y in every if first[-1][y] > no]) for a in every])
    return done, into, first[::-1], after[::-1]


class Field:
    """Weights of features by kind, and of transitions between labels."""

    def __init__(self, names: list[str], weights: np.ndarray, turn: np.ndarray) -> None:
        self.index, self.weights, self.turn = {f: i for i, f in enumerate(names)}, weights, turn

    def scores(self, found: list) -> np.ndarray:
        """Of each candidate segment, by kind; features never seen count nothing."""
        out = np.zeros((len(found), len(KINDS)))
        get = self.index.get
        for row, (_, _, f) in enumerate(found):
            at = [i for i in map(get, f) if i is not None]
            out[row] = self.weights[at].sum(axis=0)
        return out

    def read(self, n: int, found: list, margin: float = 0.0) -> list[tuple[int, int, str]]:
        """The best reading's entities (first token, last token + 1, kind); each must be worth ``margin`` more than nothing."""
        scores = self.scores(found) - margin
        ends = _by_end(n, found)
        best = np.full((n + 1, len(LABELS)), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            into = best[j - 1] + self.turn[:, 0]
            a = int(into.argmax())
            best[j, 0], back[j, 0] = into[a], (j - 1, a)
            for i, row in ends[j]:
                into = best[i][:, None] + self.turn[:, 1:] + scores[row]
                for y, a in enumerate(into.argmax(axis=0).tolist(), 1):
                    if into[a, y - 1] > best[j, y]:
                        best[j, y], back[j, y] = into[a, y - 1], (i, a)
        out = []
        j, y = n, int(best[n].argmax())
        while j:
            i, a = back[j, y]
            if y:
                out.append((i, j, LABELS[y]))
            j, y = i, a
        return out[::-1]


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Seeded snippets with known spans, and ones with numbers that are no personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        while True:
            s = r.choice("3456") + d(15)
            if luhn(s):
                return r.choice(["{}.{}.{}.{}", "{}/{}/{}/{}", "{} - {} - {} - {}", "{}  {}  {}  {}".replace("  ", ". ")]).format(*(s[i : i + 4] for i in range(0, 16, 4)))

    at, dot = lambda: r.choice([" (at) ", " [at] ", "(at)", "[at]", " {at} "]), lambda: r.choice([" (dot) ", " [dot] ", ".", "[.]", " dot "])
    make = {
        "email": lambda: f"{word()}{r.choice(['', '.' + word(), '_' + word(), d(2)])}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)),
        "card": card,
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
    }
    clean = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
        lambda: d(r.randint(7, 20)),
        lambda: f"{d(4)} {d(4)} {d(4)} {d(3)}",
        lambda: " ".join(d(r.randint(1, 6)) for _ in range(r.randint(3, 8))),
        lambda: f"{d(3)},{d(3)},{d(3)}",
        lambda: f"{d(1)}.{d(2)}.{d(5)}",
        lambda: f"{word()} @ {d(2)}.{d(2)}",
        lambda: f"{word()}{d(8)}{word()}",
        lambda: f"{d(5)}-{d(5)}-{d(1)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{word()} (at) {word()} {word()}",
        lambda: "-".join(d(r.choice([2, 3, 5])) for _ in range(5)),
    ]
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 3))) + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.5:
                    text += r.choice(_CUES[kind]) + r.choice([" ", ": "])
                s = make[kind]()
                gold.append((len(text), len(text) + len(s), kind))
            else:
                s = r.choice(clean)()
            text += s + r.choice([" ", ", ", ". "]) + word() + " "
        out.append((text, gold))
    return out


@lru_cache(maxsize=4)
def train(n: int = 400, rounds: int = 8, seed: int = 7) -> Field:
    """The field: stochastic gradient ascent on the conditional log-likelihood of seeded snippets."""
    data = []
    names: dict[str, int] = {}
    for text, gold in _examples(n, seed):
        tokens, found = _segments(text, 0, len(text), [])
        spans = {(b, e): LABELS.index(k) for b, e, k in gold}
        truth = {row: spans[tokens[i][0], tokens[j - 1][1]] for row, (i, j, _) in enumerate(found) if (tokens[i][0], tokens[j - 1][1]) in spans}
        if len(truth) == len(gold):
            rows = [np.array([names.setdefault(f, len(names)) for f in x]) for _, _, x in found]
            # The labels of the true reading, segment by segment.
            at = {found[row][0]: (found[row][1], y) for row, y in truth.items()}
            labels, place = [0], 0
            while place < len(tokens):
                place, y = at.get(place, (place + 1, 0))
                labels.append(y)
            data.append((len(tokens), found, rows, truth, labels))
    w, turn = np.zeros((len(names), len(KINDS))), np.zeros((len(LABELS), len(LABELS)))
    r = random.Random(seed)
    for k in range(rounds):
        rate = 0.5 / (1 + 0.2 * k)
        r.shuffle(data)
        for length, found, rows, truth, labels in data:
            scores = [w[x].sum(axis=0).tolist() for x in rows]
            ends, now = _by_end(length, found), turn.tolist()
            done, into, first, after = _chains(length, ends, scores, now)
            whole = _sum(done[length])
            # Expected turns at each boundary, and expected segments.
            head, tail = np.array(done[:-1]), np.array(first[:-1])
            steps = np.exp(head[:, :, None] + turn + tail[:, None, :] - whole).sum(axis=0)
            for j, segments in enumerate(ends):
                for i, row in segments:
                    p = [math.exp(into[i][y] + scores[row][y - 1] + after[j][y] - whole) for y in range(1, len(LABELS))]
                    if max(p) > 1e-4:
                        w[rows[row]] -= rate * np.array(p)
            for a, b in zip(labels, labels[1:]):
                steps[a, b] -= 1
            turn -= rate * steps / max(1, len(labels) - 1)
            for row, y in truth.items():
                w[rows[row], y - 1] += rate
        w *= 1 - 0.01 * rate
    return Field(list(names), w, turn)


def accuracy(field: Field, n: int = 300, seed: int = 99) -> tuple[float, float]:
    """Precision and recall of exact spans and kinds on snippets that were not trained on."""
    right = found = true = 0
    for text, gold in _examples(n, seed):
        got = set(added_spans(text, [], field))
        right, found, true = right + len(got & set(gold)), found + len(got), true + len(gold)
    return right / max(1, found), right / max(1, true)


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """The best reading's segments, outside of base spans, that beat the reading without them by ``MARGIN``."""
    barred: list[tuple[int, int]] = []
    for b, e, _ in sorted(base):
        if barred and b <= barred[-1][1]:
            barred[-1] = (barred[-1][0], max(barred[-1][1], e))
        else:
            barred.append((b, e))
    regions: list[list[int]] = []
    for m in _HOT.finditer(text):
        i = bisect.bisect_right(barred, (m.start(), len(text) + 1)) - 1
        if i >= 0 and barred[i][1] >= m.end():
            continue  # wholly within base spans
        lo, hi = max(0, m.start() - 60), min(len(text), m.end() + 60)
        while lo and not text[lo - 1].isspace() and m.start() - lo < 400:
            lo -= 1
        while hi < len(text) and not text[hi].isspace() and hi - m.end() < 400:
            hi += 1
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], hi)
        else:
            regions.append([lo, hi])
    out = []
    for lo, hi in regions:
        tokens, found = _segments(text, lo, hi, barred)
        if found:
            out += [(tokens[i][0], tokens[j - 1][1], y) for i, j, y in field.read(len(tokens), found, MARGIN)]
    return out


def scan(text: str | None, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, in order of kind, then start; null is the empty text."""
    text = text or ""
    base = base_spans(text)
    order = lambda s: (KINDS.index(s[2]), s[0])
    return sorted(base, key=order), sorted(base + added_spans(text, base, field), key=order)


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, counts of base spans by kind, their digest, all spans, and how many were added.

    Null and empty texts have no spans; the key is passed on as it is, null included.
    Repeated rows give repeated results. Other columns are not read.
    """
    field = train()  # some hundred numbers
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1).to_pylist():
            base, every = scan(t, field)
            n = Counter(k for _, _, k in base)
            rows.append((*(n[k] for k in KINDS), hashlib.sha256(_line(base).encode()).hexdigest(), _line(every), len(every) - len(base)))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return map_text(df.select(col(key), col(text)), run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
