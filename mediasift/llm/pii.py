"""Personal data by weak supervision.

1. Regular expressions, a gazetteer and context words look at every whole text. The spans of four exactly defined kinds
   (email, ip, card, phone) are final; other spans are candidates.
2. Every labeler votes on each candidate: for, against, or not at all. The votes' patterns are counted over all texts.
3. Expectation-maximisation on those counts estimates how reliable each labeler is, and how likely each pattern is
   personal data (a latent class with independent votes).
4. A logistic span classifier is trained on those likelihoods, from features of the spans, over the counts of feature
   patterns; its decision admits a candidate. Counts are of bounded size: patterns of a few small values each.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.sources.shared import stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("person", "ssn", "iban", "tel", "birth", "street")
KINDS = BASE + ADDED

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As the plain expression, in linear time: a match starts where a run of digits does, and never gives digits back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Given names of the gazetteer.
NAMES = frozenset("Alice Anna Antonio Carlos Charles Claire Daniel David Elena Emily Emma Fatima Francois George Hans Henry Ingrid Isabel Jacques James Jean John Jose Juan Julia Karl Laura Louis Lucia Marie Maria Mark Martin Mary Michael Nina Olivia Paul Peter Pierre Robert Sarah Sofia Stefan Susan Thomas William".split())
#: Words near a span that speak for or against personal data.
FOR = re.compile(r"(?i)\b(?:name|contact|call|phone|tel|mobile|mr|mrs|ms|dr|ssn|iban|account|born|birth|address|lives?|appelle|nom|adresse|herr|frau|geboren|telefon|nombre|llama|tel[eé]fono|nacido)\b")
AGAINST = re.compile(r"(?i)\b(?:version|isbn|issn|order|invoice|figure|table|page|chapter|section|error|build|serial|item|sku|price)\b")
CANDIDATES = {
    "person": re.compile(r"\b[A-Z][a-zé]{2,14} [A-Z][a-zé]{2,20}\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "tel": re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
    "birth": re.compile(r"(?<![0-9])(?:[0-3]?[0-9]([./-])[01]?[0-9]\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9])"),
    "street": re.compile(r"\b[0-9]{1,4} [A-Z][a-z]+ (?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive)\b|\b[A-Z][a-zäöüß]+(?:straße|strasse) [0-9]{1,4}\b"),
}
#: A text without any of these can hold no added kind but a person.
_DIGIT = re.compile(r"[0-9]")
WINDOW = 40
LABELERS = ("form", "gazetteer", "context", "counter", "check")
#: Values of the features of a candidate: kind, known name, word for, word against, check, all upper case, character before
#: and after (none or blank, mark, letter or digit), length (under 10, 14, 20, or more), blanks, hash of the word before.
FEATURES = (6, 2, 2, 2, 3, 2, 3, 3, 4, 4, 8)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """The leftmost non-overlapping emails. A match needs an @, and starts at the first of the run of local characters
    before it that no earlier match has taken, so only the places around each @ are tried."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four exact kinds, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else []
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 2 if c.isalnum() else 1


def _features(kind: str, text: str, a: int, b: int, known: bool, for_: bool, against: bool, check: int) -> tuple[int, ...]:
    """Small values of a span and of what is beside it, see :data:`FEATURES`."""
    span = text[a:b]
    length = sum(b - a >= n for n in (10, 14, 20))
    before = re.search(r"([^\W\d_]+)[\W\d_]*$", text[max(0, a - WINDOW) : a])
    word = zlib.crc32(before[1].lower().encode()) % 7 + 1 if before else 0
    return (ADDED.index(kind), int(known), int(for_), int(against), check + 1, int(span == span.upper()), _kind_of(text[a - 1 : a] if a else ""), _kind_of(text[b : b + 1]), length, min(3, span.count(" ")), word)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, votes, features) of the spans that no base span overlaps."""
    out = []
    digits = _DIGIT.search(text) is not None
    apart: list[list[int]] = []  # base spans, joined where they overlap
    for a, b in sorted((a, b) for _, a, b in taken):
        if apart and a < apart[-1][1]:
            apart[-1][1] = max(b, apart[-1][1])
        else:
            apart.append([a, b])
    for kind, pattern in CANDIDATES.items():
        if kind != "person" and not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect_left(apart, [b]) - 1  # the last that starts before this span's end
            if k >= 0 and apart[k][1] > a:
                continue
            words = m[0].split()
            near = text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW]
            known = kind == "person" and words[0] in NAMES
            if kind == "person" and not known and not FOR.search(near):
                continue  # two capitalised words alone: no labeler speaks for them
            for_, against = FOR.search(near) is not None, AGAINST.search(near) is not None
            check = {"iban": lambda: 1 if _iban_ok(m[0]) else -1, "ssn": lambda: -1 if m[0][:3] in ("000", "666") or m[0][0] == "9" else 1}.get(kind, lambda: 0)()
            votes = (1 if kind != "person" else 0, (1 if known else -1) if kind == "person" else 0, 1 if for_ else 0, -1 if against else 0, check)
            out.append((kind, a, b, votes, _features(kind, text, a, b, known, for_, against, check)))
    return out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added, votes, features): spans as kind:start:end, and the votes and features of added candidates."""

    def run(batches):
        for batch in batches:
            base, added, votes, features = [], [], [], []
            for t in batch["text"]:
                found = base_spans(t or "")
                more = candidates(t or "", found)
                base.append([f"{k}:{a}:{b}" for k, a, b in found])
                added.append([f"{k}:{a}:{b}" for k, a, b, _, _ in more])
                votes.append([",".join(map(str, v)) for *_, v, _ in more])
                features.append([",".join(map(str, f)) for *_, f in more])
            yield pd.DataFrame({"id": batch["id"], "base": base, "added": added, "votes": votes, "features": features})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(run, f"id {kind}, base array<string>, added array<string>, votes array<string>, features array<string>")


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Expectation-maximisation over counted vote patterns: (likelihood of each pattern, chances of a labeler's votes
    -1, 0, 1 in both classes, share of personal data). Starts from the mean vote; add-one smoothing keeps chances inside."""
    patterns = sorted(counts)
    v = np.array(patterns, int).reshape(len(patterns), len(patterns[0]) if patterns else len(LABELERS)) + 1
    n = np.array([counts[p] for p in patterns], float)
    q = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))
    chance, share = np.full((v.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds if len(patterns) else 0):
        share = (n * q).sum() / n.sum() * 0.98 + 0.01
        for j, y, k in product(range(v.shape[1]), (0, 1), range(3)):
            w = n * (q if y else 1 - q)
            chance[j, y, k] = (w[v[:, j] == k].sum() + 1) / (w.sum() + 3)
        log = [np.log(chance[np.arange(v.shape[1]), y, v]).sum(axis=1) for y in (0, 1)]
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -30, 30)))
    return dict(zip(patterns, q.tolist(), strict=True)), chance, float(share)


def _encoded(features: np.ndarray) -> np.ndarray:
    """One column for each value of each feature, for a context word with each kind, and one for all."""
    kinds = np.eye(len(ADDED))[features[:, 0]]
    values = [np.eye(n)[features[:, k]] for k, n in enumerate(FEATURES)]
    return np.concatenate([*values, kinds * features[:, 2:3], np.ones((len(features), 1))], axis=1)


def classifier(counts: dict[tuple, tuple[float, float]], steps: int = 400) -> dict[tuple, float]:
    """Logistic regression on feature patterns, each with (weight, mean likelihood); gives the score of each pattern. There
    are at most as many patterns as values of the features go together, whatever the number of spans."""
    if not counts:
        return {}
    patterns = sorted(counts)
    x = _encoded(np.array(patterns, int))
    n, q = (np.array([counts[p][k] for p in patterns]) for k in (0, 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (n * (p - q)) / n.sum() + 1e-3 * w)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def _pattern(s: str) -> tuple[int, ...]:
    return tuple(map(int, s.split(",")))


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base, added) for every row: arrays of kind:start:end (code points, end exclusive), by kind as listed, then start.

    A null text is empty and has no spans; so has an empty table no rows. Repeated rows repeat, and count as often in the
    statistics. Other columns are not touched, whatever their names.
    """
    scanned = stored(scan(docs, id, text), "scanned")
    both = scanned.select(F.explode(F.arrays_zip("votes", "features")).alias("c")).groupBy("c.votes", "c.features").count().collect()  # patterns: a bounded number
    votes: dict[tuple, int] = {}
    for r in both:
        votes[_pattern(r["votes"])] = votes.get(_pattern(r["votes"]), 0) + r["count"]
    likely, _, _ = reliabilities(votes)
    sums: dict[tuple, list[float]] = {}
    for r in both:
        s = sums.setdefault(_pattern(r["features"]), [0.0, 0.0])
        s[0] += r["count"]
        s[1] += r["count"] * likely[_pattern(r["votes"])]
    scores = classifier({k: (n, s / n) for k, (n, s) in sums.items()})
    admitted = sorted(",".join(map(str, k)) for k, v in scores.items() if v >= least)
    pairs = F.filter(F.arrays_zip("added", "features"), lambda c: c["features"].isin(admitted) if admitted else F.lit(False))
    return scanned.select(F.col("id").alias(id), "base", F.transform(pairs, lambda c: c["added"]).alias("added"))


def masked(text: str | None, spans: list[str]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    if text is None:
        return None
    out, done = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans)):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = b
    return "".join([*out, text[done:]])


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: F.substring_index(s, ":", 1))
    numbers = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *numbers, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "added"), ",").alias("spans"))
