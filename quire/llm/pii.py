"""Personal data by weak supervision.

Candidates are the base matches of four kinds and looser forms of them (obfuscated addresses, numbers with neighbours
run into them, numbers without a country code). Four labelers vote on each candidate: for (1), against (-1) or not at
all (0): the strict pattern, a check of the value, a gazetteer of known prefixes and endings, and the words before it.
Expectation-maximisation over the counts of vote patterns of each kind, taken from the whole corpus, estimates how each
labeler votes on real and on false candidates; a logistic span classifier is then trained on the candidates' shapes and
votes with the estimated probabilities as targets, every kind with the same weight. Base matches stay whatever it says; other candidates are added where it is in
favour and nothing better overlaps. Only counts of (kind, votes, shape) reach the driver: bounded by the encoding.

Defined results: null and empty texts have no spans; null doc_ids and repeated rows are rows like others; ties in
probability go to the earlier, then the longer candidate; an empty table gives an empty result; whole texts of any
length are read; further columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is taken whole or not at all, so looking only at its start finds the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20-]?)[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
}
_AT = re.compile(r"[\[({]\s{0,3}(?:at|AT|@)\s{0,3}[\])}]")
_AT_DOMAIN = re.compile(r"\s{0,3}[A-Za-z0-9-]+(?:(?:\.|\s{0,3}[\[({]\s{0,3}(?:dot|DOT|\.)\s{0,3}[\])}]\s{0,3})[A-Za-z0-9-]+)+")

# Words that speak for a kind, words that speak against all, issuers' prefixes, endings of domains.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|client|from|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|payment|pay|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|cell|sms|telefon)\b", re.I),
}
AGAINST = re.compile(r"(?:\b(?:isbn|issn|version|release|part|order|invoice|serial|section|figure|table|token|password|hash|sha|id)\b|[=#$])\W*$", re.I)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38")
ENDINGS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl ch at eu ca au jp cn in br mx ru".split())
BEFORE = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base matches, by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out)


def loose(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the looser forms."""
    out = []
    for m in _AT.finditer(text):
        stop = m.start()
        while stop > 0 and text[stop - 1] == " " and m.start() - stop < 3:
            stop -= 1
        start = stop
        while start > 0 and stop - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < stop and (d := _AT_DOMAIN.match(text, m.end())):
            out.append((start, d.end(), 0))
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE.items():
            if kind != "ip" or text.count(":") >= 7:
                out += [(*m.span(), KINDS.index(kind)) for m in pattern.finditer(text)]
    return out


def vote(text: str, start: int, end: int, kind: int, strict: bool) -> tuple[int, int]:
    """The four votes, coded in base 3 (0 against, 1 none, 2 for), and the bits of the shape."""
    value, left = text[start:end], text[max(0, start - BEFORE) : start]
    digits = "".join(c for c in value if "0" <= c <= "9")
    name, alone = KINDS[kind], not left[-1:].isalnum() and not text[end : end + 1].isalnum()
    check, known = 0, 0
    if name == "card":
        check = 1 if luhn(digits) and len(set(digits)) > 1 else -1
        known = 1 if ISSUERS.match(digits) else -1
    elif name == "phone":
        check = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        known = 1 if value[0] in "+(" or value.startswith("00") else 0
        if len(digits) >= 13 and luhn(digits) and value[0] != "+":
            known = -1
    elif name == "ip":
        parts = value.split(".") if "." in value else value.split(":")
        check = 1 if len(parts) == 8 or all(p == "0" or p[0] != "0" for p in parts) else -1
        known = -1 if re.match(r"\.[0-9]", text[end : end + 2]) or left[-1:] == "." else 0
    else:
        ending = re.split(r"[^A-Za-z0-9]+", value)[-1].lower()
        check = 1 if not re.search(r"\.\.|^[.-]", value) else -1
        known = 1 if ending in ENDINGS else -1
    context = -1 if AGAINST.search(left) else 1 if FOR[name].search(left) else 0
    code = 0
    for v in (1 if strict else 0, check, known, context):
        code = code * 3 + v + 1
    shape = alone | (len(digits) >= 13) << 1 | ("+" in value) << 2 | ("(" in value or "[" in value) << 3 | (" " in value or "-" in value) << 4 | strict << 5
    return code, int(shape)


def candidates(text: str) -> list[tuple[int, int, int, int, int, bool]]:
    """(start, end, kind, votes, shape, is a base match) of all candidates, each span and kind once."""
    strict = base(text)
    seen = set(strict)
    out = [(*x, *vote(text, *x, True), True) for x in strict]
    for x in loose(text):
        if x not in seen:
            seen.add(x)
            out.append((*x, *vote(text, *x, False), False))
    return out


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(patterns' probabilities of being real, reliabilities[labeler, class, vote]) by expectation-maximisation.

    votes: (patterns, labelers) of 0 against, 1 none, 2 for. The start is the share of votes in favour; every estimate
    has a prior of a few votes that trusts a labeler slightly.
    """
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # false, real
    cast = (votes != 1).sum(axis=1)
    p = ((votes == 2).sum(axis=1) + 0.5) / (cast + 1.0)
    theta = np.empty((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for j in range(votes.shape[1]):
            for y, w in enumerate((counts * (1 - p), counts * p)):
                n = np.bincount(votes[:, j], w, 3) + prior[y]
                theta[j, y] = n / n.sum()
        share = (counts @ p + 1) / (counts.sum() + 2)
        log = np.log([[1 - share], [share]]) + sum(np.log(theta[j][:, votes[:, j]]) for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return p, theta


def unpack(kind: np.ndarray, code: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The votes, and the classifier's inputs: kind, votes and shape as indicators, shapes also by kind."""
    votes = np.stack([code // 27 % 3, code // 9 % 3, code // 3 % 3, code % 3], axis=1)
    kinds = np.eye(len(KINDS))[kind]
    bits = (shape[:, None] >> np.arange(6)) & 1
    marks = np.concatenate([np.eye(3)[votes[:, j]] for j in range(4)], axis=1)
    return votes, np.concatenate([kinds, bits, marks, (kinds[:, :, None] * marks[:, None, :]).reshape(len(kind), -1)], axis=1)


def classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression with soft targets, by Newton's method."""
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - target)) + ridge * w
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
    return w


def choose(found: list[dict], chance: dict[tuple[int, int, int], float], least: float) -> list[tuple[int, int, int]]:
    """All base spans, and the others that the classifier favours, the likeliest first, where nothing overlaps."""
    kept = [(c["start"], c["end"], c["kind"]) for c in found if c["base"]]
    likely = sorted((-chance[c["kind"], c["votes"], c["shape"]], c["start"], -c["end"], c["kind"]) for c in found if not c["base"] and chance[c["kind"], c["votes"], c["shape"]] >= least)
    # What is taken, as disjoint intervals in order.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, _ in sorted(kept):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for _, start, end, kind in likely:
        at = bisect_right(starts, start)
        if (not at or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= -end):
            starts.insert(at, start)
            ends.insert(at, -end)
            kept.append((start, -end, kind))
    return sorted(kept, key=lambda x: (x[0], x[2], x[1]))


_CANDIDATE = "struct<start: int, end: int, kind: int, votes: int, shape: int, base: boolean>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("votes", pa.int32()), ("shape", pa.int32()), ("base", pa.bool_())]))


def detect(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, end, kind name); base holds the base matches alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "votes", "shape", "base")
        for b in batches:
            found = [[dict(zip(names, c)) for c in candidates(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["doc_id", "found"])

    seen = staged(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, f"doc_id long, found array<{_CANDIDATE}>"), "candidates")
    counts = seen.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n")).collect()
    chance: dict[tuple[int, int, int], float] = {}
    if counts:
        kind, code, shape, n = (np.array([r[i] for r in sorted(counts)]) for i in range(4))
        votes, x = unpack(kind, code, shape)
        p, weight = np.empty(len(n)), np.empty(len(n))
        for k in np.unique(kind):  # labelers differ by kind, and a rare kind must not drown among the others
            of = kind == k
            p[of], _ = label_model(votes[of], n[of].astype(float))
            weight[of] = n[of] / n[of].sum()
        w = classifier(x, p, weight)
        chance = dict(zip(zip(kind.tolist(), code.tolist(), shape.tolist()), (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            named = [[[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans] for spans in part] for part in ([[(c["start"], c["end"], c["kind"]) for c in found if c["base"]] for found in rows], [choose(found, chance, least) for found in rows])]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, span) for x in named)], ["doc_id", "base", "spans"])

    one = "array<struct<start: int, end: int, kind: string>>"
    return mapped(seen, settle, f"doc_id long, base {one}, spans {one}")


def listed(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
