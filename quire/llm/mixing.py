"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by source, language and topic; the cells' weights are raked in turn to the target shares of
each of the three, until all marginals agree. Dividing by the largest ratio makes probabilities of the calibrated ratios
of weight to tokens, and a document is kept where a hash of its id and text falls below its cell's probability: decisions
depend on the document alone, so any executor makes them again alike. Only cells are collected; targets name values of
the three columns, and `cells` bounds how many combinations there may be (an error beyond it, nothing is dropped).

Topic is a column of the input where one is named; else learned: the whole of every text is described by how its bytes
are made up (its length in words, the length of words, shares of digits, capitals, marks, symbols and line ends), and
k-means over all texts, equal ones counting once, makes TOPICS groups, in rounds until no centre moves (an error where
ROUNDS do not suffice); a document has the topic of the nearest centre. Features are summed as whole multiples of
1 / UNIT, so that no order of tasks changes a centre; what reaches the driver of each round is a row a group. Words are
runs of bytes that are no ASCII white space.

Defined results: null source, lang or topic are values like others, written as (none); null and empty texts have no
tokens and are kept, for they change no weight; repeated rows share one decision; values without a target keep their
observed share among all such; targets of absent values are left out and the others scaled up; an empty table gives an
empty result; further columns are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, small_batches, staged
from .vectors import centres, nearest

NONE, CELLS = "(none)", 200_000
MARGINALS = ("source", "lang", "topic")
TOPICS, ROUNDS, UNIT = 6, 1000, 1 << 20
#: Bytes that are looked at together.
BLOCK = 1 << 18
#: Kinds of bytes: letters and other, white space, line ends, digits, capitals, marks, symbols.
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 11, 12, 13, 32]], KINDS[10], KINDS[48:58], KINDS[65:91] = 1, 2, 3, 4
KINDS[[ord(c) for c in "!\"'(),-.:;?"]] = 5
KINDS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_SCHEMA = "tokens long, topic string"
FEATURES = tuple(f"f{i}" for i in range(7))


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, 8): bytes of each kind, and words."""
    out = np.zeros((len(texts), 8), np.int64)
    part: list[int] = []

    def settle(data: np.ndarray, whose: np.ndarray, before: bool) -> None:
        kind = KINDS[data]
        out[:, :7] += np.bincount(whose * 7 + kind, minlength=7 * len(texts)).reshape(-1, 7)
        inside = (kind != 1) & (kind != 2)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (whose[1:] != whose[:-1])
        begins[0] &= not before
        out[:, 7] += np.bincount(whose[begins], minlength=len(texts))

    def gathered() -> None:
        if part:
            length = np.array([len(texts[i]) for i in part])
            settle(np.frombuffer(b"".join(texts[i] for i in part), np.uint8), np.repeat(part, length), False)
            part.clear()

    size = 0
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            for at in range(0, len(t), BLOCK):
                data = np.frombuffer(t[at : at + BLOCK], np.uint8)
                settle(data, np.full(len(data), i), at > 0 and KINDS[t[at - 1]] not in (1, 2))
        elif t:
            part.append(i)
            size += len(t)
            if size >= BLOCK:
                gathered()
                size = 0
    gathered()
    return out


def described(found: np.ndarray) -> np.ndarray:
    """Features of counts: logarithms of words and of bytes a word, shares of the kinds of bytes (their roots)."""
    words, size = found[:, 7:], found[:, :7].sum(axis=1, keepdims=True)
    return np.concatenate([np.log1p(words), np.log1p(size / np.maximum(words, 1)), np.sqrt(found[:, 2:7] / np.maximum(size, 1))], axis=1)


class Topics:
    """Centres of groups of texts by their counts, each feature on the scale of its spread; none where no text is known."""

    def __init__(self, found: list[list[int]], topics: int = TOPICS):
        x = described(np.array(found)) if len(found) else np.zeros((0, 7))
        self.spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0) if len(x) else np.ones(7)
        self.centres = centres(x / self.spread, topics) if len(x) else x

    def of(self, found: np.ndarray) -> np.ndarray:
        return nearest(described(found) / self.spread, self.centres)


def grouped(points: DataFrame, now: np.ndarray, scale: np.ndarray) -> DataFrame:
    """For each centre with points nearest to it: its number, their number and the sums of their features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(now), 1 + len(FEATURES)), np.int64)
        for b in batches:
            if b.num_rows:
                x, n = np.stack([c.to_numpy() for c in b.columns[:-1]], axis=1), b.columns[-1].to_numpy()
                own = (((x[:, None] - now) / scale) ** 2).sum(axis=2).argmin(axis=1)
                np.add.at(sums, own, np.concatenate([n[:, None], x * n[:, None]], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), *(pa.array(c) for c in sums.T)], ["k", "n", *FEATURES])

    parts = mapped(points.select(*FEATURES, "n"), each, ", ".join(f"{c} long" for c in ("k", "n", *FEATURES)))
    return parts.where("n > 0").groupBy("k").agg(*(F.sum(c) for c in ("n", *FEATURES)))


def learned(docs: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics of all texts by k-means from the `topics` different descriptions with the smallest hashes; equal texts
    count once. Each centre is the mean of the texts nearest to it."""
    some = docs.select(F.col("text").cast("string").alias("t")).where("t is not null and t <> ''").select("t", F.xxhash64("t", F.lit(7)).alias("h"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.rint(described(counts([t.as_py().encode("utf-8", "replace") for t in b.column(0)])) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(f) for f in x.T)], ["h", *FEATURES])

    texts = mapped(some, each, ", ".join(f"{c} long" for c in ("h", *FEATURES))).distinct()
    points = staged(texts.groupBy(*FEATURES).agg(F.count("*").alias("n")), "described")
    wide = [F.sum(F.col(f).cast("decimal(19,0)") * F.col(f).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")) for f in FEATURES]
    n, *sums = points.agg(F.sum("n"), *(F.sum(F.col(f) * F.col("n")) for f in FEATURES), *wide).first()
    found = Topics([])
    if n:
        apart = np.array([max(0, n * int(q) - s * s) for s, q in zip(sums[:7], sums[7:])], float)
        found.spread = np.where(apart > 0, np.sqrt(apart) / n / UNIT, 1.0)
        first = points.select(*FEATURES).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(topics).collect()
        now, seen = np.array(first, float), set()
        # Centres that come again would go round forever: they stand, or rounding decides between equal distances.
        while now.tobytes() not in seen:
            if len(seen) == rounds:
                raise RuntimeError(f"topics did not settle in {rounds} rounds")
            seen.add(now.tobytes())
            now = now.copy()
            for k, size, *total in grouped(points, now, found.spread * UNIT).collect():
                now[k] = np.array(total, float) / size
        found.centres = now / UNIT / found.spread
    discard(points)
    return found


def looked_at(topics: Topics):
    """A function of a text column: struct(tokens, topic); topic is (none) where a text has no words."""

    def each(texts: pa.Array) -> pa.Array:
        found = counts([t.as_py().encode("utf-8", "replace") if t.is_valid else b"" for t in texts])
        of = topics.of(found) if len(topics.centres) else np.zeros(len(found), np.int64)
        names = [f"topic-{k}" if n else NONE for k, n in zip(of.tolist(), found[:, 7].tolist())]
        return pa.StructArray.from_arrays([pa.array(found[:, 7]), pa.array(names, pa.string())], ["tokens", "topic"])

    return F.arrow_udf(each, _SCHEMA)


def even(values: list[str]) -> dict[str, float]:
    return {v: 1 / len(values) for v in values}


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, close: float = 1e-12) -> np.ndarray:
    """Weights of cells in proportion to tokens whose sums over each marginal are its targets.

    places: for each marginal the number of its value that each cell has.
    """
    w = tokens / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(places, targets):
            now = np.bincount(at, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, np.abs(now - target).max())
            w = w * factor[at]
        if worst < close:
            break
    return w


def shares(wanted: dict[str, float] | None, seen: dict[str, float]) -> dict[str, float]:
    """Target shares of the values seen: even where nothing is wanted."""
    if wanted is None:
        return even(sorted(seen))
    named = {v: wanted[v] for v in seen if v in wanted}
    rest = {v: n for v, n in seen.items() if v not in wanted}
    open_ = max(0.0, 1 - sum(wanted.values())) if rest else 0.0
    if rest and not open_:
        open_ = sum(rest.values()) / sum(seen.values())
    scale = (1 - open_) / sum(named.values()) if named else 0.0
    if not named:
        open_ = 1.0
    return {v: x * scale for v, x in named.items()} | {v: open_ * n / sum(rest.values()) for v, n in rest.items()}


def calibrate(marked: DataFrame, targets: dict[str, dict[str, float] | None], cells: int = CELLS, temper: float = 1.0) -> dict[tuple[str, str, str], float]:
    """The probability of each cell; marked has source, lang, topic (no nulls) and tokens. temper below 1 softens ratios."""
    rows = marked.groupBy(*MARGINALS).agg(F.sum("tokens").alias("n")).where("n > 0").limit(cells + 1).collect()
    if len(rows) > cells:
        raise ValueError(f"more than {cells} combinations of source, language and topic")
    if not rows:
        return {}
    rows.sort()
    n = np.array([r["n"] for r in rows], float)
    places, goals = [], []
    for k, name in enumerate(MARGINALS):
        values = sorted({r[k] for r in rows})
        number = {v: i for i, v in enumerate(values)}
        at = np.array([number[r[k]] for r in rows])
        goal = shares(targets.get(name), dict(zip(values, np.bincount(at, n, len(values)).tolist())))
        places.append(at)
        goals.append(np.array([goal[v] for v in values]))
    ratio = (rake(n, places, goals) / n) ** temper
    return {tuple(r[:3]): float(p) for r, p in zip(rows, ratio / ratio.max())}


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, topic: Column | None = None, seed: int = 3, temper: float = 1.0) -> DataFrame:
    """docs with tokens, topic_used, probability and kept.

    targets: shares by value for source, lang and topic; None, or a missing name, asks for even shares.
    """
    text = F.col("text").cast("string")
    small_batches(docs.sparkSession)
    seen = looked_at(learned(docs) if topic is None else Topics([]))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in MARGINALS[:2]]
    own = F.coalesce(topic.cast("string"), F.lit(NONE)) if topic is not None else F.col("seen.topic")
    rows = docs.select(F.struct(*docs.columns).alias("row"), seen(text).alias("seen"), *named, *([own.alias("topic")] if topic is not None else []))
    rows = rows.withColumn("topic", own) if topic is None else rows
    chance = calibrate(rows.select(*MARGINALS, F.col("seen.tokens").alias("tokens")), targets or {}, temper=temper)
    table = docs.sparkSession.createDataFrame([(*k, p) for k, p in chance.items()], "source string, lang string, topic string, p double")
    drawn = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-1)), F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(seed)), 11) / F.lit(float(1 << 53))
    # The table's size is bounded by CELLS rows of three names.
    joined = rows.withColumn("drawn", drawn).join(F.broadcast(table), list(MARGINALS), "left")
    p = F.when(F.col("seen.tokens") == 0, 1.0).otherwise(F.col("p"))
    return joined.select("row.*", F.col("seen.tokens").alias("tokens_used"), F.col("topic").alias("topic_used"), p.alias("probability"), (F.col("drawn") < p).alias("kept"))
