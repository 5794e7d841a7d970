"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: each byte position of a window gets a
distribution over the languages, read from a forward and a backward GRU, and the loss is the mean cross-entropy of all
positions. Prediction runs over every byte of every text, in windows that follow one another without gaps, and pools the
mean of the position distributions: `score` is that of the best language.

Learning uses the text and lang of a bounded sample of the labelled rows (`per_lang` documents of each language, those
with the smallest hashes of their id and text, and `snippets` windows of each); rows that are held out (crc32 of the id as text,
mod 4, is 2) are never learned from. lang, source and doc_id are no inputs of a prediction.

Defined results: null texts and texts without a letter (the empty one too) are `und` with score 0, as is everything
where no labelled row exists; rows whose lang is null are predicted but not learned from; a null doc_id counts as an
empty id; repeated rows are predicted alike; ties go to the language that sorts first; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

HIDDEN, SPAN = 6, 64
#: Windows that go through the network together, and bytes of text that are gathered before that.
TOGETHER, GATHERED = 2048, 4 << 20


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _softsign(x: np.ndarray) -> None:
    """x / (1 + |x|) in place: as a squashing function a sixth of the cost of tanh in numpy."""
    below = np.abs(x)
    below += 1
    x /= below


def _slope(gate: np.ndarray) -> np.ndarray:
    """The derivative of a gate with respect to what is squashed, from its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class Network:
    """Gates are (1 + softsign) / 2, new states softsign.

    Weights; axis 0 of each is the direction. Gates are in the order reset, update, new."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, span: int = SPAN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden, self.span = langs, hidden, span
        self.w = {
            "x": rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32),  # a byte's share of the gates, bias included
            "u": rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32),
            "o": rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32),
            "b": np.zeros((len(langs), 1), np.float32),
        }

    def _steps(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(span, 2 * hidden, n) states at each position. data: (span, n) bytes. keep: gets what the way back needs."""
        h, span, n = self.hidden, *data.shape
        x, u = self.w["x"], self.w["u"]
        both = np.empty((span, 2 * h, n), np.float32)
        state = np.zeros((2, h, n), np.float32)
        a, m = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        for t in range(span):
            np.take(x[0], data[t], axis=1, out=a[0], mode="clip")
            np.take(x[1], data[span - 1 - t], axis=1, out=a[1], mode="clip")
            np.matmul(u, state, out=m)
            gates = a[:, : 2 * h]
            gates += m[:, : 2 * h]
            _softsign(gates)
            gates += 1
            gates *= 0.5
            new = m[:, 2 * h :] * a[:, :h]
            new += a[:, 2 * h :]
            _softsign(new)
            if keep is not None:
                keep.append((state, gates.copy(), m[:, 2 * h :].copy(), new.copy()))
            state = state - new
            state *= a[:, h : 2 * h]
            state += new
            both[t, :h] = state[0]
            both[span - 1 - t, h:] = state[1]
        return both

    def _distributions(self, both: np.ndarray) -> np.ndarray:
        """(span, languages, n): what each position says."""
        p = np.matmul(self.w["o"], both)
        p += self.w["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def label(self, data: np.ndarray) -> np.ndarray:
        return self._distributions(self._steps(data))

    def gradients(self, data: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients. truth: (n,) language numbers."""
        h, span, n = self.hidden, *data.shape
        keep: list = []
        both = self._steps(data, keep)
        p = self._distributions(both)
        at = np.arange(n)
        loss = float(-np.log(p[:, truth, at] + 1e-12).mean())
        p[:, truth, at] -= 1
        p /= span * n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"] = np.einsum("tln,thn->lh", p, both, optimize=True)
        g["b"] = p.sum(axis=(0, 2))[:, None]
        down = np.matmul(self.w["o"].T, p)
        d = np.zeros((2, h, n), np.float32)
        back = self.w["u"].transpose(0, 2, 1)
        for t in range(span - 1, -1, -1):
            state, gates, inner, new = keep[t]
            r, z = gates[:, :h], gates[:, h:]
            d[0] += down[t, :h]
            d[1] += down[span - 1 - t, h:]
            dn = d * (1 - z) * (1 - np.abs(new)) ** 2
            da = np.concatenate([dn * inner * _slope(r), d * (state - new) * _slope(z), dn], axis=1)
            dm = da.copy()
            dm[:, 2 * h :] *= r
            for k, row in enumerate((data[t], data[span - 1 - t])):
                hot = np.zeros((n, 256), np.float32)
                hot[at, row] = 1
                g["x"][k] += da[k] @ hot
            g["u"] += np.matmul(dm, state.transpose(0, 2, 1))
            d = d * z + np.matmul(back, dm)
        return loss, g

    def train(self, data: np.ndarray, truth: np.ndarray, steps: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam. data: (windows, span)."""
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(data), batch)
            loss, g = self.gradients(np.ascontiguousarray(data[pick].T), truth[pick])
            losses.append(loss)
            now = rate * (1 - 0.9 * i / steps)
            for k, w in self.w.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                w -= now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
        return losses

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean of all positions' distributions; texts must not be empty."""
        span = self.span
        length = np.array([len(t) for t in texts], np.int64)
        windows = -(-length // span)
        end = np.cumsum(windows)
        data = np.zeros(int(end[-1]) * span, np.uint8)
        for t, to in zip(texts, ((end - windows) * span).tolist()):
            data[to : to + len(t)] = np.frombuffer(t, np.uint8)
        data = data.reshape(-1, span)
        inside = np.full(len(data), span, np.int64)
        inside[end - 1] = length - (windows - 1) * span
        sums = np.empty((len(data), len(self.langs)))
        for i in range(0, len(data), TOGETHER):
            p = self.label(np.ascontiguousarray(data[i : i + TOGETHER].T))
            part = inside[i : i + TOGETHER]
            if (short := np.flatnonzero(part < span)).size:
                p[:, :, short] *= (np.arange(span)[:, None] < part[short])[:, None, :]
            sums[i : i + TOGETHER] = p.sum(axis=0, dtype=np.float64).T
        return np.add.reduceat(sums, end - windows, axis=0) / length[:, None]


def snippets_of(text: str, number: int, span: int = SPAN) -> list[bytes]:
    """Windows spread evenly over the whole text; a text shorter than one gives itself, padded."""
    raw = text.encode("utf-8", "replace")
    if not any(c.isalpha() for c in text):
        return []
    starts = sorted({(len(raw) - span) * i // max(1, number - 1) for i in range(number)}) if len(raw) > span else [0]
    return [raw[s : s + span].ljust(span, b"\0") for s in starts]


def fit(docs: DataFrame, per_lang: int = 160, snippets: int = 10, **how) -> Network:
    """A network trained on the labelled rows that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    place = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit(5)).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([])
    langs = sorted(counts)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_lang / counts[k])))])
    taken = known.withColumn("place", place).where(F.col("place") <= F.element_at(share, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([snippets_of(t.as_py(), snippets) for t in b.column(3)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], parts], ["lang", "place", "doc_id", "parts"])

    found = mapped(taken.select("lang", "place", "doc_id", "text"), cut, "lang string, place double, doc_id long, parts array<binary>")
    rows = sorted(found.collect(), key=lambda r: (r["lang"], r["place"], zlib.crc32(b"".join(r["parts"]))))
    parts, truth = [], []
    for i, lang in enumerate(langs):
        mine = [p for r in [r for r in rows if r["lang"] == lang][:per_lang] for p in r["parts"]]
        parts += [bytes(p) for p in mine]
        truth += [i] * len(mine)
    network = Network(langs)
    if len(langs) > 1 and parts:
        truth = np.array(truth)
        even = np.concatenate([np.resize(np.flatnonzero(truth == i), max(np.bincount(truth))) for i in range(len(langs)) if (truth == i).any()])
        network.train(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SPAN)[even], truth[even], **how)
    return network


def predict(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            texts: list[bytes] = []
            where: list[int] = []

            def settle() -> None:
                if texts:
                    p = network.pool(texts)
                    best = p.argmax(axis=1)
                    for i, k, s in zip(where, best.tolist(), p[np.arange(len(p)), best].tolist()):
                        pred[i], score[i] = network.langs[k], min(1.0, max(0.0, s))
                    texts.clear()
                    where.clear()

            gathered = 0
            for i, text in enumerate(b.column(where_text)):
                text = text.as_py()
                if network.langs and text and any(map(str.isalpha, text)):
                    texts.append(raw := text.encode("utf-8", "replace"))
                    where.append(i)
                    gathered += len(raw)
                    if gathered >= GATHERED:
                        settle()
                        gathered = 0
            settle()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred), pa.array(score)], [*keep, "lang_pred", "score"])

    own = "text" in keep and dict(docs.dtypes)["text"] == "string"
    where_text = keep.index("text") if own else len(keep)
    columns = docs.select(*keep) if own else docs.select(*keep, F.col("text").cast("string").alias("text read"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[: len(keep)])
    return mapped(columns, each, f"{schema}, lang_pred string, score double")
