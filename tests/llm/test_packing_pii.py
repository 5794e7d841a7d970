"""Packing against the tokenizers library, personal data against plain regular expressions."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing, pii

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world, it's  two  spaces", "tab\tand\nlines\n \n x", " leading", "trailing ", "日本語 é \U0001f600", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n <|endoftext|> <|endoftext |>", "x" * 5000, "word " * 3000, "a b", "a b  c", "don't I'LL 12 3,4"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    e = packing.Encoder(PATH)
    for _ in range(2):  # the second time from memory
        for t in TEXTS:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == whole(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t ab'1.é<|", max_size=30))
def test_encoder_on_odd_white_space(text):
    assert np.frombuffer(packing.encoder(PATH).encode(text), "<u4").tolist() == whole(text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_uses_every_piece_once(histogram):
    windows = packing.plan(histogram, 64)
    used = Counter()
    for lengths, n in windows:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)


def test_least_squares_against_a_plain_solution():
    rows = packing.combinations(16)
    target = np.zeros(17)
    truth = np.random.default_rng(0).integers(0, 50, len(rows)).astype(float)
    for r, x in zip(rows, truth):
        for n in r[r > 0]:
            target[n] += x
    x = packing.nonnegative(rows, target, 3000)
    made = np.bincount(rows.ravel(), (x[:, None] * (rows > 0)).ravel(), 17)
    assert (x >= 0).all() and np.abs(made - target)[1:].max() < 1e-2 * target.max()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, length long, task string")  # two clashing names


def test_pack(spark):
    texts = [*TEXTS, None, "same", "same"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x")]
    got = packing.pack(docs(spark, rows).repartition(3), PATH).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = [*whole(t), 0]
        parts = sorted(by[i], key=lambda r: r["start"])
        assert [x for r in parts for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in parts)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) == -(-sum(r["length"] for r in got) // 1024)  # no more than needed here


def test_pack_of_nothing(spark):
    assert packing.pack(docs(spark, []), PATH, keep_ids=False).count() == 0


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((*m.span(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0142()%_é,", max_size=60))
def test_base_equals_the_patterns(text):
    assert sorted(pii.base(text), key=lambda x: (x[0], x[2])) == plain(text)


def test_chosen_spans_do_not_overlap():
    rng = np.random.default_rng(6)
    for _ in range(100):
        found = [{"start": int(s), "end": int(s + n), "kind": 0, "votes": int(v), "shape": 0, "base": bool(b)} for s, n, v, b in zip(rng.integers(0, 60, 12), rng.integers(1, 9, 12), range(12), rng.random(12) < 0.3)]
        chance = {(0, v, 0): float(p) for v, p in enumerate(rng.random(12))}
        taken = [(c["start"], c["end"]) for c in found if c["base"]]
        expected = [*taken]
        for c in sorted((c for c in found if not c["base"] and chance[0, c["votes"], 0] >= 0.3), key=lambda c: (-chance[0, c["votes"], 0], c["start"], -c["end"])):
            if all(e <= c["start"] or s >= c["end"] for s, e in expected):
                expected.append((c["start"], c["end"]))
        assert sorted(x[:2] for x in pii.choose(found, chance, 0.3)) == sorted(expected)
    many = [{"start": i * 3, "end": i * 3 + 2, "kind": 1, "votes": 0, "shape": 0, "base": False} for i in range(20000)]
    assert len(pii.choose(many, {(1, 0, 0): 0.9}, 0.5)) == 20000


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_label_model_finds_reliable_labelers():
    rng = np.random.default_rng(1)
    real = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.6, 0.85])
    votes = np.where(rng.random((4000, 4)) < right, real[:, None], ~real[:, None]) * 2
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, theta = pii.label_model(patterns, n.astype(float))
    guess = {tuple(v): x >= 0.5 for v, x in zip(patterns, p)}
    assert np.mean([guess[tuple(v)] == r for v, r in zip(votes, real)]) > 0.94
    assert theta[0, 1, 2] > theta[2, 1, 2]


def test_detect(spark):
    texts = {
        1: "mail a.b@c.example.com or +1 (555) 555-0101, host 10.0.0.7",
        2: "card 4111 1111 1111 1111 here",
        3: "4111111111111111 27.65.93.188 run together",
        4: "call +1 (578) 555-6437 4918120000 now",
        5: "order 4111111111111112 is none, version 1.2.3.400 neither",
        6: None,
        7: "",
        8: "é é a@b.c " * 4000,
        9: "write to jane.doe [at] host [dot] example.com today",
    }
    rows = [(i, t, 0, "x") for i, t in texts.items()] + [(2, texts[2], 0, "x"), (None, texts[1], 0, "x")]
    got = pii.detect(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in texts.items():
        base = [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in by[i]["base"]]
        assert base == plain(t)
        assert {tuple(s) for s in by[i]["base"]} <= {tuple(s) for s in by[i]["spans"]}
    found = {i: {(s["kind"], texts[i][s["start"] : s["end"]]) for s in by[i]["spans"]} for i in texts if texts[i]}
    assert ("card", "4111111111111111") in found[3] and ("phone", "+1 (578) 555-6437") in found[4]
    assert not found[5]
    assert [x["base"] for x in got if x["doc_id"] is None] == [by[1]["base"]]
    assert pii.detect(docs(spark, [])).count() == 0
    assert pii.mask("mail a@b.c!", [(5, 10, "email")]) == "mail <EMAIL>!"
    assert pii.digest([(5, 10, "email")]) == hashlib.sha256(b"email:5:10").hexdigest()
