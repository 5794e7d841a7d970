"""SimHash, line dedup and embedding links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, embedding_dedup, linededup, similar, simhash, vectors


def plain_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """The smallest index that each of n reaches."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if label[j] < label[i] and linked(i, j):
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two Words", "a b c d", "a b c d e É", "x\x0by z\x1cw", "w " * 20000 + "end"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for d in range(1, 7):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == expected and expected
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 6)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(40)]
    for t in texts[:10]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    return [*texts, texts[0], texts[0], None, "", "short text", "short text"]


def test_near_duplicates(spark):
    texts = corpus()
    rows = [(i, t, "fp", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    expected = classes(len(texts), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    kept = simhash.representatives(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected)) and kept.columns == df.columns


def test_near_duplicates_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "only null here")], schema)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_representatives_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    long, other, third = (line(rng, 60) for _ in range(3))
    rows = [(3, "a b"), (None, "a b"), (None, long), (None, other), (None, other), (5, third), (5, "a b"), (7, third), (5, third), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.representatives(df).collect()), key=str)
    assert got == sorted([(3, "a b"), (None, long), (None, other), (5, third), (2, None)], key=str)


def plain_shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(12)
    texts = [line(rng, rng.choice([3, 8, 60, 200, 900])) for _ in range(40)]
    for t in texts[:30]:
        for changes in (1, 2, 4, 8):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    base = line(rng, 100).split()
    texts += [" ".join([*base, f"n{i}"]) for i in range(40)] + [" ".join([*base, *line(rng, 5 * i).split()]) for i in range(1, 9)]
    texts += [None, "", " ", texts[0], texts[3].upper()]
    sets = [plain_shingles(t) for t in texts]
    expected = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert any(bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 4 for i, j in enumerate(expected))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = similar.representatives(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected)) and kept.columns == df.columns
    assert similar.representatives(df.limit(0)).count() == 0


def test_texts_round_a_common_passage_are_not_paired(spark, monkeypatch):
    """Many texts share most of their words, few are near-duplicates; those are found, and few pairs are compared."""
    rng = random.Random(14)
    common = line(rng, 120)
    texts = [f"{common} {line(rng, rng.choice([30, 40, 50]))}" for _ in range(150)]
    for i in range(0, 60, 3):
        w = texts[i].split()
        w[125] = "other"
        texts.append(" ".join(w))
    compared = []
    real = similar._verified

    def counted(pairs, whole, least):
        compared.append(pairs.distinct().count())
        return real(pairs, whole, least)

    monkeypatch.setattr(similar, "_verified", counted)
    sets = [plain_shingles(t) for t in texts]
    expected = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = similar.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected)) and len(set(expected)) < len(texts)
    assert compared[1] < len(texts)


def test_rare_shingles_miss_no_pair(spark):
    rng = random.Random(15)
    sets = [{rng.randrange(40) for _ in range(rng.randint(1, 30))} for _ in range(80)]
    sets += [set(list(x)[1:]) or {1} for x in sets]
    rows = spark.createDataFrame([(i, len(x), i) for i, x in enumerate(sets)], "id long, n long, root long")
    whole = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, shingles array<long>")
    found = similar._by_rare_shingles(rows, whole, 0.8)
    got = {frozenset((r["u"], r["v"])) for r in similar._verified(found, whole, 0.8).collect()}
    assert got == {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def naive_lcs_blocks(a, b, words, least):
    """Deleted lines where all pairs are aligned and lines are unique: maximal runs equal on both sides."""
    out = set()
    at = {x: j for j, x in enumerate(b)}
    i = 0
    while i < len(a):
        j, n = at.get(a[i]), 0
        while j is not None and i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n and sum(words[i : i + n]) >= least:
            out |= set(range(i, i + n))
        i += max(n, 1)
    return out


def test_patience():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert linededup.patience(list("abcdef"), list("abxdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    long = [str(i) for i in range(5000)]
    assert len(linededup.patience(long, long[:2500] + ["x"] + long[2500:])) == 5000


def line(rng, n):
    return " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))


def test_line_dedup(spark):
    rng = random.Random(9)
    passage = [line(rng, 30), line(rng, 30)]
    hot = "a very common line of nine words stands here"
    copy = [line(rng, 12) for _ in range(6)]
    docs = {
        1: [hot, *copy],
        2: [line(rng, 20), *passage, line(rng, 20)],
        3: [hot, line(rng, 20), line(rng, 8)],
        4: copy[:3] + [line(rng, 12)] + copy[3:],
        5: [hot, *copy],
        6: [line(rng, 9), *passage],
        7: [hot],
        8: [line(rng, 10), passage[0] + " ", "", passage[1], line(rng, 5)],
    } | {i: [hot, line(rng, 15)] for i in range(20, 100)}
    rows = [(i, "\n".join(ls), "x", 1) for i, ls in docs.items()] + [(5, "\n".join(docs[5]), "x", 1), (None, "\n".join(copy), "x", 1), (9, None, "x", 1), (10, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n_lines int")
    got = linededup.dedup(df, ("doc_id", "k1")).collect()
    assert len(got) == len(rows)
    left = {r["doc_id"]: r["text"] for r in got}
    order, seen = sorted(docs), {}
    for i in order:
        lines = [x.strip() for x in docs[i]]
        gone = set()
        for j in order:
            if j < i:
                gone |= naive_lcs_blocks(lines, [x.strip() for x in docs[j]], [len(x.split()) for x in lines], linededup.MIN_WORDS)
        seen[i] = "\n".join(x for n, x in enumerate(docs[i]) if n not in gone)
    assert {i: left[i] for i in docs} == seen
    assert left[1] == "\n".join(docs[1]) and left[5] == "" and left[6] == docs[6][0] and left[7] == hot
    assert left[None] == "" and left[9] is None and left[10] == ""
    assert {(r["n_lines"], r["n_deleted"]) for r in got if r["doc_id"] == 5} == {(7, 7)}
    assert linededup.dedup(df.limit(0)).count() == 0


def test_hot_passages_are_found(spark):
    """A passage in however many documents is no gap: its first document stands for all before."""
    rng = random.Random(4)
    passage = "\n".join(line(rng, 20) for _ in range(3))
    rows = [(i, f"{line(rng, 10)}\n{passage}\n{line(rng, 10)}") for i in range(150)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_deleted"] for r in got) == [0] + [3] * 149


@pytest.mark.parametrize("copies", [60, 100])
def test_hot_passages_with_blank_lines(spark, copies):
    """Short paragraphs between blank lines are one passage, in however many documents they stand."""
    rng = random.Random(6)
    passage = "\n\n".join(line(rng, 20) for _ in range(3))
    rows = [(i, f"{line(rng, 10)}\n{passage}\n{line(rng, 10)}") for i in range(copies)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_deleted"] for r in got) == [0] + [5] * (copies - 1)


def test_hot_lines_of_several_first_documents(spark):
    """Hot lines that first stood apart are a passage where they stand together."""
    rng = random.Random(7)
    lines = [line(rng, 12) for _ in range(4)]
    texts = [*lines, *("\n".join([line(rng, 10), *lines]) for _ in range(80))]
    got = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_deleted"] for r in got} == {i: 4 if i > 4 else 0 for i in range(len(texts))}


def test_rare_lines_of_several_first_documents(spark):
    """Two documents share a passage whose lines stood in different documents before."""
    rng = random.Random(13)
    a, b = line(rng, 20), line(rng, 20)
    texts = [[a, "x"], [b, "y"], ["h3", a, b, "t3"], ["h4", a, b, "t4"]]
    got = linededup.dedup(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: f"{a}\nx", 2: f"{b}\ny", 3: f"h3\n{a}\n{b}\nt3", 4: "h4\nt4"}


def test_windows_cover_shared_runs():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.choice([0, 1, 5, 12, 24, 25, 40]) for _ in range(rng.randint(1, 9))]
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                held = {x for i, j in linededup.windows(words, 25) if s <= i and j <= e for x in range(i, j)}
                assert held == (set(range(s, e)) if sum(words[s:e]) >= 25 else set())


def test_repeated_and_moved_passages_go():
    rng = random.Random(10)
    assert linededup.common_blocks(list("xPyPz"), list("qPr"), [5, 60, 5, 60, 5], 25) == [(1, 1), (3, 3)]
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 10))] for _ in range(2))
        count = dict(zip("abcdef", (0, 5, 10, 13, 20, 30)))
        words = [count[x] for x in a]
        runs = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if sum(words[i:j]) >= 25 and any(b[k : k + j - i] == a[i:j] for k in range(len(b)))]
        got = {x for i, z in linededup.common_blocks(a, b, words, 25) for x in range(i, z + 1)}
        assert got == {x for i, j in runs for x in range(i, j)}


def vector_rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[:20] + rng.normal(scale=s, size=(20, 16)) for s in (0.05, 0.15, 0.3)])
    x = np.concatenate([base, near, base[:5], base[:5] * 3])
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [1.0, None] + [0.0] * 14), (503, [float("nan")] + [1.0] * 15), (504, [float("inf")] + [1.0] * 15), (505, [])]


@pytest.mark.parametrize("parts,cells", [(1, 5), (4, 20), (8, 40)])
def test_embedding_links(spark, parts, cells, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)  # so that groups are cut into chunks
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, home string, class int")
    got = {r["vec_id"]: r for r in embedding_dedup.link(df, 0.9, parts, cells).collect()}
    x = np.array([v for i, v in rows if i < 500])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    expected = classes(len(x), lambda i, j: linked[i, j])
    assert [got[i]["component_id"] for i in range(len(x))] == expected
    assert [got[i]["n_links"] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(500, 506))
    assert len(got) == len(rows)
    assert embedding_dedup.link(df.limit(0)).count() == 0
    assert embedding_dedup.link(df.where(F.col("vec_id") == 500)).collect()[0]["component_id"] == 500


def test_equal_ids_stay_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_dedup.link(df).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_unlike_vectors_of_one_id_and_huge_ones(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0]), (None, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embedding_dedup.link(df).collect()), key=str)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (None, 0, None)], key=str)
    huge = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [-1e300, 1e300]), (5, [1e-310, -1e-310])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.link(huge).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_centres_of_few_rows():
    assert len(vectors.centres(np.array([[1.0, 2.0], [1.0, 2.0]]), 5)) == 1
