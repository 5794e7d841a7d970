"""The pipeline's stages on a small corpus, each against what is planted in it."""

import random

import numpy as np

import corpus_pipeline
from quire.llm import mixing, simhash

SYLLABLES = {"en": "the ing ti on er and".split(), "de": "sch tz ung ber ein ich".split()}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def said(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 5))) for _ in range(words))


def corpus():
    rng = random.Random(7)
    texts = {i: (lang := "en" if i % 3 else "de", "\n".join(said(rng, lang, 15) for _ in range(5))) for i in range(120)}
    texts[200] = ("en", texts[1][1])  # a copy
    w = texts[2][1].split(" ")
    w[10] = "other"
    texts[201] = ("en", " ".join(w))  # a near copy, but for one line the same
    texts[202] = ("en", "\n".join([said(rng, "en", 12), *texts[4][1].split("\n")[1:4], said(rng, "en", 12)]))  # a long passage
    texts[203] = (None, "12 34 55 !!")  # no language
    texts[204] = (None, said(rng, "de", 80))
    return [(i, t, lang, f"s{i % 4}", len(t)) for i, (lang, t) in texts.items()] + [(205, None, "en", None, None)]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == COLUMNS
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    first = kept["language_id"]
    assert set(first) == {*range(120), 200, 201, 202, 204} and first[204]["lang"] == "de"
    second = kept["line_dedup"]
    assert set(second) == set(first) - {200}
    assert all(second[i]["text"] == first[i]["text"] for i in range(120))
    lines = second[202]["text"].split("\n")
    assert len(lines) == 2 and second[202]["n_chars"] == len(second[202]["text"])
    third = kept["near_dedup"]
    fps = {i: simhash.fingerprint(r["text"]) for i, r in second.items()}
    for i in set(second) - set(third):
        assert any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in second)
    assert not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for i in third for j in third)
    assert set(kept["mixing"]) <= set(third) and kept["mixing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept["mixing"])


def test_run(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_near_dedup_takes_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    words = said(rng, "en", 200).split(" ")
    near = [*words[:40], "other", *words[41:120], "words", *words[121:]]  # 186 of 206 shingles are common
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(near[:100] + words[:60]), "en", "s", 1)]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == {1, 3}


def test_run_on_nothing_and_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens long, root string"
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    rng = random.Random(16)
    long = "\n".join(said(rng, "en", 40) for _ in range(400))
    rows = [(i, t, lang, source, n, 1, "x") for i, t, lang, source, n in corpus()] + [(None, said(rng, "en", 50), None, None, None, None, None), (None, None, None, None, None, 1, "x"), (7, "", "en", "s", 0, 1, "x"), (300, long, "en", "s1", len(long), 1, "x"), (300, long, "en", "s1", len(long), 1, "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/odd")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0


def test_mixing_learns_from_every_document(spark):
    """What stays of 5,000 documents, made again with groups of all their texts; once groups were of 4,096 of them."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdeABC012 .,|#\n", [9, 9, 9, 9, 9, *(rng.choice([0, 1, 4]) for _ in range(12))], k=rng.randint(2, 12)))
    docs = [(i, "x" + " ".join(word() for _ in range(rng.randint(1, 60))), rng.choice(["en", "de"]), f"s{rng.randrange(3)}", 0) for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.mix_sources(spark, df, "").collect()}
    texts = sorted({d[1] for d in docs})
    x = np.rint(mixing.described(mixing.counts([t.encode() for t in texts])) * mixing.UNIT)
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), mixing.UNIT)
    points = spark.createDataFrame([tuple(map(int, r)) for r in np.unique(x, axis=0)], ", ".join(f"{f} long" for f in mixing.FEATURES))
    centres = np.array([r[:-1] for r in sorted(points.selectExpr("*", "xxhash64(*) as h").collect(), key=lambda r: r["h"])[: mixing.TOPICS]], float)
    for _ in range(mixing.ROUNDS):
        own = (((x[:, None] - centres) / spread) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
    own = dict(zip(texts, (((x[:, None] - centres) / spread) ** 2).sum(axis=2).argmin(axis=1).tolist()))
    cells = [(d[3], d[2], f"topic-{own[d[1]]}") for d in docs]
    names, at = np.unique(cells, axis=0, return_inverse=True)
    n = np.bincount(at, [len(d[1].split()) for d in docs])
    places, goals = [], []
    for k, name in enumerate(mixing.MARGINALS):
        values, place = np.unique(names[:, k], return_inverse=True)
        goal = mixing.shares(corpus_pipeline.MIXTURE[name], dict(zip(values.tolist(), np.bincount(place, n).tolist())))
        places.append(place)
        goals.append(np.array([goal[v] for v in values.tolist()]))
    ratio = mixing.rake(n, places, goals) / n
    draws = {r["doc_id"]: r["d"] for r in df.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id, text, 3), 11) / double(9007199254740992) as d").collect()}
    assert got == {d[0] for d, k in zip(docs, at) if draws[d[0]] < ratio[k] / ratio.max()}


def test_mixing_topics_settle(spark, monkeypatch):
    """Each centre is the mean of the texts nearest to it; once rounds stopped at 12, near the six texts they begin with."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdeABC012 .,|#\n", [9, 9, 9, 9, 9, *(rng.choice([0, 1, 4]) for _ in range(12))], k=rng.randint(2, 12)))
    docs = [(i, "x" + " ".join(word() for _ in range(rng.randint(1, 60))), "en", f"s{i % 3}", 0) for i in range(1500)]
    found, learned = [], mixing.learned
    monkeypatch.setattr(mixing, "learned", lambda docs: found.append(learned(docs)) or found[0])
    corpus_pipeline.mix_sources(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    counts = mixing.counts([t.encode() for t in sorted({d[1] for d in docs})])
    x, own = mixing.described(counts) / found[0].spread, found[0].of(counts)
    assert np.allclose(found[0].centres, [x[own == k].mean(axis=0) for k in range(mixing.TOPICS)], atol=1e-5)
