"""Language identification, neighbours, mixing, licence scans and page texts."""

import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, langid, licenses, mixing, wrapper

SYLLABLES = {"aa": "ka lo mi pu ra to".split(), "bb": "sch tz ung ber ein ich".split(), "cc": "eau oux ille que tion ent".split()}


def said(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def labelled(n=240):
    rng = random.Random(1)
    return [(i, said(rng, k, rng.randint(8, 60)), k, "x") for i in range(n) for k in [list(SYLLABLES)[i % 3]]]


def test_gradients():
    net = langid.Network(["a", "b", "c"], hidden=3, span=6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, truth = rng.integers(0, 256, (6, 5), dtype=np.uint8), rng.integers(0, 3, 5)
    _, g = net.gradients(data, truth)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = net.gradients(data, truth)[0]
        w[at] = old - 1e-2
        down = net.gradients(data, truth)[0]
        w[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=1e-6)


def test_pooling_reads_every_byte():
    net = langid.Network(["a", "b"], hidden=4, span=8)
    texts = [b"x", b"some text of more than one window", b"y" * 64]
    for text, got in zip(texts, net.pool(texts)):
        rows = []
        for i in range(0, len(text), 8):
            part = np.frombuffer(text[i : i + 8].ljust(8, b"\0"), np.uint8)[:, None]
            rows.append(net.label(part)[: len(text[i : i + 8]), :, 0])
        assert np.allclose(got, np.concatenate(rows).mean(axis=0), atol=1e-5)


def test_language(spark):
    rows = labelled() + [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 34 !", "bb", "x"), (1003, said(random.Random(3), "bb", 4000), None, "x"), (None, said(random.Random(4), "cc", 30), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = langid.fit(df, steps=160)
    got = langid.predict(df, net, ("doc_id", "lang")).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["out"] and r["lang"] and r["doc_id"] < 1000]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003]["lang_pred"] == "bb" and by[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    # Labels of rows that are held out, and columns other than the text, change nothing.
    other = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("score", F.lit("y"))
    assert langid.fit(other, steps=160).langs == net.langs


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, langid.fit(df)).collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0), langid.fit(df.limit(0))).count() == 0


def neighbours(rows, k):
    x = {i: np.array(v) for i, v in rows}
    return {q: [i for _, i in sorted((-float((x[i] * x[q]).sum()), i) for i in x if i != q)[:k]] for q in x if q % 5 == 0}


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=24)
    x = np.concatenate([rng.normal(size=(500, 24)), hot + rng.normal(scale=0.01, size=(200, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1005, [0.0] * 24), (1010, [float("nan")] * 24), (1015, [None] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *odd]], "vec_id long, embedding array<double>, list int")
    got = defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 5 == 0, 20, lists=8, probes=6, exact=32).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r)
    truth = neighbours(rows, 20)
    assert set(got) == set(truth) and all([r["rank"] for r in g] == list(range(1, 21)) for g in got.values())
    assert np.mean([len(set(truth[q]) & {r["vec_id"] for r in got[q]}) / 20 for q in truth]) >= 0.9
    for q, g in got.items():
        assert all(r["score"] == pytest.approx(float((x[q] * x[r["vec_id"]]).sum()), abs=1e-12) for r in g)
        assert [(-r["score"], r["vec_id"]) for r in g] == sorted((-r["score"], r["vec_id"]) for r in g)
    assert ann.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.1])], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]


def test_recall_as_shipped(spark):
    """No clusters at all, and a third of all rows one vector: at least nine tenths of the true neighbours."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    # Many rows tie with the first vector's copies, so scores are compared.
    hit = [sum(x[q] @ x[i] >= np.sort(np.delete(x @ x[q], q))[-20] - 1e-12 for i in got[q]) / 20 for q in range(0, 3000, 20)]
    assert len(got) == 150 and np.mean(hit) >= 0.9


def test_neighbours_of_very_different_sizes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8)).astype(np.float32).astype(np.float64)
    x[2], x[30] = x[2] * 1e25, x[30] * 1e25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 5 == 1, 5).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        assert found == [i for i in sorted(range(40), key=lambda i: (-scores[i], i)) if i != q][:5]


def test_raking_against_marginals():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 100, 60).astype(float)
    places = [np.arange(60) % k for k in (5, 4, 3)]
    targets = [t / t.sum() for t in (rng.random(k) + 0.2 for k in (5, 4, 3))]
    w = mixing.rake(n, places, targets)
    for at, target in zip(places, targets):
        assert np.allclose(np.bincount(at, w), target, atol=1e-9)


def mixed(n=4000):
    rng = random.Random(6)
    return [(i, "word " * rng.randint(1, 30), f"s{min(rng.randrange(9), 4)}", rng.choice(["en", "fr", None]), "t") for i in range(n)]


def test_mixing(spark):
    rows = [*mixed(), (9000, None, None, None, None), (9001, " ", "s1", "en", "t"), (None, "a b", "s1", "en", "t"), (5, "twice here", "s2", "en", "t"), (5, "twice here", "s2", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    targets = {"source": None, "lang": {"en": 0.5, "fr": 0.3, "(none)": 0.2}, "topic": {}}
    out = mixing.mix(df, targets)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    assert len(got) == len(rows)
    total = sum(r["tokens_used"] * r["probability"] for r in got if r["tokens_used"])
    for name, shares in (("source", {f"s{i}": 0.2 for i in range(5)}), ("lang", {"en": 0.5, "fr": 0.3, None: 0.2})):
        for v, share in shares.items():
            assert sum(r["tokens_used"] * r["probability"] for r in got if r["tokens_used"] and r[name] == v) / total == pytest.approx(share, abs=1e-9)
    kept = [r for r in got if r["kept"] and r["tokens_used"]]
    assert sum(r["tokens_used"] for r in kept if r["lang"] == "en") / sum(r["tokens_used"] for r in kept) == pytest.approx(0.5, abs=0.05)
    assert all(r["kept"] for r in got if r["doc_id"] in (9000, 9001))
    assert len({r["kept"] for r in got if r["text"] == "twice here"}) == 1
    assert {(r["doc_id"], r["kept"]) for r in mixing.mix(df.repartition(7), targets).collect()} == {(r["doc_id"], r["kept"]) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_shares():
    seen = {"a": 50.0, "b": 30.0, "c": 20.0}
    assert mixing.shares(None, seen) == {k: 1 / 3 for k in "abc"}
    assert mixing.shares({"a": 0.5, "z": 0.5}, {"a": 1.0}) == {"a": 1.0}
    assert mixing.shares({"a": 0.5}, seen) == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2})
    assert mixing.shares({}, seen) == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2})


def test_counts_of_bytes(monkeypatch):
    rng = random.Random(10)
    texts = ["", " ", "one", "a  b\tc\nd ", "x " * 5000, "Ünï 12 (A)\n|é", "word" * 3000] + ["".join(rng.choices("ab1A., \n\té", k=rng.randint(0, 300))) for _ in range(60)]
    for block in (7, 64, 1 << 18):
        monkeypatch.setattr(mixing, "BLOCK", block)
        for t, row in zip(texts, mixing.counts([t.encode() for t in texts])):
            raw = t.encode()
            assert row[7] == len(raw.split()) and row[:7].sum() == len(raw)
            assert row[2] == t.count("\n") and row[3] == sum(c.isdigit() for c in t) and row[4] == sum("A" <= c <= "Z" for c in t)


def test_topics_are_learned():
    rng = random.Random(12)
    prose = [" ".join("abcdefgh"[: rng.randint(2, 8)] for _ in range(rng.randint(80, 200))).encode() for _ in range(40)]
    tables = ["\n".join(f"{rng.randrange(10**6)} | {rng.randrange(10**6)}" for _ in range(30)).encode() for _ in range(40)]
    found = mixing.Topics(mixing.counts(prose + tables).tolist(), 2)
    of = found.of(mixing.counts(prose + tables))
    assert len(set(of[:40])) == len(set(of[40:])) == 1 and of[0] != of[40]


def test_topics_are_of_all_texts(spark):
    """Both centres are the means of every text of their form, copies counting once; once of 4,096 texts only."""
    rng = random.Random(13)
    prose = [" ".join("abcdefgh"[: rng.randint(2, 8)] for _ in range(rng.randint(8, 20))) for _ in range(3000)]
    tables = ["\n".join(f"{rng.randrange(10**6)} | {rng.randrange(10**6)}" for _ in range(rng.randint(4, 9))) for _ in range(2500)]
    df = spark.createDataFrame([(t,) for t in [*prose, *tables, *tables[:50], "", None]], "text string")
    found = mixing.learned(df, 2)
    x = [mixing.described(mixing.counts([t.encode() for t in sorted(set(part))])) for part in (prose, tables)]
    assert np.allclose(found.spread, [v or 1.0 for v in np.concatenate(x).std(axis=0)], atol=1e-5)
    assert np.allclose(sorted((found.centres * found.spread).tolist()), sorted(p.mean(axis=0).tolist() for p in x), atol=1e-5)
    again = mixing.learned(df.repartition(5), 2)
    assert (again.centres == found.centres).all() and (again.spread == found.spread).all()
    assert not len(mixing.learned(df.limit(0)).centres) and len(mixing.learned(spark.createDataFrame([("a b",)] * 9, "text string")).centres) == 1


def test_names_with_tabs_stay_apart(spark):
    rows = [(1, "some words here", "a\tb", "c"), (2, "some words here too", "a", "b\tc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert sorted(r["doc_id"] for r in mixing.mix(df).collect()) == [1, 2]


def test_mixing_against_a_plain_version(spark):
    """Cells, probabilities and decisions made again row by row."""
    rows = mixed(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    targets = {"source": None, "lang": {"en": 0.5, "fr": 0.3}, "topic": {}}
    got = mixing.mix(df, targets).collect()
    cells = defaultdict(float)
    for r in got:
        assert r["tokens_used"] == len(r["text"].split())
        cells[r["source"], r["lang"] or mixing.NONE, r["topic_used"]] += r["tokens_used"]
    keys = [k for k, n in sorted(cells.items()) if n]
    weight = {k: cells[k] for k in keys}
    total = sum(weight.values())
    goal = [mixing.shares(targets.get(name), {v: sum(n for k, n in weight.items() if k[i] == v) for v in {k[i] for k in keys}}) for i, name in enumerate(mixing.MARGINALS)]
    w = {k: n / total for k, n in weight.items()}
    for _ in range(500):
        for i in range(3):
            now = defaultdict(float)
            for k in keys:
                now[k[i]] += w[k]
            w = {k: w[k] * goal[i][k[i]] / now[k[i]] for k in keys}
    ratio = {k: w[k] / weight[k] for k in keys}
    draws = {r["doc_id"]: r["d"] for r in df.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id, text, 3), 11) / double(9007199254740992) as d").collect()}
    for r in got:
        p = ratio[r["source"], r["lang"] or mixing.NONE, r["topic_used"]] / max(ratio.values())
        assert r["probability"] == pytest.approx(p, rel=1e-6) and r["kept"] == (draws[r["doc_id"]] < r["probability"])


def plain_dice(text, threshold=licenses.THRESHOLD):
    import re

    low = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
    passages = low.split("\n") + [p.replace("\n", " ") for p in re.split(r"\n ?(?:\n ?)+", low) if "\n" in p.strip(" ")]
    found = []
    for p in passages:
        w = p.split()
        g = {f"{a} {b}" for a, b in zip(w, w[1:])}
        if g and (top := max((2 * len(g & set(t)) / (len(g) + len(t)), -i) for i, (_, t) in enumerate(licenses.listed(licenses.TEMPLATES))))[0] >= threshold:
            found.append((top[0], licenses.listed(licenses.TEMPLATES)[-top[1]][0]))
    return found


def test_licences_three_ways(spark, tmp_path):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = [
        None, "", "one", "\n\n", "All rights reserved.", "text\nReleased under the MIT license!\nmore", "All rights are reserved", mit, mit[:120] + "\n" + mit[120:300] + "\n" + mit[300:], "Intro\n\n" + mit.replace(", ", ",\n") + "\n\nend",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "licensed under cc by nc 3.0", "word " * 30000, "All rights reserved.\nAll rights reserved.", "Ünïcode All rights reserved. Ä",
    ]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, notices string")
    got = [tuple(r) for r in licenses.summary(licenses.scan(df)).collect()]
    expected = []
    for i, t in rows:
        found = plain_dice(t)
        order = [n for n, _ in licenses.listed(licenses.TEMPLATES)]
        best = max(found, key=lambda f: (f[0], -order.index(f[1])), default=(None, None))
        expected.append((i, len(found), ",".join(sorted({n for _, n in found})), best[1], best[0]))
    assert sorted(got, key=str) == sorted(expected, key=str)
    df.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert sorted(((None if a is None or a != a else int(a), *rest) for a, *rest in con.execute(licenses.summary_sql()).fetchall()), key=str) == sorted(got, key=str)
    assert licenses.summary(licenses.scan(df.limit(0))).count() == 0


def test_licence_scan_stays_in_the_row(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    plan = licenses.summary(licenses.scan(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home<li><a>Two</a></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One <i>two</i>
 three<br><p>Second&nbsp;x &lt;p&gt;</p><aside>side</aside><form><p>in form</p></form><div class="comments"><p>reader</p></div><p>Last</article><footer>foot</footer>"""


def test_blocks_of_an_article():
    assert wrapper.blocks(ARTICLE, None) == ["Head & tail", "One two three", "Second x <p>", "Last"]
    for empty in ("", "<html><body></body></html>", "<script>x</script>", "<!-- a", "<p"):
        assert wrapper.blocks(empty, None) in ([], ["<p"])
    assert [t[0] for t in wrapper.tokens("a<b>c<!-- d -->e<!x>f")] == ["a", "cef"]


def tree(source):
    return wrapper.folded(wrapper.parse(source)[0])


def plain_matching(a, b):
    """Simple tree matching as it is defined, by recursion."""
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (plain_matching(x, y) if x.label == y.label else 0))
    return 1 + best[-1][-1]


def test_tree_matching_against_recursion():
    rng = random.Random(9)

    def made(depth):
        return "".join(f"<{t}>{made(depth - 1) if depth and t != 'p' else 'x'}</{t}>" for t in rng.choices(["div", "p", "section"], k=rng.randint(0, 4)))

    for _ in range(60):
        a, b = tree(made(3)), tree(made(3))
        size, pairs = wrapper.matching(a, b)
        assert size == plain_matching(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)
        up = {id(x): y for x, y in pairs}
        assert all(up[id(x.up)] is y.up for x, y in pairs[1:])
        assert wrapper.matching(a, b, pairs=1)[0] >= 1  # labels alone


def test_labels_of_their_own_take_no_place_of_pairs():
    """Only pairs of equal labels are weighed, so a wide wrapper's other children do not leave the best pair unfound."""
    wide = "".join(f"<div id='p{i}'><ul><li>x</ul></div>" for i in range(300))
    a, b = tree("<div id='k'><p>a</p></div>" + wide + "<div id='k'><p>a</p><h2>b</h2><ul><li>c</ul></div>"), tree("<div id='k'><p>a</p><h2>b</h2><ul><li>c</ul></div>" + "".join(f"<div id='q{i}'><ul><li>x</ul></div>" for i in range(10)))
    assert wrapper.matching(a, b, pairs=100)[0] == plain_matching(a, b) == 6


def test_merging_keeps_the_order():
    a, b = tree("<div><p>a</p><ul><li>x</li></ul><h2>t</h2></div>"), tree("<div><p>a</p><h2>c</h2><table><tr><td>k</table></div>")
    wrapper.merge(a, b)
    assert [(k.label, k.pages) for k in a.kids[0].kids] == [("p", 2), ("ul", 1), ("h2", 2), ("table", 1)]


def bare(i, rng, words=12):
    """A page of nothing but divs: menu, advert, story, reader's box, legal notes."""
    para = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    story = [f"Title {i} {para(3)}", *(para(words) for _ in range(rng.randint(2, 5)))]
    inner = "".join(f"<p>{x}</p>" for x in story[1:])
    return f"<html><body><div><div>Home</div><div>About us</div></div><div>Buy this now</div><div><h2>{story[0]}</h2>{inner}<p>Please write to us.</p></div><div>Legal notes {i % 2}</div></body></html>", "\n\n".join(story)


def test_a_wrapper_tells_content_without_any_name():
    rng = random.Random(3)
    made = [bare(i, rng) for i in range(20)]
    found = wrapper.Wrapper(wrapper.induced([h for h, _ in made]))
    for source, story in made:
        assert "\n\n".join(wrapper.blocks(source, found)) == story
        assert "\n\n".join(wrapper.blocks(source, None)) != story
    # Brute force: a text is template where it stands on nine tenths of all pages, else content of the varying part.
    texts = Counter(t for h, _ in made for t in set(wrapper.declared(*wrapper.parse(h))))
    common = {t for t, n in texts.items() if n >= 18}
    assert common == {"Home", "About us", "Buy this now", "Please write to us."}
    assert not any(t in common for h, _ in made for t in wrapper.blocks(h, found))


def test_markup_of_odd_shape():
    for source in ("<div>" * 5000 + "x", '<a "' * 8000, "".join(f"<p>{i}</p><div>{i}</div>" for i in range(2000)), "<div><div>a</div><p>b</p><div>" * 300, "<div>" * 3000 + "</p></li>" * 3000, "<" * 20000, "<!--" * 5000, "a<b" * 5000):
        began = time.monotonic()
        found = wrapper.induced([source, source + "<p>y", source + "<p>z<p>k"])
        for page in (source, source + "<p>more"):
            assert isinstance(wrapper.blocks(page, wrapper.Wrapper(found)), list)
        assert time.monotonic() - began < 60


def page(i, host="h", body=None):
    soup = f"<html><body><div id='top'>Welcome to our site</div><div id='text'><h2>Title {i}</h2><p>Words {i} of the page</p></div><div id='end'>Legal notes</div></body></html>"
    return (i, f"https://{host}/p{i}" if host else None, soup if body is None else body, "x")


def test_constant_slots_are_template(spark):
    rows = [page(i) for i in range(6)] + [page(10, "alone"), page(11, None), page(12, "none", None)]
    rows += [page(20 + i, "copies", "<div><div id='a'>same</div><div id='b'>text</div></div>") for i in range(4)]
    rows += [(30, "https://h/x", None, "x"), (31, "https://h/y", "", "x"), (None, "https://h/z", ARTICLE, "x"), page(0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, site string")
    got = wrapper.extract(df.repartition(4)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert by[i] == f"Title {i}\n\nWords {i} of the page"
    assert by[10] == "Welcome to our site\n\nTitle 10\n\nWords 10 of the page\n\nLegal notes" and by[11].startswith("Welcome")
    assert by[20] == "same\n\ntext" and by[30] == by[31] == ""
    assert by[None].startswith("Head & tail")
    again = {(r["page_id"], r["text"]) for r in wrapper.extract(df.repartition(7)).collect()}
    assert again == {(r["page_id"], r["text"]) for r in got}  # whatever the tasks
    assert wrapper.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("names", "out"),
    [("sidebar", True), ("main-sidebar", True), ("has-sidebar", False), ("post comments-open", False), ("comment-list", True), ("ad", True), ("address", False), ("reader", False), ("site-header top", True), ("formal", False), ("", False), ("cookie_bar", True)],
)
def test_names_of_no_content(names, out):
    assert wrapper.no_content(names) is out


def test_broken_markup():
    assert wrapper.blocks('<div title="a>one</div><p>two', None) == ["one", "two"]
    assert wrapper.blocks("<div class='notice'><article><p>kept</p></article></div>", None) == ["kept"]
    assert wrapper.blocks("<ul><li>a<ul><li>b</ul><li>c</ul>", None) == ["a", "b", "c"]
    assert wrapper.blocks("<table><tr><td>a<td>b<tr><td>c</table>", None) == ["a", "b", "c"]
    assert wrapper.blocks("a < b and c > d <br> e", None) == ["a < b and c > d e"]


def test_copies_keep_all_of_their_article(spark):
    article = "<article><h1>Pumps</h1><p>How they work.</p><ul><li>One part</li><li>Another</li></ul><table><tr><td>5 bar</td></tr></table><pre>run it</pre><blockquote>Said so</blockquote>bare words</article>"
    page = f"<html><body><nav>Home</nav><div>Top</div>{article}<footer>End</footer></body></html>"
    df = spark.createDataFrame([(i, f"http://copies.example/{i}", page) for i in range(4)], "page_id long, url string, html string")
    texts = {r["text"] for r in wrapper.extract(df).collect()}
    assert texts == {"Pumps\n\nHow they work.\n\nOne part\n\nAnother\n\n5 bar\n\nrun it\n\nSaid so\n\nbare words"}


def test_a_wrapper_is_of_all_pages(spark):
    """A notice on the 32 pages with the smallest hashes, but on under half of all: content, though once dropped."""

    def made(i, notice):
        return f"<div><div>Home</div><div><h2>Title {i}</h2><p>{notice}</p><p>Words {i} of the page</p></div></div>"

    def by_hash(pages):
        return sorted((r["h"], r["t"]) for r in spark.createDataFrame([(t,) for t in pages], "t string").selectExpr("t", "xxhash64(t) as h").collect())

    first = by_hash(made(i, "Open today.") for i in range(200))[:32]
    pages = [t for _, t in first] + [t for h, t in by_hash(made(i, f"Open on day {i}.") for i in range(200, 400)) if h > first[-1][0]][:48]
    rows = [(i, f"https://h/{i}", t) for i, t in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(pages) == 80 and all(len(got[i].split("\n\n")) == 3 and "Open " in got[i] and "Home" not in got[i] for i in range(80))


def test_wrappers_against_pages_at_hand(spark):
    """Merged by shape and counted as a table, or page by page: the same wrapper. One long page of its own changes no region."""
    rng = random.Random(21)
    plain = [bare(i, rng)[0] for i in range(70)]
    more = [bare(i, rng)[0].replace("<body>", "<body><div>News</div><ul><li>x</ul>") for i in range(40)]
    lone = ["<html><body><section><p>" + "long " * 50000 + "</p></section></body></html>"]
    shapes = Counter(wrapper.shaped(wrapper.ordered(tree(t))) for t in plain + more + lone)
    pages = sorted(plain + more + lone, key=lambda t: -shapes[wrapper.shaped(wrapper.ordered(tree(t)))])
    rows = [("h", t) for t in pages] + [("h", t) for t in pages[:50]] + [("few", t) for t in pages[:2]] + [(None, plain[0])]
    df = spark.createDataFrame(rows, "site string, html string").select("site", "html", F.xxhash64("html").alias("hash"))
    assert len(shapes) == len(set(shapes.values())) == 3
    assert {r["site"]: r["wrapper"] for r in wrapper.wrappers(df.repartition(6)).collect()} == {"h": wrapper.induced(pages)}
    found = wrapper.Wrapper(wrapper.induced(plain))
    for t in plain + more:
        slots = wrapper.ordered(tree(t))
        of = {id(y): x for x, y in wrapper.matching(found.top, slots[0])[1]}
        assert found.aligned(slots) == found.aligned(slots) == [of.get(id(s)) for s in slots]
