"""Line dedup, licence scans, URL filters, toxicity, the pipeline and the registered queries."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import licenses, line_dedup, queries, toxicity, url_filter
from quillspark.llm.toxicity import BlockMaxIndex, toxicity_scores
from quillspark.llm.url_filter import filter_urls

SF = "/root/testdata/sf0.001"


def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    a, b = queries.QUERIES[name](spark, SF), duck(SF).sql(queries.ORACLE_SQL[name])
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    at = [b.columns.index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in a.collect()) == sorted(
        repr(tuple(r[i] for i in at)) for r in b.fetchall()
    )


def test_columns_are_found_whatever_their_case(spark):
    rows = [(k, "s", f"own {k}\nshared line" + "\nlong " * (20_000 * (k == 0))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, TEXT string")
    got = line_dedup.drop_boilerplate(df)
    assert got.columns == ["doc_id", "source", "TEXT", "n_lines", "n_dropped"]
    for r in got.collect():
        assert r.TEXT == rows[r.doc_id][2].replace("\nshared line", "") and r.n_dropped == 1


def test_lines_that_every_host_repeats_go_from_all(spark):
    """A line on a twelfth of each host's pages, and one on a fortieth, by chance more on some hosts."""
    rng = random.Random(2)
    rows = []
    for k in range(6000):
        lines = [f"line {k}", *(["menu and footer"] if k % 12 == 0 else []), *(["by chance"] if rng.random() < 1 / 40 else [])]
        rows.append((k, f"host{k // 12 % 12}", "\n".join(lines)))
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    left = [r.text.split("\n") for r in got.collect()]
    assert not any("menu and footer" in x for x in left)
    assert sum("by chance" in x for x in left) == sum("by chance" in r[2] for r in rows)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        host = rng.choice(["a", "a", "b", None])
        lines = [rng.choice(["menu", " menu ", "footer", "", "  "]) if rng.random() < 0.4 else f"line {rng.randrange(400)}" for _ in range(6)]
        rows.append((k, "\n".join(lines) if k % 17 else None, host, 3, "x"))
    rows += [rows[1], (200, "", "c", 0, "x"), (201, "menu", "lonely", 0, "x"), (202, "menu", "lonely", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, _host string")
    got = line_dedup.drop_boilerplate(df, ratio=0.2, min_pages=3).collect()
    pages, seen = Counter(), Counter()
    for _, t, h, *_ in rows:
        pages[h] += 1
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[h, x] += 1

    def keep(h, x):
        n = seen[h, x.strip(" ")]
        return not x.strip(" ") or not (n >= 3 and n > 0.2 * pages[h])

    want = []
    for d, t, h, *_ in rows:
        kept = None if t is None else [x for x in t.split("\n") if keep(h, x)]
        total = 0 if t is None else len(t.split("\n"))
        want.append((d, None if t is None else "\n".join(kept), total, total - len(kept or []) if t is not None else 0))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got if r.text is not None) == sorted(w for w in want if w[1] is not None)
    assert len(got) == len(rows)
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_licences(spark):
    rows = [
        (1, MIT, "MIT-text", "permissive"),
        (2, "x\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,All-Rights-Reserved", "noncommercial,proprietary"),
        (3, "a licence to fish. permission is not a rule", "", ""),
        (4, None, "", ""),
        (5, "", "", ""),
        (6, "Released   under the MIT  License!! Released under the MIT License.\n", "MIT", "permissive"),
        (7, "word " * 30000 + "\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "copyleft"),
        (7, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://x\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Apache-2.0-header", "permissive"),
    ]
    df = spark.createDataFrame([(a, b, "z") for a, b, *_ in rows], "doc_id long, text string, licenses string")
    got = [(r.doc_id, r.licenses, r.categories) for r in licenses.scan_licenses(df).collect()]
    assert sorted(got) == sorted((a, c, d) for a, _, c, d in rows)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_every_known_sentence_is_normal_and_needed():
    for s in licenses.SENTENCES:
        assert s == re.sub("[^a-z0-9]+", " ", s).strip()
        assert re.search(licenses.NEEDED, s), s
    used = {i for _, _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.SENTENCES.values())


def test_native_plans(spark):
    for name in ("op1_line_dedup", "op2_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def brute_url(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_urls(spark):
    urls = [
        None, "", "nonsense", "http://", "HTTP://A.Example.COM/en/71?x#y", "http://example.com/en/8", "https://com/en/", "x://notexample.com/en/7",
        "http://www.example.net/de/81", "http://example.net/de/7", "http://a.org/es/1", "http://org/es", "http://É.org?q/es/", "http://b.example.com/en/7/../a",
        "a://b://c/d", "http://example.com#/en/", "http://x.net/de/1\n2", "http://fexample.com/fr/1", "http://x.y/" + "a/" * 3000,
    ]
    df = spark.createDataFrame([(k, u, 1, 1) for k, u in enumerate(urls)] + [(None, urls[5], 1, 1)], "page_id long, url string, segs int, n int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_urls(df, none).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[5] if r.page_id is None else urls[r.page_id]
        host, path, rule, verdict = brute_url(u)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), u
    assert filter_urls(df.limit(0), none).count() == 0


def test_templates_of_many_and_deep_branches(spark):
    """One bad section among 300 good ones, and one that differs in the seventh segment."""
    urls, labels = [], []
    for k in range(300 * 8):
        urls.append((k, f"http://h.test/s{'abcdefghij'[k % 10]}{'abcdefghijklmnopqrstuvwxyzabcd'[k // 10 % 30]}/{k}.html"))
        labels.append((k, 1, int(k % 10 == 3 and k // 10 % 30 == 7)))
    for k in range(3000, 3100):
        urls.append((k, f"http://h.test/a/b/c/d/e/f/{'bad' if k % 2 else 'good'}/{k}"))
        labels.append((k, 1, k % 2))
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.verdict == ("block" if truth[r.page_id] else "allow") for r in got)


def test_bad_templates_are_rejected(spark):
    urls, labels = [], []
    for k in range(400):
        part = ["news", "casino", "blog", "shop"][k % 4]
        urls.append((k, f"http://h.test/{part}/{k}.html", 0))
        if k % 2 == 0 or part == "casino":
            labels.append((k, 1, int(part == "casino" or k % 40 == 0)))
    urls.append((1000, "http://h.test/casino/99999.html", 0))
    df = spark.createDataFrame(urls, "page_id long, url string, bad int")
    got = filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in got:
        assert r.verdict == ("block" if "/casino/" in r.path else "allow"), r


@pytest.mark.parametrize("common", [0, 5, 1000])
def test_block_max_search_is_exact(common):
    rng = np.random.default_rng(4)
    dense = np.zeros((700, 40))
    for d in range(700):
        t = rng.choice(40, size=int(rng.integers(1, 8)), replace=False)
        dense[d, t] = rng.random(len(t)) + 0.05
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    ptr = np.concatenate([[0], np.cumsum((dense > 0).sum(axis=1))])
    terms = np.concatenate([row.nonzero()[0] for row in dense])
    index = BlockMaxIndex(np.arange(700), np.arange(700) % 3 == 0, ptr, terms, dense[dense > 0], 41, common)
    assert index.blocks == 11 and (index.labels == (index.ids % 3 == 0)).all()
    scored, whole = [], index._read
    index._read = lambda t, w, part, blocks: (scored.append(int(blocks.sum())), whole(t, w, part, blocks))[1]
    by_id = {int(d): p for p, d in enumerate(index.ids)}
    for q in range(0, 700, 7):
        t = dense[q].nonzero()[0]
        places, cosines = index.nearest(t, dense[q][t], 15)
        every = dense @ dense[q]
        order = sorted(range(700), key=lambda d: (-every[d], by_id[d]))[:15]
        assert np.allclose(cosines, every[order])
        assert set(np.round(cosines, 9)) == set(np.round(every[order], 9))
    assert sum(scored) < 100 * index.blocks or not common  # bounds keep some blocks unread
    none = np.empty(0, dtype=np.int64)
    assert len(index.nearest(none, np.empty(0))[0]) == 0 and len(index.nearest(np.array([40]), np.ones(1))[0]) == 0


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    test = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(y == p for y, p in test) / len(test) > 0.97
    # some texts that the labels call toxic are junk without any such word
    assert sum(p for y, p in test if y) / sum(y for y, _ in test) >= 0.9
    assert sum(p for y, p in test if not y) / sum(1 - y for y, _ in test) < 0.01
    # calibrated: of the texts of a score, about that share is toxic
    truth_of, score_of = np.array([(truth[i], r.score) for i, r in got.items() if r.held_out and i in truth]).T
    error = 0
    for k in range(10):
        here = (score_of >= k / 10) & (score_of < (k + 1) / 10 + (k == 9))
        if here.any():
            error += here.mean() * abs(score_of[here].mean() - truth_of[here].mean())
    print("held out: recall", sum(p for y, p in test if y) / sum(y for y, _ in test), "calibration error", error)
    assert error < 0.03


def test_toxicity_equals_a_dense_version(spark):
    """The whole query over sf0.001, by words and dense matrices."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}

    def terms(t):
        words = re.findall(r"[^\W\d_]+", t.lower())
        return Counter(x for w in words for x in (w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)))

    counts = {i: terms(t) for i, t in text.items()}
    rows = [
        (r.doc_id, r.toxic, r.calibrates)
        for r in labels.withColumn("calibrates", toxicity._spread(F.col("doc_id"), 6) % 5 == 0).collect()
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1
    ]
    teach = [(i, y) for i, y, c in rows if not c]
    names = sorted({x for i, _ in teach for x in counts[i]})
    at = {x: k for k, x in enumerate(names)}
    tf = np.zeros((len(text), len(names)))
    order = sorted(text)
    for d, i in enumerate(order):
        for x, n in counts[i].items():
            if x in at:
                tf[d, at[x]] = 1 + math.log(n)
    place = {i: d for d, i in enumerate(order)}
    has = tf[[place[i] for i, _ in teach]] > 0
    y = np.array([y for _, y in teach])
    ratio = (has[y == 1].sum(axis=0) + 2) / (has.sum(axis=0) * y.mean() + 2)
    w = tf * (np.log((len(text) + 1) / ((tf > 0).sum(axis=0) + 1)) + 1) * np.abs(np.log(ratio))
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    cos = w @ w[[place[i] for i, _ in teach]].T

    def vote(d):
        near = np.argsort(-cos[d], kind="stable")[:15]
        near = near[cos[d][near] > 0]
        each = cos[d][near] ** 2 * np.where(y[near], (y == 0).sum() / y.sum(), 1)
        return (each @ y[near] / each.sum() if len(near) else y.mean()), {teach[k][0] for k in near}

    def logit(v):
        return math.log((v + 0.02) / (1.02 - v))

    xs = [(logit(vote(place[i])[0]), y_) for i, y_, c in rows if c]

    def loss(a, b):
        return sum(math.log1p(math.exp(-(a * x + b) * (2 * y_ - 1))) for x, y_ in xs) + 0.05 * ((a - 1) ** 2 + b * b)

    a, b, step = 1.0, 0.0, 1.0
    while step > 1e-9:  # pattern search
        best = min([(loss(a, b), a, b), *((loss(a + i, b + j), a + i, b + j) for i, j in ((step, 0), (-step, 0), (0, step), (0, -step), (step, -step), (-step, step)))])
        step, a, b = (step / 2, a, b) if best[1:] == (a, b) else (step, best[1], best[2])
    assert a > 0
    for i, r in got.items():
        v, near = vote(place[i])
        assert math.isclose(r.score, 1 / (1 + math.exp(-(a * logit(v) + b))), abs_tol=1e-4), i
        assert len(near ^ set(r.examples)) <= 2  # equal cosines at the end of the list


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5, "t"), (2, "", 0.5, "t"), (None, "x", 0.5, "t"), (2, "", 0.5, "t"), (3, "idiot " * 40000, 0.5, "t")], "doc_id long, text string, score double, terms string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_scores(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity_scores(docs, some).count() == 5
    assert toxicity_scores(docs.limit(0), some).count() == 0


def test_toxicity_terms_and_calibration():
    text = "Abcdef abcdef, abcdex\n_z9z abcd" + " long" * 7
    want = {"abcdef": 2, "abcdex": 1, "abcd*": 3, "abcde*": 3, "z": 2, "abcd": 1, "long": 7}
    assert toxicity.text_terms(text) == want
    names = sorted([*want, "other", "othe*"])
    terms = toxicity.Terms(names)
    at, n = terms.counts(text)
    assert {names[i]: k for i, k in zip(at, n)} == want and len(at) == len(want)
    assert sorted(names[i] for i in terms.present(text)) == sorted(want)
    assert [len(x) for x in terms.counts("")] == [0, 0] and len(toxicity.Terms([]).counts("a b")[0]) == 0
    rng = np.random.default_rng(2)
    c = toxicity.Classifier(["a", "b"], np.ones(2), np.array([1, 2]), [1, 0], np.array([0, 1, 2]), np.array([0, 1]), np.array([1, 1]), 0.1)
    votes = rng.random(20_000)
    c.calibrate(votes, (rng.random(20_000) < votes**2).astype(float))
    assert abs(c.score(0.5) - 0.25) < 0.03 and c.score(0.9) > c.score(0.1)
    assert c.vote(np.empty(0), np.empty(0)) == 0.1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    scores = {r.doc_id: r.predicted for r in toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    a = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert a.columns == columns
    assert sorted(r.doc_id for r in a.collect()) == sorted(i for i, p in scores.items() if not p)
    b = corpus_pipeline.drop_lines(spark, a, SF)
    assert b.columns == columns and b.count() == a.count()
    assert b.filter("n_chars <> length(text)").count() == 0
    twice = b.union(b.filter("doc_id < 5")).union(b.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    from quillspark.llm.jaccard import similar_documents

    classes = {r.component_id for r in similar_documents(b).collect()}
    c = corpus_pipeline.drop_near_duplicates(spark, twice, SF)
    assert c.columns == columns
    assert sorted(r.doc_id for r in c.collect()) == sorted(classes)
    assert corpus_pipeline.pack(spark, c, SF).count() >= c.count()


def test_rows_that_share_an_id_are_judged_each_for_itself(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, words, 1), (5, "a text of its own that nothing else is like at all", 2), (3, words + " ", 3), (None, words, 4), (7, None, 5), (None, "", 6),
            (None, "alone and without an id but kept for all that", 7), (3, words, 8), (3, words, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class int")
    got = sorted((r["class"] for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()))
    assert len(got) == 4 and {2, 7, 5} < set(got) and len(set(got) & {1, 3, 4, 8}) == 1
    toxic = [(1, "idiot", 1), (1, "a fine day", 2), (None, "a fine day", 3)]
    labels = [(k, int(k % 2)) for k in range(10, 400)]
    texts = toxic + [(k, "stupid idiot clown scum" if k % 2 else "the weather is good today", 9) for k in range(10, 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, score int")
    kept = toxicity.drop_toxic_rows(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns
    assert sorted(r.score for r in kept.collect() if r.score < 9) == [2, 3] and kept.count() == 2 + 195


@pytest.mark.parametrize("kind", ["empty", "edges"])
def test_pipeline_edges(spark, tmp_path, kind):
    rows = [(1, None, "en", None, 0), (1, "", None, "s", 0), (None, "x y z", "en", "s", 3), (2, "same text here", "en", "s", 14), (2, "same text here", "en", "s", 14),
            (4, "w " * 50_000, "de", "t", 1), (9, "ﬁ漢\n\n\u0001", None, None, None)]
    extra = [(*r, k, 0.5, "z") for k, r in enumerate(rows)] if kind == "edges" else []
    df = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, `row` int, score double, n_lines string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 1, None), (None, 0, 1), (2, None, 0)] if kind == "edges" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids == (set() if kind == "empty" else {1, None, 2, 4, 9})
    assert sum(r.doc_id == 2 for r in got) == (kind == "edges")


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_very_long_urls(spark):
    """A megabyte of one kind of character stalls no task."""
    import time

    from quillspark.llm.url_filter import filter_urls

    kinds = ["1", "a", ".", "/", "-", "1a", "a1.", "1/", "%20"]
    data = [(k, "http://h.example/" + c * (1_000_000 // len(c)) + "!") for k, c in enumerate(kinds)] + [(99, "http://h.example/doc-17.html")]
    pages = spark.createDataFrame(data, "page_id long, url string").repartition(4)
    labels = spark.createDataFrame([(17, 1, 0)], "doc_id long, quality int, toxic int")
    keyed = pages.selectExpr("page_id", "regexp_extract(url, '(?<![0-9])([0-9]++)[.a-z]*+/?$', 1) as n")
    began = time.time()
    assert {r.page_id: r.n for r in keyed.collect()} == {**{k: "" for k in range(len(kinds))}, 99: "17"}
    assert time.time() - began < 30
    short = filter_urls(pages.filter("page_id in (0, 1, 2, 4, 99)"), labels).collect()
    assert len(short) == 5 and {r.verdict for r in short} == {"allow"}
