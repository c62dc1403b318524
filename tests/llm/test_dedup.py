"""Near-duplicate operators, fingerprints and components against brute force."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
import xxhash

from quillspark.llm.components import connected_components
from quillspark.llm.digest import canonical, digest, edited_fingerprints, exact_groups
from quillspark.llm.embed_forest import embedding_near_duplicates
from quillspark.llm.simhash import fingerprint, simhash_links, simhash_near_duplicates

SF = "/root/testdata/sf0.001"


def closure(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            m = min(least[u], least[v])
            if least[u] != m or least[v] != m:
                least[u] = least[v] = m
                changed = True
    return least


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    links += [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*links, (None, 1), (1, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {n for u, v in links if u != v for n in (u, v)}
    want = closure(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C", "é É x y z", "a b c " * 50, "x y z\x0bq w", "w " * 70000])
def test_fingerprints(text):
    assert fingerprint(text.encode() if text else None) == plain_fingerprint(text)


def test_links_are_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, 1, 2**63, 2**64 - 1}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {tuple(sorted((r.u, r.v))) for r in simhash_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {
        tuple(sorted((signed[i], signed[j])))
        for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3
    }
    assert got == want


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, 1, "c") for r in docs] + [(900, None, 1, "c"), (901, "", 1, "c"), (902, docs[3].text, 1, "c"), (902, docs[3].text, 1, "c"), (None, docs[3].text, 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, node string")
    got = simhash_near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = closure(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    want = sorted((str(r[0]), f"{fps[i]:016x}", least.get(comp[i])) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash_near_duplicates(df.limit(0)).count() == 0


def test_simhash_index_and_links_are_not_broadcast(spark):
    """At the planner's default too, which takes the index's 66 rows a fingerprint for one."""
    import quillspark.llm.components as c
    from quillspark.llm.common import written

    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fps = written(spark.createDataFrame([(k * 2**40,) for k in range(50)], "fp long"), "fps")
    links = written(simhash_links(fps), "links")
    for df in (simhash_links(fps), c._star(c._star(links, True), False)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_canonical_form():
    assert canonical("  ﬁne  STRASSE\n") == "fine strasse"
    assert canonical("Straße") == canonical("STRASSE")
    assert canonical(None) == canonical(" \n") == ""
    t = "éÉ"
    assert canonical(t) == canonical(unicodedata.normalize("NFC", t))


def test_edited_fingerprints(spark):
    texts = {5: "abcdefghi", 9: "XYZ123", 2: None, 7: "Straße und é" * 40, 30: "abcdefghi", 31: "ABCDEFGHI ", 12: "q"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == set(texts)
    for i, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(canonical(t)), digest(canonical(edited)))
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt)))
    assert got[31].near_next == 1.0
    assert {k: r.group_id for k, r in got.items()} == {5: 5, 9: 9, 2: 2, 7: 7, 30: 5, 31: 5, 12: 12}
    assert edited_fingerprints(df.limit(0)).count() == 0
    assert edited_fingerprints(df.filter("doc_id = 5")).first().near_next == 1.0
    ids = [(None, "x"), (1, "b"), (1, "a")]
    assert edited_fingerprints(spark.createDataFrame(ids, "doc_id long, text string")).count() == 3


def test_exact_groups(spark):
    rows = [(3, "A  b"), (1, "a b"), (2, "c"), (4, None), (5, ""), (None, "A B"), (2, "c")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.group_id) for r in got) == sorted(
        [("3", 1), ("1", 1), ("2", 2), ("2", 2), ("4", 4), ("5", 4), ("None", 1)]
    )


@pytest.mark.parametrize("bits", [6, 12, 26])
def test_bytes_are_compared_where_digests_are_equal(spark, bits):
    """A digest of one hex digit that tells: buckets hold several texts and must be split by their bytes."""
    rows = [(k, f"Text  {k % 60}".upper() if k % 3 else f"text {k % 60}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weak = exact_groups(df, bits=bits, of=lambda canon: ("0" if len(canon) < 7 else digest(canon)[0]) * 32).collect()
    assert sorted((r.doc_id, r.group_id) for r in weak) == [(k, k % 60) for k in range(400)]


def test_long_texts_and_broken_bytes_have_fingerprints(spark):
    long = "Ab  C" * 200_000
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF') AS string) AS text").union(
        spark.createDataFrame([(2, long), (3, long.lower())], "doc_id long, text string")
    )
    got = {r.doc_id: r for r in edited_fingerprints(df).collect()}
    assert got[1].n_chars == 2 and got[2].fingerprint == got[3].fingerprint and got[3].group_id == 2


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(300):
            v = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 4))):
                rows.append((k, (v + rng.standard_normal(16) * 0.03).astype(float).tolist(), label, 1))
                k += 1
    rows += [(k + j, rows[0][1], 0, 1) for j in range(5)]
    n = len(rows)
    rows += [(n + 10, None, 0, 1), (n + 11, [0.0] * 16, 0, 1), (n + 12, [float("nan")] * 16, 0, 1), (n + 13, [1.0] * 15 + [None], 0, 1),
             (n + 14, rows[0][1], None, 1), (n + 15, [], 0, 1), (n + 16, [1.0, 2.0], 0, 1), (None, rows[1][1], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, copies int")
    got = {r.vec_id: r for r in embedding_near_duplicates(df).collect()}
    assert len(got) == len(rows)
    whole = [(r[0], r[1], r[2]) for r in rows[:n]] + [(None, rows[1][1], 0)]
    x = np.array([r[1] for r in whole])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in whole])[:, None] == np.array([r[2] for r in whole])[None])
    want = int(near.sum()) - len(whole)
    found = sum(got[r[0]].n_links for r in whole)
    assert found <= want and found >= 0.97 * want
    for r in rows[n : n + 7]:
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)
    assert got[rows[n - 1][0]].component_id == rows[0][0] and not got[None].kept
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_fat_leaves_are_compared_whole(spark, monkeypatch):
    import quillspark.llm.embed_forest as e

    rng = np.random.default_rng(1)
    v = rng.standard_normal(8)
    rows = [(k, (v + rng.standard_normal(8) * 0.01).tolist(), 0) for k in range(120)]
    monkeypatch.setattr(e, "MAX_BLOCK", 16)
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links == 119 and r.component_id == 0 for r in got)
