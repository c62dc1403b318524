"""Repeats as relations, against the kernel's walk: in one text, across files, by component; caps, walls and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.catalog import load_rules
from quillspark.functions import scan as kernel
from quillspark.functions.chars import Bytes
from quillspark.functions.duplication import find_runs, longest, tokenize
from quillspark.operators import repeats
from quillspark.operators.components import components


def kernel_islands(ids, files, k, floor, across):
    """All maximal repeats by brute force, as places of the relational form."""
    at, number = [], {}
    for f in files:
        number[f] = number.get(f, -1) + 1
        at.append((f << repeats.FILE_BITS) + number[f])
    out, n = [], len(ids)
    for d in range(1, n):
        e = 0
        while e + d < n:
            m = 0
            while e + d + m < n and ids[e + m] == ids[e + d + m] and files[e + m] == files[e] and files[e + d + m] == files[e + d]:
                m += 1
            same = files[e] == files[e + d]
            if m >= k and (not same if across else same and d >= k):
                reach = m if across else min(m, d)
                if reach >= floor:
                    out.append((at[e], at[e + d], m, reach))
            e += max(m, 1)
    return at, out


@pytest.mark.parametrize("across", [False, True])
def test_choice_equals_the_walk(across):
    rng = random.Random(5)
    reported = 0
    for _ in range(1500):
        text = " ".join(rng.choice("abc" if rng.random() < 0.8 else "defgh") for _ in range(rng.randrange(4, 60)))
        if rng.random() < 0.7:
            some = text.split()
            a = rng.randrange(len(some))
            text += " x " + " ".join(some[a : a + rng.randrange(3, 30)]) + " y " + " ".join(some[a // 2 : a + 9])
        parts = [text]
        if across:
            words = text.split()
            cuts = sorted(rng.sample(range(len(words)), min(len(words), 4)))
            parts = [" ".join(words[x:y]) for x, y in zip([0, *cuts], [*cuts, len(words)])]
        tokens = [t for k, p in enumerate(parts) for t in tokenize(p, k)]
        k, floor = 3, rng.choice((3, 5, 8))
        at, found = kernel_islands([t.word for t in tokens], [t.file for t in tokens], k, floor, across)
        words = [t.word for t in tokens]
        counts = {}
        for i in range(len(words) - k + 1):
            if tokens[i].file == tokens[i + k - 1].file:
                counts[tuple(words[i : i + k])] = counts.get(tuple(words[i : i + k]), 0) + 1
        if max(counts.values(), default=0) > 33:
            continue
        want = [(at[r.earlier], at[r.later], r.length) for r in find_runs(tokens, k, floor, across)]
        assert sorted(repeats.chosen(found, k, across)) == sorted(want), (text, parts)
        reported += len(want)
    assert reported > 500


PARA = "the gate runs the policy over every draft before it is sent out to anyone"
OTHER = "a decoy that has the policy over every draft before it is, but then goes on"


def texts():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(n))
    out = [
        "", PARA, f"{PARA}. {filler(20)}\n\n{PARA}", f"{PARA}\n" * 3, f"{OTHER} {filler(9)} {PARA} {filler(5)} {PARA}", f"{PARA} {PARA} {PARA} {PARA}",
        "very " * 200, f"{PARA} " * 26, f"{PARA} " * 40, "É’tait ΣΊΣΥΦΟΣ " * 3 + PARA + ' "' + PARA.upper() + '"', f"```\n{PARA}\n```\n> {PARA}\n# {PARA}\n",
        f"{PARA} {filler(2)} {' '.join(PARA.split()[3:])} tail {filler(2)} x {PARA} tail",
        "nine words that are said twice here by me. " * 2, "İstanbul ß ǅ x1 y2 z3 a’b c'd e f g h " * 3,
    ]
    for _ in range(60):
        parts = [filler(rng.randrange(3, 30)) for _ in range(4)]
        out.append(" ".join(rng.choice((*parts, PARA)) + rng.choice(". \n|, |\n\n> | ".split("|")) for _ in range(rng.randrange(2, 9))))
    return out


def test_texts_equal_the_kernel(spark):
    data = texts()
    rows = [*enumerate(data), (0, None), (2, data[2]), (None, data[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as g", "2 as f", "3 as early")
    got = repeats.self_repeats(df.repartition(3)).collect()
    rule = repeats.repeat_rule()
    scanner = kernel.scanner_of((rule.id,))
    want, capped = [], []
    for d, t in rows:
        words = [x.word for x in tokenize(t or "")]
        shingles = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        if shingles and max(map(shingles.count, set(shingles))) > 33:
            capped.append(d)
            continue
        for f in kernel.find(t or "", (), scanner):
            want.append((d, f.start, f.end, f.snippet, f.snippet_truncated, f.container))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.s, r.e, r.snippet, r.snippet_truncated, r.container)) for r in got if not r.capped)
    assert sorted(capped) == sorted(r.doc_id for r in got if r.capped) and len(capped) == 2 and len(want) > 60


def test_components(spark):
    rng = random.Random(1)
    edges = [(1, k, k + 1) for k in range(0, 40)] + [(1, 100, 103), (1, 103, 101), (2, 5, 6), (2, 6, 9)] + [(3, 0, k) for k in range(1, 30)]
    rng.shuffle(edges)
    got = {(r.g, r.node): r.component for r in components(spark.createDataFrame(edges, "g long, a long, b long")).collect()}
    assert got == {
        **{(1, k): 0 for k in range(41)}, **{(1, k): 100 for k in (100, 101, 103)}, **{(2, k): 5 for k in (5, 6, 9)}, **{(3, k): 0 for k in range(30)},
    }
    assert components(spark.createDataFrame([], "g long, a long, b long")).count() == 0


def bundles():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(400)) for _ in range(n))
    stems = [filler(rng.randrange(9, 40)) for _ in range(60)]
    out = []
    for f in range(120):  # one large bundle of many components
        mine = stems[(f // 4) % 60]
        out.append((1, f, f"p{f % 7}", f"{filler(8)} {mine} {filler(4)}\n> {mine if rng.random() < 0.5 else filler(6)}"))
    for g in range(2, 12):
        for f in range(rng.randrange(1, 6)):
            parts = [rng.choice(stems[:5]) if rng.random() < 0.6 else filler(9) for _ in range(3)]
            out.append((g, f, "é" if f % 2 else "z", rng.choice(('"{}"', "{}", "```\n{}\n```")).format(" and so ".join(parts))))
    out += [(20, f, f"f{f}", "very good " * 60 + PARA) for f in range(3)]  # a capped walk
    out += [(21, f, f"w{f:02}", f"{filler(3)} {PARA} {filler(3)}") for f in range(30)]  # over 21 files
    out += [(22, 0, None, PARA), (22, 1, None, None), (22, 2, None, PARA.upper())]
    return out


def test_bundles_equal_the_kernel(spark):
    from quillspark.operators import evidence

    files = bundles()
    df = spark.createDataFrame(files, "bundle_id long, file_idx int, path string, text string").repartition(5)
    _, shared = evidence.analyze_bundle(df)
    got = {}
    for r in sorted(shared.collect(), key=lambda r: (r.bundle_id, r.entry)):
        places = [(o.path, [o.span.start, o.span.end], o.container) for o in r.occurrences]
        got.setdefault(r.bundle_id, []).append((r.snippet, r.snippet_truncated, places))
        assert r.entry == len(got[r.bundle_id])
    entries = 0
    for g in {f[0] for f in files}:
        want = kernel.shared_passages([(p or "", t or "") for b, _, p, t in sorted(files, key=lambda f: (f[0], f[1])) if b == g])
        plain = [(w["snippet"], w["snippet_truncated"], [(o["path"], o["span"], o["container"]) for o in w["occurrences"]]) for w in want]
        assert got.get(g, []) == plain, g
        entries += len(plain)
    assert len(got[1]) == 20 and got[20] and len(got[21][0][2]) == 30 and entries > 40
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_findings_equal_the_kernel_capped_or_not(spark):
    from quillspark.operators import evidence
    from quillspark.plans.evidence import _documents, self_duplication

    sf = "/root/testdata/sf0.001"
    got = self_duplication(spark, sf)
    want = evidence.findings(_documents(spark, sf), rules=[repeats.repeat_rule().id])
    assert got.columns == want.columns
    a, b = (sorted(map(repr, map(tuple, x.collect()))) for x in (got, want))
    assert a == b and len(a) > 20


def walls(words, at, tag, n=33):
    """Decoys that share eight words from a place and no more, enough to hide what came before them from a walk."""
    return " ".join(f"{' '.join(words[at : at + 8])} {tag}{k}a {tag}{k}b." for k in range(n))


def test_decoys_hide_no_copy():
    """A capped walk: the run is found one word in and reaches back to its begin."""
    words = [f"w{k}" for k in range(12)]
    text = f"{' '.join(words)} . {walls(words, 0, 'd')} then {' '.join(words)} end"
    (hit,) = kernel.scanner_of(("SD-Q005",)).scan(text)
    assert text[hit.start : hit.end].split() == words


def test_the_longest_run_both_ways_wins():
    """A rival that reaches further ahead loses to a copy that is longer in all."""
    words = [f"w{k}" for k in range(13)]
    decoys = " ".join(walls(words, k, f"d{k}x") for k in range(4))
    text = f"{' '.join(words)} stop. rival {' '.join(words[4:])} after. {decoys} then {' '.join(words)} after"
    hits = kernel.scanner_of(("SD-Q005",)).scan(text)
    assert text[max(hits, key=lambda h: h.start).start :].split()[:13] == words and [text[h.start : h.end].split() for h in hits][-1] == words


def test_ten_words_are_the_floor(spark):
    ten, nine = " ".join(f"t{k}" for k in range(10)), " ".join(f"n{k}" for k in range(9))
    df = spark.createDataFrame([(1, f"{ten} x y {ten}"), (2, f"{nine} x y {nine}")], "doc_id long, text string")
    assert [(r.doc_id, r.n) for r in repeats.self_repeats(df).collect()] == [(1, 10)]


def whole_texts():
    """Texts with 33, 34 and more places of a shingle: copies with words between, without, behind decoys; and texts with hardly any."""
    rng = random.Random(13)
    out = [f"{PARA}. ", "very " * 200, f"{PARA} " * 40, f"{PARA} x {PARA}", "a b c d e f g h i j x a b c d e f g h i j", "nine words that are said twice here by me. " * 2]
    for n in (33, 34, 35, 80):
        out.append(" ".join(f"{PARA}, u{k}" for k in range(n)))
        out.append(" ".join(f"{PARA}, u{rng.randrange(3)}" for _ in range(n)))
        out.append(f"{PARA} . {walls(PARA.split(), 0, 'd', n)} then {PARA} end")
    return out + [" ".join(rng.choice("ab") for _ in range(900))]


def test_whole_repeats_try_every_earlier_place(spark, monkeypatch):
    from quillspark.functions import duplication
    from quillspark.operators import evidence

    rule = repeats.repeat_rule()
    data = [*enumerate(whole_texts()), (0, None), (2, whole_texts()[2])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = repeats.self_repeats(evidence.spread(df), whole=True).collect()
    monkeypatch.setattr(duplication, "TRIED", 10**9)
    want = []
    for d, t in data:
        runs = find_runs(tokenize(t or ""), rule.shingle_words, rule.min_run_words)
        want += [(d, False, r.earlier, r.later, r.length) for r in longest(runs, rule.max_reports)]
    assert sorted(want) == sorted((r.doc_id, r.capped, r.early, r.late, r.n) for r in got)
    assert len({d for d, *_ in want}) > 12


def test_the_query_of_repeats_caps_no_text(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([*enumerate(whole_texts())], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["verbatim_repeats"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} >= {1, 2} and not any(r.capped for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["verbatim_repeats"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("k, floor", [(2, 2), (3, 5), (8, 10)])
def test_the_whole_walk_equals_all_tries(k, floor, monkeypatch):
    from quillspark.functions import duplication

    monkeypatch.setattr(duplication, "TRIED", 10**9)
    rng, reported = random.Random(k), 0
    for _ in range(150):
        stems = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 16))) for _ in range(3)]
        text = " ".join(rng.choice((*stems, rng.choice("ab"), f"u{rng.randrange(40)}")) for _ in range(rng.randrange(60)))
        words = duplication.words_of(text)
        at = {}
        for i in range(len(words) - k + 1):
            at.setdefault(" ".join(words[i : i + k]), []).append(i)
        again = [(hash(h), i) for h, v in at.items() if len(v) > 1 for i in v]
        got = duplication.whole_runs(np.array([i for _, i in again], np.int64), np.array([h for h, _ in again], np.int64), k, floor)
        assert got == duplication.own_runs(text, k, floor), text
        reported += len(got)
    assert reported > 200
