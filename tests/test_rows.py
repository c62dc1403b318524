"""Scans within the row, against the kernel: containers, terms, code points, spaces, snippets; plans without exchange."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.catalog import load_rules
from quillspark.functions import containers as kernel_containers
from quillspark.functions import scan as kernel
from quillspark.functions.chars import Bytes
from quillspark.operators import rows
from quillspark.plans.planted import LINES

HARD = [
    "", "\n", "\n\n", "a", "a\r\nb\r\n", "```\ncode\n```\nmore\n```", "  ```\nopen", "> q\n # h\n#x\n", "A Title In Case\nnot a title.",
    'say "one" and "two""three"', 'open "here\n\n and "there"', 'odd " alone', '"a\n \t\nb" c', '"', '""', "“a” “b “c” d”", "“open\n\n“closed”",
    "”first “then”", "“a \"b” c\"", "mixed \"x “y\" z”", "“" * 50, '"' * 51, "“a\r\n\r\nb”", "é “ü” ‘x’ \"ß\"", "Of Mice And Men", "É Title", "x" * 61 + "\nY",
    "﻿bom", "a﻿b", "☀️ sun", "a️b", "😀‍😀", "😀️‍😀", "ك‍ك", "a‍b", "‍x", "x‍", "a​​b", "a​️b", "﻿﻿", "👩‍👩‍👧 f‍i", "ﾠ⁠⁠",
    "a b c d", "a b 1 2", "very very very", "more and more and more and more", "delve\x01into\x02 delves", "x\u0001\u0002​\u0003y",
    "Moreover, x. - Furthermore y", "•  moreover", "In today’s world", "dismoreover moreover_", "leverage " * 90, "\n".join(f"line {k} “q{k}” \"z\"" for k in range(300)),
]


def texts():
    rng = random.Random(4)
    bits = ['"', "“", "”", "\n", "\n\n", "> ", "# ", "```", "\n```\n", " ", "a", "Delve", "moreover", ". ", "é", "​", "️", "‍", "☀", "😀", "ك", " ", "Title Case Line", "\r\n", "\t", "very "]
    return [*LINES, *HARD, *("".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(250))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4).cache()


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_containers_equal_the_kernels(table):
    got = by_id(table.select("doc_id", rows.containers(F.col("text"))))
    for k, t in enumerate(texts()):
        at, want = Bytes(t), kernel_containers.container_ranges(t)
        for kind in kernel_containers.KINDS:
            mine = [(c.s, c.e) for c in got[k] if c.kind == kind]
            assert mine == [(at(s), at(e)) for s, e in want[kind]], (t, kind)


def test_container_of_every_place(table):
    places = table.select("doc_id", F.col("text").alias("t"), rows.containers(F.col("text")).alias("c")).filter("octet_length(t) < 200")
    got = by_id(places.select("doc_id", F.transform(rows.numbers(F.octet_length("t")), lambda p: rows.container_at(F.col("c"), p))))
    for k, t in enumerate(texts()):
        if k in got:
            where, at = kernel_containers.Classifier(t), Bytes(t)
            assert [got[k][at(i)] for i in range(len(t))] == [where(i) for i in range(len(t))], t


def kernel_hits(ids):
    scanner = kernel.scanner_of(tuple(sorted(ids)))
    out = []
    for t in texts():
        at = Bytes(t)
        out.append(sorted((scanner.rules[h.rule].id, at(h.start), at(h.end)) for h in scanner.scan(t)))
    return out


def test_terms_equal_the_kernels(table):
    rules = [r for r in load_rules() if r.terms and not r.patterns]
    got = by_id(table.select("doc_id", rows.merge_contained(rows.term_hits(F.col("text"), rules))))
    for k, want in enumerate(kernel_hits([r.id for r in rules])):
        assert [tuple(h) for h in got[k]] == want, texts()[k]


@pytest.mark.parametrize("id_", ["SD-R002", "SD-R003"])
def test_code_points_equal_the_kernels(table, id_):
    rule = next(r for r in load_rules() if r.id == id_)
    got = by_id(table.select("doc_id", rows.codepoint_hits(F.col("text"), rule)))
    for k, want in enumerate(kernel_hits([id_])):
        assert [tuple(h) for h in got[k]] == want, repr(texts()[k])
    assert id_ == "SD-R002" or sum(map(bool, got.values())) > 50


def test_spaces_equal_the_kernels(table):
    rule = next(r for r in load_rules() if r.mechanism == "positional-space")
    got = by_id(table.select("doc_id", rows.space_hits(F.col("text"), rule)))
    for k, want in enumerate(kernel_hits([rule.id])):
        assert [tuple(h) for h in got[k]] == want, repr(texts()[k])


def test_openers_equal_the_kernels(spark):
    rule = next(r for r in load_rules() if r.mechanism == "participial-opener")
    rng = random.Random(6)
    bits = ["Walking", "Being", "During", "Ing", "ALLing", "Sing", "walking", " ", " ", " on", ",", ", ", ". ", "\n- ", "\r", "é" * 30, "x" * 60, "!", "•", "\x01"]
    data = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + LINES + ["Walking on\rBeing there, x", f"Walking {'é' * 50}, x", f"Walking {'a' * 99}, x"]
    got = by_id(spark.createDataFrame(list(enumerate(data)), "k long, t string").select("k", rows.merge_contained(rows.opener_hits(F.col("t"), rule))))
    scanner, n = kernel.scanner_of((rule.id,)), 0
    for k, t in enumerate(data):
        at = Bytes(t)
        want = sorted((at(h.start), at(h.end)) for h in scanner.scan(t))
        assert [(h.s, h.e) for h in got[k]] == want, repr(t)
        n += len(want)
    assert n > 30


def test_tails_equal_the_kernels(spark):
    rule = next(r for r in load_rules() if r.mechanism == "contrastive-tail")
    rng = random.Random(12)
    bits = [", not ", ",never ", ", NOT\n", ", not         ", "an accident", "a plan", ". ", ".", "! ", "? ", ": ", "\n", ";", " you ", "your", "Keep ", "keep", "then ", "then use ", "It was a choice", "café",
            " e.g. x", "v1.2", " but ", "butter", "’", "don’t", "é" * 20, "x" * 45, "\ufffd", "  ", "\t", "The end.  and so", "\x01"]
    data = ["".join(rng.choice(bits) for _ in range(rng.randrange(2, 14))) for _ in range(4000)] + LINES
    data += [f"{'a' * n}, not b." for n in range(236, 246)] + [f"x. {'a' * n}, not b." for n in range(236, 244)] + [f"use {'a' * n}, not b." for n in range(230, 245)]
    data += [f"It is, not {'b' * n}." for n in range(55, 65)] + [f"It is, not {'é' * n}!" for n in range(27, 33)] + ["a, not b", ", not b.", "It is, not b.c d. E"]
    got = by_id(spark.createDataFrame(list(enumerate(data)), "k long, t string").repartition(4).select("k", rows.tail_hits(F.col("t"), rule)))
    scanner, n = kernel.scanner_of((rule.id,)), 0
    for k, t in enumerate(data):
        at = Bytes(t)
        want = sorted((at(h.start), at(h.end)) for h in scanner.scan_tails(t))
        assert sorted((h.s, h.e) for h in got[k]) == want, repr(t)
        n += len(want)
    assert n > 200


def test_reports_equal_the_kernels(table):
    """The whole nested report, on rules that need no Python."""
    from quillspark.operators import native

    ids = tuple(sorted(r.id for r in native.native_rules()))
    got = {r.doc_id: r.report.asDict(True) for r in native.reports(table, allow_terms=["Delve", "very"]).collect()}
    for k, t in enumerate(texts()):
        want = kernel.report(t, ["Delve", "very"], kernel.scanner_of(ids))
        for c in native.CATEGORIES:
            for f in want[c]:
                f["span"] = {"start": f["span"][0], "end": f["span"][1]}
        assert got[k] == want, repr(t)


def test_snippets_are_cut_at_characters(spark):
    rng = random.Random(8)
    data = []
    for k in range(300):
        t = "".join(rng.choice("aé中😀") for _ in range(150))
        s = rng.randrange(0, 60)
        data.append((k, t, s, rng.randrange(s, 151)))
    df = spark.createDataFrame([(k, t, Bytes(t)(s), Bytes(t)(e)) for k, t, s, e in data], "k long, t string, s long, e long")
    got = by_id(df.select("k", rows.snippet(F.col("t"), F.col("s"), F.col("e"))))
    assert all(got[k] == kernel.snippet(t, s, e)[0] for k, t, s, e in data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 129, 1000])
def test_prefix_sums(spark, n):
    (got,) = spark.range(1).select(rows.prefix_sums(F.transform(rows.numbers(F.lit(n)), lambda i: (i * 7 % 11).cast("long")))).first()
    want = [0]
    for i in range(n):
        want.append(want[-1] + i * 7 % 11)
    assert got == want


def test_no_exchange(table):
    rules = [r for r in load_rules() if r.terms]
    plan = table.sparkSession.createDataFrame([(1, "x")], "doc_id long, text string").select(
        rows.containers(F.col("text")), rows.term_hits(F.col("text"), rules)
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_very_long_texts(spark):
    """A megabyte of one line, of many lines, of quotes and of one term."""
    big = ["x" * 1_000_000, "ab\n" * 60_000, "“" * 100_000, '"' * 40_001, "very " * 20_000, "​" * 300_000]
    df = spark.createDataFrame(list(enumerate(big)), "doc_id long, text string").repartition(6)
    rules = [r for r in load_rules() if r.terms and not r.patterns]
    out = df.select("doc_id", F.size(rows.containers(F.col("text"))), F.size(rows.merge_contained(rows.term_hits(F.col("text"), rules)))).collect()
    got = {r[0]: r[1:] for r in out}
    assert got[0] == (0, 0) and got[2] == (0, 0) and got[3][0] == 1 and got[4] == (0, 20_000)
