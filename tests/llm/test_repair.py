"""Conversation repair: exact against every possible edit, however it is cut up, and against SQL."""

import itertools
import random

import duckdb
import pytest

from quillspark.llm import repair as r
from quillspark.llm.queries import ORACLE_SQL


def brute(symbols):
    """The least (cost, letters) over every choice of edits, with up to two insertions before and after each turn."""
    best = None
    inserted = ["", "I", "II"]
    for gaps in itertools.product(inserted, repeat=len(symbols) + 1):
        for letters in itertools.product("KRD", repeat=len(symbols)):
            cost, roles, audit = 0, [], ""
            for k in range(len(symbols) + 1):
                roles += ["?"] * len(gaps[k])
                cost += 2 * len(gaps[k])
                audit += gaps[k]
                if k == len(symbols):
                    break
                s, letter = symbols[k], letters[k]
                if letter != "D" and s == "x" or letter == "K" and s.lower() == "o":
                    cost = None
                    break
                audit += letter
                cost += {"K": 0, "R": 2, "D": 3}[letter] + (s.isupper() and letter != "D")
                if letter != "D":
                    roles.append(s.lower() if letter == "K" else "?")
            if cost is None:
                continue
            rest = roles[1:] if roles[:1] == ["s"] else roles
            if all(x in ("?", "ua"[k % 2]) for k, x in enumerate(rest)) and len(rest) % 2 == 0 and (rest or not roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_shortest_path_is_the_best_of_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for symbols in ["".join(rng.choice("suaoSUAOx") for _ in range(n)) for _ in range(40)]:
            assert r.accepted(r.distances(symbols, r.START)) == brute(symbols), symbols


def test_stretches_multiply():
    rng = random.Random(2)
    for n in (5, 63, 64, 65, 700):
        symbols = "".join(rng.choice("suauauAUox") for _ in range(n))
        whole = r.accepted(r.distances.__wrapped__(symbols, r.START))
        stretch = r.Stretch()
        for s in symbols:
            stretch.add(s)
        assert stretch.cheapest() == whole
        cut = rng.randrange(n)
        assert r.accepted(r.product(r.matrix(symbols[:cut]), r.matrix(symbols[cut:]))[r.START]) == whole


CASES = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And then?"), (1, 3, "assistant", "No end"),
    (2, 0, "system", "Rules."), (2, 1, "assistant", "Hi!"), (2, 5, "assistant", "Hi!"), (2, 6, "tool", "data."),
    (3, None, "user", None), (3, None, None, "x."), (3, None, "", ""), (4, 0, "assistant", "\t\n "),
    (None, 1, "user", "a."), (None, None, "assistant", "b."), (5, 1, "user", "Tie b."), (5, 1, "user", "Tie a."), (5, 1, "assistant", "Tie."),
    (6, 3, "user", "twice."), (6, 3, "user", "twice."), (6, 3, "user", "twice."), (7, 9, "sys", "one  .  \n"), (7, 10, "u", "two\x0b!\x0c"),
    (8, 0, "user", "é" * 50_000 + "."), (8, 1, "assistant", "non-breaking.\xa0"),
]


def rows(seed, n=600):
    rng = random.Random(seed)
    out = list(CASES)
    for k in range(n):
        conv = 100 if rng.random() < 0.4 else rng.randrange(20, 90)
        role = rng.choice(("user", "assistant", "assistant", "user", "system", "other"))
        out.append((conv, rng.choice((None, *range(200))), role, rng.choice(("Same.", "Open", "Why?", f"Turn {k}!", " ", "x y.\n"))))
    return out


def oracle(table):
    con = duckdb.connect()
    con.register("conversations", table)
    got = con.sql(ORACLE_SQL["op12_conversation_repair"])
    return sorted(map(repr, got.select("conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256").fetchall()))


@pytest.mark.parametrize("partitions", [1, 23])
def test_against_sql(spark, partitions):
    data = spark.createDataFrame(rows(partitions), "conv_id long, turn long, role string, text string")
    want = oracle(data.toArrow())
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        more = data.selectExpr("*", "1 as h", "2 as place", "3 as report", "4 as gone", "5 as copy")
        got = r.with_digests(r.repair(r.damaged(more.repartition(5)))).collect()
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), before):
            spark.conf.set(name, value)
    assert sorted(repr(tuple(x)) for x in got) == want
    assert len({x.conv_id for x in got}) == len(got)


def test_turns_obey_the_grammar(spark):
    data = spark.createDataFrame(rows(9, 200), "conv_id long, turn long, role string, text string")
    done = r.repair(r.as_rows(data))
    by = {}
    for t in sorted(done.turns.collect(), key=lambda t: t.place):
        by.setdefault(t.conv_id, []).append(t)
    for turns in by.values():
        initials = "".join(t.role[0] for t in turns)
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and rest
        assert [t.place for t in turns] == list(range(len(turns)))
        kept = [(t.role, t.text) for t in turns if t.edit == "K"]
        assert len(set(kept)) == len(kept)
    assert {x.conv_id for x in done.reports.collect()} == {x[0] for x in data.select("conv_id").distinct().collect()}


def test_empty_table_and_all_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert r.with_digests(r.repair(r.damaged(empty))).collect() == []
    import zlib

    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (one,) = r.with_digests(r.repair(r.damaged(spark.createDataFrame([(gone, 0, "user", "a.")], empty.schema)))).collect()
    assert (one.gaps, one.blank, one.illegal, one.cost, one.audit) == (0, 0, 0, 0, "")
    assert one.repaired_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
