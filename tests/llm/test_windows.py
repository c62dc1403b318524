"""Packing into windows: every id once, no padding, the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm.window_packing import CAPACITY, ByteIds, OpenWindows, best_fit_decreasing, fill_windows, pack_into_windows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_segment_tree_finds_the_tightest_window():
    rng, tree, rooms = random.Random(3), OpenWindows(100), []
    for w in range(400):
        if rooms and rng.random() < 0.4:
            room = rng.choice(rooms)
            tree.take(room)
            rooms.remove(room)
        else:
            rooms.append(rng.randrange(1, 101))
            tree.add(w, rooms[-1])
        size = rng.randrange(1, 101)
        assert tree.tightest(size) == min((r for r in rooms if r >= size), default=None)


def test_best_fit_decreasing_is_the_plain_loop():
    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randrange(1, 64) for _ in range(rng.randrange(0, 80))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 64) - s)
        got = best_fit_decreasing(sizes, 64)
        assert sorted(64 - sum(sizes[i] for i in b) for b in got) == sorted(rooms)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))


@pytest.mark.parametrize("last", [True, False])
def test_filled_windows_hold_each_token_once(last):
    rng = random.Random(7)
    for _ in range(40):
        sizes = [rng.choice((1, 2, rng.randrange(1, 64))) for _ in range(rng.randrange(0, 90))]
        kept, loose = fill_windows(sizes, 64, last)
        places = sorted((i, a, z) for w in [*kept, loose] for i, a, z in w)
        for i, n in enumerate(sizes):
            mine = [(a, z) for j, a, z in places if j == i]
            assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
        fills = [sum(z - a for _, a, z in w) for w in kept]
        rest = sum(sizes) % 64
        assert fills == [64] * (sum(sizes) // 64) + ([p for p in (32, 16, 8, 4, 2, 1) if rest & p] if last else [])
        assert sum(z - a for _, a, z in loose) == (0 if last else rest)


def check(rows, docs):
    """Each document's ids lie in its parts, once each, as the library gives them; sequences are gapless and unpadded."""
    library = Tokenizer.from_file(PATH)
    want = {}
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, []).append(ids)
    for d, all_ids in want.items():
        assert len({tuple(i) for i in all_ids}) == 1
        ids, parts = all_ids[0], sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        cover = np.zeros(len(ids), dtype=int)
        for start, length, crc in parts:
            assert length > 0 and crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            cover[start : start + length] += 1
        assert (cover == len(all_ids)).all() and {r.doc_tokens for r in rows if r.doc_id == d} == {len(ids)}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == CAPACITY or at & (at - 1) == 0 and at < CAPACITY
    total = sum(len(i) for x in want.values() for i in x)
    assert len(by) == total // CAPACITY + bin(total % CAPACITY).count("1")


def test_edge_texts(spark):
    rng = random.Random(11)
    words = "the of delve naïve 中文 don't x1 ,".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 30_000), (103, " " * 20_000 + "x"), (104, "end <|endoftext|> mark"), (None, "no id"), (None, "no id"), (2**60 + 1, "long id")]
    docs += [(105, "twice " * 300)] * 3 + [(106, "word " * (2 * CAPACITY - 1))]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as row", "3 as block")
    check(pack_into_windows(table.repartition(3), PATH).collect(), docs)


def test_many_blocks(spark, monkeypatch):
    import quillspark.llm.window_packing as w

    docs = [(k, f"w{k} " * (1 + (k * 37) % 260)) for k in range(300)]
    original = w.pack_windows
    monkeypatch.setattr(w, "pack_windows", lambda parts: original(parts, block_items=40))
    check(w.pack_into_windows(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect(), docs)


def test_empty_table(spark):
    assert pack_into_windows(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_quick_ids_are_the_librarys():
    got, library, rng = ByteIds(PATH), Tokenizer.from_file(PATH), random.Random(2)
    assert got.quick is not None
    for _ in range(300):
        text = "".join(chr(rng.choice((32, 10, 9, 39, 115, rng.randrange(33, 1200), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F300, 0x1F700)))) for _ in range(60))
        assert got.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in ("a" * 200_000, " " * 200_000 + "b", "\n" * 100_000, "é" * 50_000):
        assert got.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
