"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
from quillspark.llm import jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_keeps_one_of_each_jaccard_group(spark):
    rng = random.Random(8)
    texts = [None, "", "a b", "A b", "a b c"]
    for n in (12, 40, 120, 300):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, 3, 4, 6):
                x = list(base)
                for _ in range(edits * n // 100 + (edits > 0)):
                    x[rng.randrange(n)] = f"v{rng.randrange(5000)}"
                texts.append(" ".join(x))
    hub = [f"h{k}" for k in range(60)]
    texts += [" ".join([*hub, f"end{k}"]) for k in range(50)]
    # the same frequent words in unlike texts
    texts += [" ".join([*hub[:20], *(f"u{rng.randrange(9000)}" for _ in range(30))]) for _ in range(50)]
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    changed = True
    links = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if sets[i] == sets[j] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    ]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted(set(least))


def test_no_index_of_the_pipeline_is_broadcast(spark, monkeypatch):
    """The joins by key and by element, whose rows the planner takes to be few, pass by the driver at its default."""
    plans = {}

    def written(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", written)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    df = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}") for k in range(40)], "doc_id long, text string")
    assert len(corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == 20
    joins = [x for name in ("ahead", "untried") for x in plans[name].splitlines() if "Join [key" in x or "Join [tok" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_a_group_of_near_copies_is_compared_in_proportion(spark, monkeypatch):
    """Copies with one or two other words: not every one is similar to a given one, but pairs don't grow with the square."""
    tried = []

    def written(df, name):
        out = keep(df, name)
        tried.extend([out.count()] if name == "untried" else [])
        return out

    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", written)
    rng, texts = random.Random(3), []
    for k in range(600):
        x = [f"w{j}" for j in range(130)]
        for j in range(1 + k % 2):
            x[rng.randrange(130)] = f"v{k}-{j}"
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, left, kept = [shingles(t) for t in texts], set(range(600)), []
    while left:
        kept.append(min(left))
        todo = [kept[-1]]
        left.discard(kept[-1])
        while todo:
            i = todo.pop()
            near = {j for j in left if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
            left -= near
            todo += near
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == kept
    assert sum(tried) <= 8 * len(texts)


def test_shuffle_files_go_with_their_query(spark):
    import time

    from quillspark.llm.common import shuffles_dropped

    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in blocks.mkString(" ").split() if x.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = spark.conf.get(name), files()
    with shuffles_dropped(spark):
        assert spark.range(1000).groupBy((jaccard.F.col("id") % 7).alias("k")).count().count() == 7
    end = time.time() + 10
    while files() - was and time.time() < end:
        time.sleep(0.1)
    assert not files() - was and spark.conf.get(name) == before


def test_the_stage_collects_what_the_driver_no_longer_uses(spark):
    """Old garbage of the driver's JVM, such as past queries leave, is gone after the stage, and its C library can be trimmed."""
    import gc

    from quillspark.llm import common

    jvm = spark.sparkContext._jvm
    box = jvm.java.util.ArrayList()
    seen = jvm.java.lang.ref.WeakReference(box)
    jvm.System.gc()  # the box is old from now on
    assert seen.get() is not None
    del box
    gc.collect()
    df = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}") for k in range(8)], "doc_id long, text string")
    assert len(corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == 4
    assert seen.get() is None
    assert common.trim_driver(spark) in (True, False)
