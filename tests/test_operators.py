"""DataFrame operators against the kernel, and the registered queries against their SQL."""

import io
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from quillspark.catalog import load_rules
from quillspark.functions.scan import bundle_report, find, report
from quillspark.operators import evidence, native
from quillspark.plans import evidence as plans
from quillspark.plans.planted import LINES, planted
from quillspark.sources import InputTooLarge, read_documents, read_input

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    rows = list(enumerate([*LINES, "", None]))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("report", F.lit(1)).withColumn("f", F.lit(2))


def test_findings_match_the_kernel(lines):
    got = sorted((r.doc_id, r.rule_id, r.span_start, r.span_end, r.container) for r in evidence.findings(lines).collect())
    assert got == sorted((k, f.rule_id, f.start, f.end, f.container) for k, t in enumerate(LINES) for f in find(t))


def test_reports_cover_every_row(lines):
    got = {r.doc_id: r.report for r in evidence.analyze(lines).collect()}
    assert len(got) == len(LINES) + 2
    assert got[len(LINES) + 1].stats.byte_len == 0
    for k, t in enumerate(LINES):
        assert got[k].stats.word_count == report(t)["stats"]["word_count"]


def test_json_equals_the_library(lines):
    got = {r.doc_id: json.loads(r.report) for r in evidence.report_json(evidence.analyze(lines)).collect()}
    for k, t in enumerate(LINES):
        assert got[k] == report(t)


def test_native_terms_equal_kernel(lines):
    rules = [r for r in load_rules() if r.terms and not r.patterns]
    ids = [r.id for r in rules]
    a = native.merge_contained(native.term_hits(lines, rules))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, native.merged_hits(lines, rules).collect()))
    b = evidence.scan(lines).filter(F.col("rule_id").isin(ids))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_native_containers_equal_kernel(lines):
    hits = native.merge_contained(native.term_hits(lines, [r for r in load_rules() if r.terms and not r.patterns]))
    got = native.annotate_containers(hits, native.container_ranges(lines)).collect()
    want = {(k, f.rule_id, f.start): f.container for k, t in enumerate(LINES) for f in find(t)}
    assert got and all(want[r.doc_id, r.rule_id, r.s] == r.container for r in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for df in (evidence.findings(none), evidence.analyze(none), native.merge_contained(native.term_hits(none)), native.container_ranges(none)):
        assert df.count() == 0


def test_bundles_equal_the_library(spark):
    p = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, 0, "a", f"x {p} y"), (1, 1, "a", f"z {p}"), (1, 2, "c", "nothing"), (2, 0, "a", p), (3, 0, "a", None)]
    df = spark.createDataFrame(rows, "bundle_id long, file_idx int, path string, text string")
    reports, shared = evidence.analyze_bundle(df)
    assert reports.count() == 5
    got = [r.asDict(True) for r in shared.collect()]
    want = bundle_report([(r[2], r[3] or "") for r in rows if r[0] == 1])["cross_file_duplication"]
    assert len(got) == len(want) == 1 and got[0]["bundle_id"] == 1
    assert [[o["span"]["start"], o["span"]["end"]] for o in got[0]["occurrences"]] == [o["span"] for o in want[0]["occurrences"]]


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.streaming import analyze_stream

    src = str(tmp_path / "in")
    spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    query = analyze_stream(stream).writeStream.format("memory").queryName("reported").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")
    ).start()
    query.awaitTermination(120)
    assert spark.table("reported").count() == len(LINES)


def test_bundles_of_a_stream(spark, tmp_path):
    from quillspark.streaming import bundles_by_batch

    p = "one two three four five six seven eight nine ten eleven twelve"
    files = spark.createDataFrame([(1, 0, "a", f"x {p}"), (1, 1, "b", f"{p} y"), (2, 0, "c", p)], "bundle_id long, file_idx int, path string, text string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    seen = []
    writer = bundles_by_batch(stream, lambda reports, shared, k: seen.append((reports.count(), [(r.bundle_id, r.entry, len(r.occurrences)) for r in shared.collect()])))
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert seen == [(3, [(1, 1, 2)])]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("été")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"x" * 30)
    got = {os.path.basename(r.path): (r.status, r.text) for r in read_documents(spark, str(tmp_path), 20).collect()}
    assert got == {"a.txt": ("ok", "été"), "b.txt": ("not-utf8", None), "c.txt": ("too-large", None)}
    assert read_input(None, io.BytesIO(b"abc"), 3) == "abc"
    with pytest.raises(InputTooLarge):
        read_input(None, io.BytesIO(b"abcd"), 3)


def run_cli(*args, stdin=b""):
    return subprocess.run([sys.executable, "-m", "quillspark", *args], input=stdin, capture_output=True, cwd=os.path.dirname(entry_module.__file__))


def test_command_line(tmp_path):
    a, b, big = tmp_path / "a", tmp_path / "b", tmp_path / "big"
    a.write_text("He delves.")
    b.write_bytes(b"\xff")
    big.write_bytes(b"x" * (4 * 1024 * 1024 + 1))
    assert run_cli("--version").stdout.startswith(b"quillspark ")
    assert run_cli("--help").returncode == 0
    assert json.loads(run_cli(str(a)).stdout) == report("He delves.")
    assert json.loads(run_cli(stdin=b"He delves.").stdout) == report("He delves.")
    assert json.loads(run_cli("--allow-term", "delves", str(a)).stdout)["quality_patterns"][0]["topic_term"]
    assert len(json.loads(run_cli(str(a), str(a)).stdout)["files"]) == 2
    assert run_cli(str(b)).returncode == 1
    assert run_cli(str(tmp_path / "none")).returncode == 1
    assert run_cli("--nonsense").returncode == 1
    assert run_cli(str(big)).returncode == 40
    assert run_cli(stdin=big.read_bytes()).returncode == 40
    big.write_bytes(b"x" * (4 * 1024 * 1024))  # at the limit
    assert json.loads(run_cli(str(big)).stdout)["stats"]["byte_len"] == 4 * 1024 * 1024


def test_a_closed_pipe_is_no_error():
    cli = subprocess.Popen(
        [sys.executable, "-m", "quillspark"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=os.path.dirname(entry_module.__file__)
    )
    cli.stdin.write(b"very " * 60_000)
    cli.stdin.close()
    assert cli.stdout.read(1) == b"{"
    cli.stdout.close()
    assert cli.wait(120) == 0 and b"Traceback" not in cli.stderr.read()


def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_its_sql(spark, name):
    a = plans.QUERIES[name](spark, SF)
    con = duck(SF)
    b = con.sql(plans.oracles()[name])
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in a.collect())
    at = [b.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in b.fetchall())


def test_every_other_query_runs(spark):
    for name in set(plans.QUERIES) - set(plans.oracles()):
        assert plans.QUERIES[name](spark, SF).count() >= 0


def test_openers_match_known_counts(spark):
    got = plans.participial_openers(spark, SF)
    assert (got.count(), got.select("doc_id").distinct().count()) == (34, 24)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 200
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_planted_lines_fire(spark):
    assert planted(spark, SF).count() == 200


def test_every_rule_fires(spark):
    found = {r.rule_id for r in plans.all_findings(spark, SF).select("rule_id").distinct().collect()}
    assert found == {r.id for r in load_rules()}
    assert plans.bundle_passages(spark, SF).count() > 0 and plans.bundle_shingle_pairs(spark, SF).count() > 0


def test_some_rules_alone_give_the_same_hits(spark):
    whole = {tuple(r) for r in evidence.scan(planted(spark, SF)).collect()}
    for ids in (["SD-Q002"], ["SD-Q004", "SD-Q005"], [r.id for r in load_rules() if r.patterns]):
        got = {tuple(r) for r in evidence.scan(planted(spark, SF), rules=ids).collect()}
        assert got == {h for h in whole if h[1] in ids}


def test_rows_that_share_an_id_keep_their_lines(spark):
    rows = [(1, "a b\nc"), (1, "```\nd\n```"), (None, 'x "y" z'), (None, "# h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = native.line_table(df)
    assert lines.columns == ["doc_id", "k", "line", "s", "e"]
    assert sorted((r.line, r.s, r.e) for r in lines.collect()) == sorted(
        [("a b", 0, 3), ("c", 4, 5), ("```", 0, 3), ("d", 4, 5), ("```", 6, 9), ('x "y" z', 0, 7), ("# h", 0, 3)]
    )
    assert [tuple(r) for r in native.fenced_ranges(df).collect()] == [(1, 0, 9)]
    assert [tuple(r) for r in native.quote_ranges(df).collect()] == [(None, 2, 5)]


def test_control_characters_hide_nothing(spark):
    df = spark.createDataFrame([(1, "a \x01delve\x02 and\x01 delve")], "doc_id long, text string")
    got = sorted((r.s, r.e) for r in native.merge_contained(native.term_hits(df)).collect())
    assert got == sorted((r.s, r.e) for r in evidence.scan(df).collect()) and len(got) == 2


def test_table_function_takes_topic_terms(spark):
    from quillspark.functions.sql import register

    register(spark)
    rows = spark.sql("SELECT f.topic_term FROM VALUES ('they delve on') d(t), LATERAL text_findings(d.t, array('Delve')) f").collect()
    assert [r.topic_term for r in rows] == [True]
    assert spark.sql("SELECT * FROM text_findings('they delve on')").count() == 1
