"""Scans and annotations that Catalyst runs itself: no Python in any of them, and no exchange where a row is enough.

What one text says is worked out within its row (:mod:`quillspark.operators.rows`);
here it becomes tables. ``doc_id`` need not tell documents apart where the
function takes documents; where it takes tables of hits and ranges it must.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.catalog import Rule, load_rules
from quillspark.functions.chars import JVM_WORD
from quillspark.functions.scan import DENSITY_FLOOR_WORDS
from quillspark.operators import rows
from quillspark.operators.rows import ascii_lower
from quillspark.operators.schemas import REPORT

CLASSES = ("spike", "background", "individual")
CATEGORIES = ("paste_residue", "quality_patterns", "injection_patterns")


def _text(col: str | Column) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def word_count(col: str | Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_count(_text(col), F.lit(JVM_WORD + "+")).cast("long")


def byte_len(col: str | Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(_text(col)).cast("long")


def _exploded(docs: DataFrame, id_col: str, text_col: str, of: Callable[[Column], Column]) -> DataFrame:
    """``doc_id`` and the fields of each struct that ``of(text)`` gives; a null text is empty."""
    two = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("t"))
    return two.select("doc_id", F.explode(of(F.col("t"))).alias("x")).select("doc_id", "x.*")


# --- hits -------------------------------------------------------------------------


def native_rules() -> list[Rule]:
    """The rules that need no Python: their mechanisms are all here, and they have no patterns."""
    kinds = ("word-set", "codepoint", "positional-space", "participial-opener")
    return [r for r in load_rules() if r.mechanism in kinds and not r.patterns]


def _with_hits(docs: DataFrame, rules: Iterable[Rule], id_col: str, text_col: str, placed: bool = False) -> DataFrame:
    """``(doc_id, t, hits)`` of rules of the mechanisms here, merged; with ``placed`` also the ``found`` containers of texts that have hits.

    Each step is a projection of its own, as the analyzer takes a round for every level of lambdas.
    """
    rules = list(rules)
    t, hits = F.col("t"), F.col("hits")
    parts = [rows.term_hits(t, [r for r in rules if r.terms])] if any(r.terms for r in rules) else []
    made = {"codepoint": rows.codepoint_hits, "positional-space": rows.space_hits, "participial-opener": rows.opener_hits}
    parts += [made[r.mechanism](t, r) for r in rules if r.mechanism in made]
    base = docs.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("t"))
    raw = base.select("doc_id", "t", (F.concat(*parts) if parts else F.array().cast(rows.HIT)).alias("hits"))
    merged = raw.select("doc_id", "t", rows.let(hits, rows.merge_contained).alias("hits"))
    return merged.withColumn("found", F.when(F.size(hits) > 0, rows.containers(t))) if placed else merged


def term_hits(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule_id, s, e)`` of the word-set rules' terms, exempt ones left out, before merging."""
    some = [r for r in rules or load_rules() if r.terms]
    return _exploded(docs, id_col, text_col, lambda t: rows.term_hits(t, some))


def merged_hits(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule_id, s, e)`` of rules of the mechanisms here (only the terms of those that have patterns too)."""
    return _with_hits(docs, rules, id_col, text_col).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def annotated_hits(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`merged_hits` with the ``container`` in which each hit begins."""
    both = _with_hits(docs, rules, id_col, text_col, placed=True)
    at = rows.let(F.col("found"), lambda c: F.transform("hits", lambda h: h.withField("container", rows.container_at(c, h["s"]))))
    return both.select("doc_id", F.explode(at).alias("h")).select("doc_id", "h.*")


def codepoint_hits(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule_id, s, e)`` of runs of a rule's code points, orthographic uses left out."""
    return _exploded(docs, id_col, text_col, lambda t: rows.codepoint_hits(t, rule))


def tail_hits(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule_id, s, e)`` of contrastive tails, without the rule's patterns."""
    return _exploded(docs, id_col, text_col, lambda t: rows.tail_hits(t, rule))


def space_counts(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rule_id, n)``: typographic spaces between letters, where there are enough."""
    chars = "".join(f"\\x{{{c:X}}}" for c in rule.codepoints)
    n = F.regexp_count(_text(text_col), F.lit(rf"(?<=\p{{IsAlphabetic}})[{chars}](?=\p{{IsAlphabetic}})"))
    return docs.select(F.col(id_col).alias("doc_id"), F.lit(rule.id).alias("rule_id"), n.cast("long").alias("n")).filter(
        F.col("n") >= rule.min_count
    )


def merge_contained(hits: DataFrame) -> DataFrame:
    """``(doc_id, rule_id, s, e)`` without hits that lie in another of the same document and rule; of hits that are a table already."""
    w = Window.partitionBy("doc_id", "rule_id").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    reached = hits.select("doc_id", "rule_id", "s", "e").withColumn("reached", F.max("e").over(w))
    return reached.filter(F.col("reached").isNull() | (F.col("e") > F.col("reached"))).drop("reached")


# --- lines and containers ------------------------------------------------------------


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, k, line, s, e)``: each line without its end, and its byte range."""
    return _exploded(docs, id_col, text_col, rows.lines)


def fenced_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, s, e)`` of fenced code: marker lines toggle, an open fence runs to the end."""
    return _exploded(docs, id_col, text_col, lambda t: rows.let(rows.lines(t), lambda x: rows.fenced(x, F.octet_length(t).cast("long"))))


def blockquote_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, s, e)`` of lines that begin with ``>``."""
    return _exploded(docs, id_col, text_col, lambda t: rows.blockquoted(rows.lines(t)))


def heading_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, s, e)`` of lines that begin with ``#`` or are short and in title case."""
    return _exploded(docs, id_col, text_col, lambda t: rows.headed(rows.lines(t)))


def quote_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, s, e)`` of straight and of curly double quotes in pairs, merged; a blank line ends all open ones."""
    return _exploded(docs, id_col, text_col, rows.quoted)


def container_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rank, kind, s, e)`` of every container; a lower rank takes precedence."""
    return _exploded(docs, id_col, text_col, rows.containers)


def annotate_containers(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """``hits`` with ``container``: the first kind whose range covers the hit's start; of tables that are there already.

    A range join that is an equi-join on the document, so it shuffles by
    document only and hits without any range stay.
    """
    keyed = hits.withColumn("hit", F.monotonically_increasing_id())
    r = ranges.select(F.col("doc_id").alias("rd"), "kind", "rank", F.col("s").alias("rs"), F.col("e").alias("re"))
    joined = keyed.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("rs") <= F.col("s")) & (F.col("s") < F.col("re")), "left")
    cols = hits.columns
    return joined.groupBy("hit", *cols).agg(F.coalesce(F.min_by("kind", "rank"), F.lit("prose")).alias("container")).select(*cols, "container")


# --- reports ------------------------------------------------------------------------


def rule_dimension(hits: DataFrame) -> DataFrame:
    """``hits`` with their rule's ``category`` and ``class``, by a broadcast join of the rule table."""
    from quillspark.catalog import rules_table

    rules = rules_table(hits.sparkSession).select("rule_id", "category", "class")
    return hits.join(F.broadcast(rules), "rule_id")


def _findings_of(rules: Iterable[Rule], allow_terms: Iterable[str] = ()) -> Column:
    """The columns ``t``, ``hits`` and ``found`` as findings, ordered by byte span and rule: category, class, snippet, container, topic term."""
    text = F.col("t")
    kind = lambda r: F.struct(F.lit(r.category).alias("category"), F.lit(r.cls).cast("string").alias("cls"))
    known = F.create_map(*(x for r in rules for x in (F.lit(r.id), kind(r))))
    allowed = sorted({a.lower() for a in allow_terms})

    def finding(found: Column, h: Column) -> Column:
        whole = F.decode(F.substring(F.encode(text, "utf-8"), h["s"].cast("int") + 1, (h["e"] - h["s"]).cast("int")), "utf-8")
        return F.struct(
            h["s"].alias("span_start"), h["e"].alias("span_end"), h["rule_id"].alias("rule_id"),
            F.element_at(known, h["rule_id"])["category"].alias("category"), F.element_at(known, h["rule_id"])["cls"].alias("class"),
            rows.snippet(text, h["s"], h["e"]).alias("snippet"), (h["e"] - h["s"] > rows.SNIPPET_BYTES).alias("snippet_truncated"),
            rows.container_at(found, h["s"]).alias("container"), (F.lower(whole).isin(allowed) if allowed else F.lit(False)).alias("topic_term"),
        )

    made = rows.let(F.col("found"), lambda c: F.array_sort(F.transform("hits", lambda h: finding(c, h))))
    return F.when(F.size("hits") > 0, made).otherwise(F.array().cast(_FINDINGS))


_FINDINGS = (
    "array<struct<span_start:bigint,span_end:bigint,rule_id:string,category:string,class:string,snippet:string,"
    "snippet_truncated:boolean,container:string,topic_term:boolean>>"
)


def findings(docs: DataFrame, rules: list[Rule] | None = None, allow_terms: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a finding of the rules that need no Python (or of those given)."""
    some = native_rules() if rules is None else rules
    both = _with_hits(docs, some, id_col, text_col, placed=True)
    return both.select("doc_id", F.explode(_findings_of(some, allow_terms)).alias("f")).select("doc_id", "f.*")


def _rate(n: Column, words: Column) -> Column:
    return F.when(words >= DENSITY_FLOOR_WORDS, n * 1000.0 / words)


def report_of(text: Column, found: Column) -> Column:
    """A text's whole report from its findings: nested lists by category, counts and densities; as the kernel's."""

    def listed(fs: Column, category: str) -> Column:
        def one(f: Column) -> Column:
            span = F.struct(f["span_start"].alias("start"), f["span_end"].alias("end"))
            return F.struct(f["rule_id"], span.alias("span"), *(f[c] for c in ("snippet", "snippet_truncated", "container", "topic_term")))

        return F.transform(F.filter(fs, lambda f: f["category"] == category), one)

    def density(fs: Column, words: Column, cls: str) -> Column:
        mine = F.filter(fs, lambda f: f["class"] == cls)
        hits = F.size(mine).cast("long")
        left = F.size(F.filter(mine, lambda f: (f["container"] == "prose") & ~f["topic_term"])).cast("long")
        return F.struct(
            hits.alias("hits"), left.alias("residual_hits"), _rate(hits, words).alias("per_1k_words"), _rate(left, words).alias("residual_per_1k_words")
        )

    def whole(fs: Column, words: Column) -> Column:
        densities = F.struct(*(density(fs, words, c).alias(c) for c in CLASSES))
        stats = F.struct(words.alias("word_count"), byte_len(text).alias("byte_len"), densities.alias("densities"))
        return F.struct(*(listed(fs, c).alias(c) for c in CATEGORIES), stats.alias("stats"))

    return rows.let(found, lambda fs: rows.let(word_count(text), lambda n: whole(fs, n))).cast(REPORT)


def reports(docs: DataFrame, rules: list[Rule] | None = None, allow_terms: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, report)``: the report of the rules that need no Python (or of those given), one for every row.

    A null text is an empty one; a text without findings has empty lists and its
    counts. One narrow projection: no exchange, no join, no Python.
    """
    some = native_rules() if rules is None else rules
    both = _with_hits(docs, some, id_col, text_col, placed=True).select("doc_id", "t", _findings_of(some, allow_terms).alias("fs"))
    return both.select("doc_id", report_of(F.col("t"), F.col("fs")).alias("report"))


def densities(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class, word_count, hits, residual_hits, per_1k_words, residual_per_1k_words)``: a row for each text and class, within the row."""
    report = reports(docs, rules, (), id_col, text_col)
    stats = F.col("report.stats")
    each = F.array(*(F.struct(F.lit(c).alias("class"), stats["densities"][c].alias("d")) for c in CLASSES))
    return report.select("doc_id", stats["word_count"].alias("word_count"), F.explode(each).alias("x")).select(
        "doc_id", "x.class", "word_count", "x.d.hits", "x.d.residual_hits", "x.d.per_1k_words", "x.d.residual_per_1k_words"
    )
