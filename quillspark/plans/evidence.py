"""Queries of the evidence report, one for each of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.catalog import Rule, load_rules, patterns_table, rules_table, terms_table
from quillspark.operators import evidence, native
from quillspark.functions.containers import SMALL_WORDS
from quillspark.operators.repeats import self_repeats
from quillspark.plans import repeats
from quillspark.plans.planted import PASSAGE, planted, planted_sql

_XID = r"[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\x{B7}\x{387}\x{1369}-\x{1371}\x{19DA}\x{200C}\x{200D}\x{2118}\x{212E}\x{30FB}\x{FF65}]"


def _rules(mechanism: str) -> list[Rule]:
    return [r for r in load_rules() if r.mechanism == mechanism]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as bundles of their turns; in every third one the turns share a planted passage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        F.col("conv_id").alias("bundle_id"), F.col("turn").alias("file_idx"), F.col("role").alias("path"),
        F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(text, F.lit("\n" + PASSAGE))).otherwise(text).alias("text"),
    )


def _term_rules() -> list[Rule]:
    return [r for r in load_rules() if r.terms]


# --- queries ---


def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = terms_table(spark).groupBy("rule_id").agg(F.count("*").alias("n_terms"))
    patterns = patterns_table(spark).groupBy("rule_id").agg(F.count("*").alias("n_patterns"))
    both = rules_table(spark).join(terms, "rule_id", "left").join(patterns, "rule_id", "left")
    return both.select(
        "rule_id", "name", "category", "class", "mechanism",
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"),
    )


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id", native.word_count("text").alias("word_count"), native.byte_len("text").alias("byte_len")
    )


def word_set_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.merged_hits(planted(spark, sf_dir), _term_rules())


def codepoint_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in _rules("codepoint") if not r.exempt_leading_bom)
    return native.codepoint_hits(planted(spark, sf_dir), rule)


def typographic_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.space_counts(planted(spark, sf_dir), _rules("positional-space")[0])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.line_table(planted(spark, sf_dir))


def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.fenced_ranges(planted(spark, sf_dir))


def blockquotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.blockquote_ranges(planted(spark, sf_dir))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.heading_ranges(planted(spark, sf_dir))


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.quote_ranges(planted(spark, sf_dir))


def annotated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.annotated_hits(planted(spark, sf_dir), _term_rules())


def term_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native.densities(planted(spark, sf_dir), _term_rules())
    return out.withColumns({c: F.round(c, 6) for c in ("per_1k_words", "residual_per_1k_words")})


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = native.rule_dimension(word_set_hits(spark, sf_dir))
    return hits.groupBy("category", "rule_id").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


def invisible_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible code points, but for byte order marks, selectors and joiners where orthography has them."""
    rule = next(r for r in _rules("codepoint") if r.exempt_leading_bom)
    return native.codepoint_hits(planted(spark, sf_dir), rule)


def contrastive_tail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive tails alone, without their rule's patterns."""
    return native.tail_hits(planted(spark, sf_dir), _rules("contrastive-tail")[0]).select("doc_id", "s", "e")


def native_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every rule that needs no Python, as the kernel reports them."""
    return native.findings(evidence.spread(planted(spark, sf_dir)))


def native_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's whole report of those rules: its nested lists written out by category, its counts and densities."""
    report = native.reports(evidence.spread(planted(spark, sf_dir)))
    r = F.col("report")

    def written(f):
        span = F.concat_ws("-", f["span"]["start"].cast("string"), f["span"]["end"].cast("string"))
        return F.concat_ws("|", f["rule_id"], span, f["container"], f["snippet"])

    lists = [F.array_join(F.transform(r[c], written), "\n").alias(c) for c in native.CATEGORIES]
    dense = []
    for c in native.CLASSES:
        d = r["stats"]["densities"][c]
        dense += [d[n].alias(f"{c}_{n}") for n in ("hits", "residual_hits")]
        dense += [F.round(d[n], 6).alias(f"{c}_{n}") for n in ("per_1k_words", "residual_per_1k_words")]
    return report.select("doc_id", *lists, r["stats"]["word_count"].alias("word_count"), r["stats"]["byte_len"].alias("byte_len"), *dense)


def participial_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan(_documents(spark, sf_dir), rules=["SD-Q002"]).select("doc_id", "s", "e")


def kernel_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [r.id for r in _rules("word-set") if not r.patterns]
    return evidence.scan(planted(spark, sf_dir), rules=ids)


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.findings(planted(spark, sf_dir))


def topic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.findings(planted(spark, sf_dir), allow_terms=["Delve", "tapestry"])
    return found.groupBy("rule_id", "topic_term", "container").count()


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.analyze(planted(spark, sf_dir)).drop("text")


def reports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.report_json(reports(spark, sf_dir))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan(planted(spark, sf_dir), rules=[r.id for r in load_rules() if r.patterns])


def self_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within each text as findings: by relations, and by the kernel where a walk is capped."""
    return evidence.duplication_findings(_documents(spark, sf_dir))


def verbatim_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's repeats with their words' numbers, every earlier place of a shingle tried: no walk is capped."""
    return self_repeats(evidence.spread(_documents(spark, sf_dir)), whole=True)


def contrastive_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.findings(planted(spark, sf_dir), rules=["SD-Q004"])


def bundle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.analyze_bundle(_files(spark, sf_dir))[0].drop("text")


def bundle_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every passage that a bundle's files share, by entry."""
    shared = evidence.analyze_bundle(_files(spark, sf_dir))[1]
    each = shared.select("bundle_id", "entry", "snippet", "snippet_truncated", F.posexplode("occurrences").alias("occurrence", "o"))
    return each.select(
        "bundle_id", "entry", "snippet", "snippet_truncated", "occurrence",
        F.col("o.path").alias("path"), F.col("o.span.start").alias("span_start"), F.col("o.span.end").alias("span_end"), F.col("o.container").alias("container"),
    )


def bundle_shingle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return evidence.shared_shingle_pairs(files)


def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.functions.sql import register

    register(spark)
    evidence.spread(planted(spark, sf_dir)).createOrReplaceTempView("quillspark_planted")
    return spark.sql(
        "SELECT d.doc_id, f.rule_id, f.span_start, f.span_end FROM quillspark_planted d, LATERAL text_findings(d.text) f"
    )


QUERIES = {
    f.__name__: f
    for f in (
        reports, catalog_rules, text_stats, word_set_hits, codepoint_hits, typographic_spaces, lines, fenced_code,
        blockquotes, headings, quotations, annotated_hits, term_densities, category_totals, participial_openers,
        kernel_word_sets, all_findings, topic_findings, reports_json, pattern_hits, self_duplication, verbatim_repeats,
        invisible_characters, contrastive_tail_hits, native_findings, native_reports, contrastive_tails, bundle_reports, bundle_passages, bundle_shingle_pairs, sql_table_function,
    )
}


# --- the same in DuckDB ---


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _catalog_sql() -> str:
    rows = ", ".join(
        f"({_q(r.id)}, {_q(r.name)}, {_q(r.category)}, {_q(r.cls) if r.cls else 'NULL'}, {_q(r.mechanism)}, {len(r.terms)}, {len(r.patterns)})"
        for r in load_rules()
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(rule_id, name, category, class, mechanism, n_terms, n_patterns)"


def _text_stats_sql() -> str:
    return (
        f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_XID}+')) AS BIGINT) AS word_count, "
        "CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_len FROM documents"
    )


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hits_sql(rules: list[Rule]) -> str:
    """CTEs that end in ``hits(doc_id, rule_id, s, e)``, merged."""
    terms = ", ".join(
        f"({_q(r.id)}, {_q(t.lower() if r.case == 'insensitive' and t.isascii() else t)}, {r.case == 'insensitive'},"
        f" {r.boundary == 'word'}, {r.position == 'block-start'})"
        for r in rules
        for t in r.terms
    )
    exempt = ", ".join(f"({_q(r.id)}, {_q(p)})" for r in rules for p in r.exemptions)
    return f"""
terms(rule_id, term, ci, word, block) AS (VALUES {terms}),
exempt(rule_id, phrase) AS (VALUES {exempt}),
texts AS (SELECT doc_id, text, {_FOLD.format('text')} AS low FROM planted),
pairs AS (
  SELECT doc_id, rule_id, term, word, block, text, low, CASE WHEN ci THEN low ELSE text END AS hay
  FROM texts JOIN terms ON contains(CASE WHEN ci THEN low ELSE text END, term)
),
cand AS (
  SELECT *, instr(hay, term) AS p FROM pairs
  UNION ALL
  SELECT doc_id, rule_id, term, word, block, text, low, hay, p + instr(substr(hay, p + 1), term) FROM cand WHERE instr(substr(hay, p + 1), term) > 0
),
bounded AS (
  SELECT doc_id, rule_id, p, length(term) AS n, text, low, strlen(left(text, p - 1)) AS s, strlen(left(text, p - 1)) + strlen(term) AS e FROM cand
  WHERE (NOT word OR (NOT regexp_matches(text[p - 1:p - 1], '{_XID}') AND NOT regexp_matches(text[p + length(term):p + length(term)], '{_XID}')))
    AND (NOT block OR regexp_matches(left(text, p - 1), '(?:\\A|[\\n\\r.!?])[ \\t\\-*•]*\\z'))
),
raw AS (
  SELECT DISTINCT doc_id, rule_id, s, e FROM bounded b WHERE NOT EXISTS (
    SELECT 1 FROM exempt x WHERE x.rule_id = b.rule_id
      AND len(list_filter(range(greatest(1, b.p - 60), b.p + 1), lambda i: substr(b.low, i, length(x.phrase)) = x.phrase AND i + length(x.phrase) >= b.p + b.n)) > 0)
),
hits AS (
  SELECT doc_id, rule_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id, rule_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM raw)
  WHERE reached IS NULL OR e > reached
)"""


_LINES_SQL = """
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS k, strlen(text) AS size FROM planted
),
placed AS (
  SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM raw_lines
),
lines AS (
  SELECT doc_id, k, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line, CAST(s AS BIGINT) AS s, size FROM placed WHERE s < size
),
spans AS (SELECT doc_id, CAST(k AS INTEGER) AS k, line, s, CAST(s + strlen(line) AS BIGINT) AS e, CAST(size AS BIGINT) AS size FROM lines)
"""

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _containers_sql(table: str = "planted") -> str:
    """CTEs of the lines and containers of ``table(doc_id, text)``."""
    small = ", ".join(map(_q, SMALL_WORDS))
    upper = r"^[\p{Lu}0-9]"
    return f"""{_LINES_SQL.replace('planted', table)},
fences AS (
  SELECT doc_id, s, coalesce(close, size) AS e FROM (
    SELECT *, row_number() OVER w AS n, lead(e) OVER w AS close FROM spans WHERE regexp_matches(line, '^{_WS}*```') WINDOW w AS (PARTITION BY doc_id ORDER BY k))
  WHERE n % 2 = 1
),
quotes AS (SELECT doc_id, s, e FROM spans WHERE regexp_matches(line, '^{_WS}*>')),
bodies AS (SELECT *, regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', '') AS body FROM spans),
heads AS (
  SELECT doc_id, s, e FROM bodies WHERE body <> '' AND body[1] <> '>' AND (body[1] = '#' OR (
    strlen(body) <= 60 AND regexp_matches(body, '{upper}') AND body[-1] NOT IN ('.', '!', '?', ',', ';', ':')
    AND len(list_filter(string_split_regex(body, '{_WS}+'), lambda w: NOT (regexp_matches(w, '{upper}') OR {_FOLD.format('w')} IN ({small})))) = 0))
),
sessions AS (
  SELECT *, sum(CASE WHEN body = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS session FROM bodies
),
marks AS (
  SELECT doc_id, session, s + strlen(left(line, i - 1)) AS pos, line[i:i] AS mark FROM (
    SELECT doc_id, session, s, line, unnest(list_filter(range(1, length(line) + 1), lambda i: line[i:i] IN ('"', '“', '”'))) AS i FROM sessions WHERE regexp_matches(line, '["“”]'))
),
curly AS (
  SELECT doc_id, min(pos) FILTER (WHERE mark = '“') AS s, max(pos) FILTER (WHERE mark = '”') + 3 AS e FROM (
    SELECT *, coalesce(sum(CASE WHEN mark = '”' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
    FROM marks WHERE mark <> '"')
  GROUP BY doc_id, session, turn
),
straight AS (
  SELECT doc_id, pos AS s, close + 1 AS e FROM (
    SELECT *, row_number() OVER w AS n, lead(pos) OVER w AS close FROM marks WHERE mark = '"' WINDOW w AS (PARTITION BY doc_id, session ORDER BY pos))
  WHERE n % 2 = 1 AND close IS NOT NULL
  UNION ALL SELECT doc_id, s, e FROM curly WHERE s IS NOT NULL AND e IS NOT NULL
),
reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM straight),
islands AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM reach),
quoted AS (SELECT doc_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM islands GROUP BY doc_id, island),
ranges AS (
  SELECT doc_id, 'fenced-code' AS kind, 0 AS rank, s, e FROM fences UNION ALL SELECT doc_id, 'blockquote', 1, s, e FROM quotes
  UNION ALL SELECT doc_id, 'quoted', 2, s, e FROM quoted UNION ALL SELECT doc_id, 'heading', 3, s, e FROM heads
)"""


def _annotated_sql(rules: list[Rule]) -> str:
    return f"""WITH RECURSIVE {planted_sql()}, {_hits_sql(rules)}, {_containers_sql()},
annotated AS (
  SELECT h.doc_id, h.rule_id, h.s, h.e, coalesce(arg_min(kind, rank), 'prose') AS container
  FROM hits h LEFT JOIN ranges r ON r.doc_id = h.doc_id AND r.s <= h.s AND h.s < r.e GROUP BY h.doc_id, h.rule_id, h.s, h.e
)"""


def _densities_sql(rules: list[Rule]) -> str:
    kinds = ", ".join(f"({_q(r.id)}, {_q(r.cls)})" for r in rules if r.cls)
    rate = "CASE WHEN word_count >= 100 THEN round({} * 1000.0::DOUBLE / word_count, 6) END"
    return f"""{_annotated_sql(rules)},
kinds(rule_id, class) AS (VALUES {kinds}),
words AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_XID}+')) AS BIGINT) AS word_count FROM planted),
grid AS (SELECT * FROM words, (VALUES ('spike'), ('background'), ('individual')) AS c(class)),
counts AS (
  SELECT doc_id, class, count(*) AS hits, count(*) FILTER (WHERE container = 'prose') AS residual_hits
  FROM annotated JOIN kinds USING (rule_id) GROUP BY doc_id, class
),
full_grid AS (SELECT doc_id, class, word_count, coalesce(hits, 0) AS hits, coalesce(residual_hits, 0) AS residual_hits FROM grid LEFT JOIN counts USING (doc_id, class))
SELECT *, {rate.format('hits')} AS per_1k_words, {rate.format('residual_hits')} AS residual_per_1k_words FROM full_grid"""


def _openers_ctes(table: str) -> str:
    """CTEs that end in ``openers(doc_id, s, e)``."""
    rule = _rules("participial-opener")[0]
    stop = ", ".join(_q(w) for w in sorted(rule.stoplist))
    start = r"[ \t\-*•]*\z"
    return rf"""
opener_marked AS (
  SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)), '([A-Z][a-z]*ing [^,.!?;:\n]+,)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM {table}
),
opener_pieces AS (SELECT doc_id, unnest(parts) AS piece, unnest(range(0, len(parts))) AS k FROM opener_marked),
opener_placed AS (
  SELECT doc_id, k, piece, replace(lag(piece) OVER w, chr(2), '') AS before,
    sum(strlen(replace(piece, chr(2), ''))) OVER w - strlen(replace(piece, chr(2), '')) AS s
  FROM opener_pieces WINDOW w AS (PARTITION BY doc_id ORDER BY k)
),
opener_found AS (
  SELECT *, string_split(piece, chr(2))[1] AS span, regexp_extract(piece, '^[A-Z][a-z]*ing') AS word FROM opener_placed WHERE k > 0
),
openers AS (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + strlen(span) AS BIGINT) AS e FROM opener_found
WHERE length(word) BETWEEN 5 AND 30 AND strlen(span) - length(word) - 2 < {rule.max_clause} AND lower(word) NOT IN ({stop})
  AND ((k = 1 AND regexp_matches(before, '(?:\A|[\n\r.!?]){start}')) OR regexp_matches(before, '[\n\r.!?]{start}')))
"""


def _characters_sql(rule: Rule) -> str:
    """CTEs that end in ``unseen(doc_id, s, e)``: characters one a row, orthographic uses left out, runs as islands."""
    from quillspark.functions.scan import JOINING, PICTOGRAPHS

    def within(c: str, ranges) -> str:
        return "(" + " OR ".join(f"{c} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")"

    # the character before, one selector aside
    base = "CASE WHEN b1 IN (65038, 65039) THEN b2 ELSE b1 END"
    joined = " OR ".join(f"({within(base, kind)} AND {within('a1', kind)})" for kind in (JOINING, PICTOGRAPHS))
    some = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in rule.ranges)
    return f"""
chars AS (
  SELECT doc_id, i, ch, unicode(ch) AS c, lag(unicode(ch)) OVER w AS b1, lag(unicode(ch), 2) OVER w AS b2, lead(unicode(ch)) OVER w AS a1,
    sum(strlen(ch)) OVER w AS e
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS i FROM planted WHERE regexp_matches(text, '[{some}]'))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
odd AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM chars
  WHERE {within('c', rule.ranges)} AND NOT (c = 65279 AND i = 0)
    AND NOT (c IN (65038, 65039) AND b1 IS NOT NULL AND NOT {within('b1', rule.ranges)})
    AND NOT coalesce(c IN (8204, 8205) AND b1 IS NOT NULL AND a1 IS NOT NULL AND ({joined}), FALSE)
),
unseen AS (SELECT doc_id, CAST(min(e - strlen(ch)) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM odd GROUP BY doc_id, island)"""


def _tails_sql() -> str:
    """CTEs that end in ``tails(doc_id, s, e)``: where a phrase closes and where its clause begins by lists of places."""
    rule = _rules("contrastive-tail")[0]
    alnum, white = r"\p{L}\p{N}\p{M}", _WS[1:-1]
    goes_on = rf"^(?:[{alnum}]|[ \t]{{1,8}}\p{{Ll}})"
    head = r",[ \t\n\r]{0,8}(?i:never|not)[ \t\n\r]{1,8}"
    stop, you = ", ".join(map(_q, sorted(rule.stoplist))), "|".join(w.replace("'", "''") for w in sorted(rule.second_person, key=len, reverse=True))
    return rf"""
tail_parts AS (SELECT doc_id, text, string_split(regexp_replace(translate(text, chr(1) || chr(2), chr(3) || chr(3)), '({head})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM planted WHERE regexp_matches(text, '{head}')),
commas AS (
  SELECT doc_id, replace(array_to_string(p[1:i], ''), chr(2), '') AS before, string_split(p[i + 1], chr(2))[1] AS head,
    replace(array_to_string(list_concat([array_to_string(string_split(p[i + 1], chr(2))[2:], '')], p[i + 2:]), ''), chr(2), '') AS rest
  FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM tail_parts)
),
closing AS (
  SELECT *, list_min(list_filter(range(1, {rule.max_np} + 2), lambda j: rest[j:j] IN ('!', '?') OR (rest[j:j] = '.' AND NOT regexp_matches(rest[j + 1:j + 12], '{goes_on}')))) AS close,
    list_min(list_filter(range(1, {rule.max_np} + 2), lambda j: regexp_matches(rest[j:j], '[;:,\n\x{{FFFD}}]'))) AS halt,
    list_max(list_filter(range(greatest(1, length(before) - {rule.clause_window}), length(before) + 1), lambda j: before[j:j] = chr(10)
      OR (before[j:j] IN ('!', '?', ':', '.') AND regexp_matches(before[j + 1:j + 1], '[{white}]') AND NOT (before[j:j] = '.' AND regexp_matches(before[j + 1:], '{goes_on}'))))) AS bound
  FROM commas
),
clauses AS (
  SELECT *, left(rest, close - 1) AS phrase, CASE WHEN bound IS NULL THEN before ELSE before[bound + 1:] END AS clause FROM closing
  WHERE close IS NOT NULL AND (halt IS NULL OR close < halt)
),
judged AS (
  SELECT *, CASE WHEN bound IS NULL THEN strlen(clause[2:]) ELSE strlen(clause) END >= {rule.clause_window} AS far, lower(clause) AS low, translate(lower(clause), '’', chr(39)) AS c
  FROM clauses WHERE regexp_matches(phrase, '[^{white}]') AND strlen(phrase) <= {rule.max_np} AND NOT regexp_matches(lower(phrase), '(?:^|[^{alnum}])but(?:$|[^{alnum}])')
),
tails AS (
  SELECT doc_id, CAST(strlen(before) AS BIGINT) AS s, CAST(strlen(before) + strlen(head) + strlen(phrase) + 1 AS BIGINT) AS e FROM judged
  WHERE far OR NOT (
    regexp_matches(low, '(?:^|[^{alnum}])(?:{you})(?:$|[^{alnum}])') OR regexp_extract(c, '[{alnum}'']+') IN ({stop})
    OR len(list_filter(string_split(c, ', ')[2:], lambda x: regexp_extract(x, '[{alnum}'']+') IN ({stop}))) > 0
    OR len(list_filter(range(2, len(string_split(c, 'then ')) + 1), lambda k: NOT regexp_matches(string_split(c, 'then ')[k - 1], '[{alnum}]$')
      AND regexp_extract(string_split(c, 'then ')[k], '[{alnum}'']+') IN ({stop}))) > 0)
)"""


def _native_findings_sql() -> str:
    """CTEs that end in ``findings``, of every rule that needs no Python."""
    rules = native.native_rules()
    one = {r.id: r for r in rules}
    plain = [r for r in rules if r.terms]
    points = [r for r in rules if r.mechanism == "codepoint"]
    unseen, cited = next(r for r in points if r.exempt_leading_bom), next(r for r in points if not r.exempt_leading_bom)
    space = next(r for r in rules if r.mechanism == "positional-space")
    opener = next(r for r in rules if r.mechanism == "participial-opener")
    kinds = ", ".join(f"({_q(r.id)}, {_q(r.category)}, {_q(r.cls) if r.cls else 'NULL'})" for r in one.values())
    spaces = ", ".join(_q(chr(c)) for c in space.codepoints)
    return f"""WITH RECURSIVE {planted_sql()}, {_hits_sql(plain)}, {_containers_sql()}, {_openers_ctes('planted')}, {_characters_sql(unseen)},
cited AS (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({_runs_sql(cited)})),
gaps AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, text FROM (
    SELECT doc_id, text, unnest(list_filter(range(2, length(text)), lambda i: text[i:i] IN ({spaces})
      AND regexp_matches(text[i - 1:i - 1], '[\\p{{L}}\\p{{Nl}}]') AND regexp_matches(text[i + 1:i + 1], '[\\p{{L}}\\p{{Nl}}]'))) AS i FROM planted WHERE regexp_matches(text, '[{"".join(chr(c) for c in space.codepoints)}]'))
),
every AS (
  SELECT doc_id, rule_id, s, e FROM hits UNION ALL SELECT doc_id, {_q(opener.id)}, s, e FROM openers UNION ALL SELECT doc_id, {_q(unseen.id)}, s, e FROM unseen
  UNION ALL SELECT doc_id, {_q(cited.id)}, s, e FROM cited
  UNION ALL SELECT doc_id, {_q(space.id)}, strlen(left(text, i - 1)), strlen(left(text, i)) FROM gaps WHERE n >= {space.min_count}
),
placed_hits AS (
  SELECT h.doc_id, h.rule_id, h.s, h.e, coalesce(arg_min(kind, rank), 'prose') AS container
  FROM every h LEFT JOIN ranges r ON r.doc_id = h.doc_id AND r.s <= h.s AND h.s < r.e GROUP BY h.doc_id, h.rule_id, h.s, h.e
),
kinds(rule_id, category, class) AS (VALUES {kinds}),
whole AS (SELECT h.*, decode(CAST(array_slice(encode(text), h.s + 1, h.e) AS BLOB)) AS said FROM placed_hits h JOIN planted USING (doc_id)),
findings AS (
  SELECT doc_id, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, rule_id, category, class,
    CASE WHEN strlen(said) <= 200 THEN said ELSE left(said, list_max(list_filter(range(0, 201), lambda n: strlen(left(said, n)) <= 200))) END AS snippet,
    e - s > 200 AS snippet_truncated, container, FALSE AS topic_term
  FROM whole JOIN kinds USING (rule_id)
)"""


def _runs_sql(rule: Rule) -> str:
    listed = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in rule.ranges)
    found = f"regexp_extract_all(text, '[{listed}]+|[^{listed}]+')"
    return f"""SELECT doc_id, e - strlen(piece) AS s, e FROM (
  SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest({found}) AS piece, unnest(range(1, len({found}) + 1)) AS k FROM planted)) WHERE regexp_matches(piece, '^[{listed}]')"""


def _native_reports_sql() -> str:
    lists = ", ".join(
        f"coalesce(string_agg(rule_id || '|' || span_start || '-' || span_end || '|' || container || '|' || snippet, chr(10) ORDER BY span_start, span_end, rule_id)"
        f" FILTER (WHERE category = '{c}'), '') AS {c}"
        for c in native.CATEGORIES
    )
    counts = ", ".join(
        f"count(*) FILTER (WHERE class = '{c}') AS {c}_hits, count(*) FILTER (WHERE class = '{c}' AND container = 'prose') AS {c}_residual_hits"
        for c in native.CLASSES
    )
    rates = ", ".join(
        f"CASE WHEN word_count >= 100 THEN round({c}_{n}hits * 1000.0::DOUBLE / word_count, 6) END AS {c}_{n}per_1k_words"
        for c in native.CLASSES for n in ("", "residual_")
    )
    return f"""{_native_findings_sql()},
words AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_XID}+')) AS BIGINT) AS word_count, CAST(strlen(text) AS BIGINT) AS byte_len FROM planted),
summed AS (SELECT w.doc_id, any_value(word_count) AS word_count, any_value(byte_len) AS byte_len, {lists}, {counts}
  FROM words w LEFT JOIN findings f ON f.doc_id = w.doc_id GROUP BY w.doc_id)
SELECT *, {rates} FROM summed"""


def _pairs_sql() -> str:
    return """
WITH words AS (
  SELECT conv_id AS bundle_id, turn AS file_idx,
    list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}\\p{Mn}\\p{Mc}''’]+'), lambda w: translate(lower(w), '’ς', '''σ')) AS w
  FROM (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'THE_PASSAGE' ELSE '' END AS text FROM conversations)
),
shingles AS (
  SELECT DISTINCT bundle_id, file_idx, array_to_string(w[i:i + 7], ' ') AS h
  FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
)
SELECT a.bundle_id, a.file_idx AS a, b.file_idx AS b, count(*) AS n
FROM shingles a JOIN shingles b ON a.bundle_id = b.bundle_id AND a.h = b.h AND a.file_idx < b.file_idx GROUP BY ALL
""".replace("THE_PASSAGE", PASSAGE)


def oracles() -> dict[str, str]:
    """SQL by query; the rest is tested against brute force."""
    words = [r for r in load_rules() if r.terms]
    plain = [r for r in words if not r.patterns]
    cp = next(r for r in _rules("codepoint") if not r.exempt_leading_bom)
    seen = next(r for r in _rules("codepoint") if r.exempt_leading_bom)
    space = _rules("positional-space")[0]
    cps = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in cp.ranges)
    spaces = "".join(f"\\x{{{c:X}}}" for c in space.codepoints)
    head = f"WITH RECURSIVE {planted_sql()}"
    lines_ = f"{head}, {_containers_sql()}"
    cats = ", ".join(f"({_q(r.id)}, {_q(r.category)})" for r in words)
    return {
        "catalog_rules": _catalog_sql(),
        "text_stats": _text_stats_sql(),
        "word_set_hits": f"{head}, {_hits_sql(words)} SELECT * FROM hits",
        "kernel_word_sets": f"{head}, {_hits_sql(plain)} SELECT * FROM hits",
        "codepoint_hits": f"""{head},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{cps}]+|[^{cps}]+')) AS piece, unnest(range(1, len(regexp_extract_all(text, '[{cps}]+|[^{cps}]+')) + 1)) AS k FROM planted),
ends AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM runs)
SELECT doc_id, {_q(cp.id)} AS rule_id, CAST(e - strlen(piece) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ends WHERE regexp_matches(piece, '^[{cps}]')""",
        "typographic_spaces": f"""{head},
counted AS (SELECT doc_id, len(list_filter(range(2, length(text)), lambda i: regexp_matches(text[i:i], '[{spaces}]')
  AND regexp_matches(text[i - 1:i - 1], '[\\p{{L}}\\p{{Nl}}]') AND regexp_matches(text[i + 1:i + 1], '[\\p{{L}}\\p{{Nl}}]'))) AS n FROM planted WHERE regexp_matches(text, '[{spaces}]'))
SELECT doc_id, {_q(space.id)} AS rule_id, CAST(n AS BIGINT) AS n FROM counted WHERE n >= {space.min_count}""",
        "lines": f"{lines_} SELECT doc_id, k, line, s, e FROM spans",
        "fenced_code": f"{lines_} SELECT doc_id, s, e FROM fences",
        "blockquotes": f"{lines_} SELECT doc_id, s, e FROM quotes",
        "headings": f"{lines_} SELECT doc_id, s, e FROM heads",
        "quotations": f"{lines_} SELECT doc_id, s, e FROM quoted",
        "annotated_hits": f"{_annotated_sql(words)} SELECT * FROM annotated",
        "term_densities": _densities_sql(words),
        "category_totals": f"{head}, {_hits_sql(words)}, cats(rule_id, category) AS (VALUES {cats}) "
        "SELECT category, rule_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits JOIN cats USING (rule_id) GROUP BY category, rule_id",
        "participial_openers": f"WITH {_openers_ctes('documents')} SELECT * FROM openers",
        "invisible_characters": f"{head}, {_characters_sql(seen)} SELECT doc_id, {_q(seen.id)} AS rule_id, s, e FROM unseen",
        "contrastive_tail_hits": f"{head}, {_tails_sql()} SELECT doc_id, s, e FROM tails",
        "native_findings": f"{_native_findings_sql()} SELECT * FROM findings",
        "native_reports": _native_reports_sql(),
        "bundle_shingle_pairs": _pairs_sql(),
        "verbatim_repeats": repeats.repeats_sql(_containers_sql("docs")),
        "bundle_passages": repeats.passages_sql(_containers_sql("texts_of")),
    }
