"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import licenses, line_dedup, url_filter
from quillspark.llm.byte_bpe import encode_decode
from quillspark.llm.digest import edited_fingerprints
from quillspark.llm.embed_forest import embedding_near_duplicates
from quillspark.llm.lexical import K, ranked_search
from quillspark.llm.packing import pack_documents
from quillspark.llm.repair import damaged, repair, with_digests
from quillspark.llm.simhash import simhash_near_duplicates
from quillspark.llm.token_counts import token_counts
from quillspark.llm.toxicity import toxicity_scores
from quillspark.llm.url_filter import filter_urls
from quillspark.llm.window_packing import pack_into_windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are boilerplate of their source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence sentences of each document, and the licences and categories that they make."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the component of fingerprints within three bits that it is in."""
    return simhash_near_duplicates(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links of cosine 0.98 or more within its label, and its component."""
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path and verdict, by the listed rules or its host's path templates."""
    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score, learnt from the rows that are not held out."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness to it and to the next document."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 ids as the islands find; only longer ones are cut."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes and tokens, and whether these are over the limit."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged in a known way and repaired; the repaired turns as a digest."""
    return with_digests(repair(damaged(_table(spark, sf_dir, "conversations"))))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids: full ones, and at the end some of a power of two."""
    return pack_into_windows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}

_OP1_SQL = f"""
WITH pages AS (
  SELECT doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents
), totals AS (SELECT host, count(*) AS n_pages FROM pages GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_transform(coalesce(lines, []), lambda x: trim(x)))) AS line FROM pages)
  WHERE line <> '' GROUP BY host, line
), bad AS (
  SELECT host, list(line) AS bad FROM counts JOIN totals USING (host)
  WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO}::DOUBLE * n_pages GROUP BY host
), kept AS (
  SELECT p.*, list_filter(lines, lambda x: trim(x) = '' OR bad IS NULL OR NOT list_contains(bad, trim(x))) AS kept
  FROM pages p LEFT JOIN bad USING (host)
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS INTEGER) AS n_lines,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS INTEGER) AS n_dropped
FROM kept
"""


def _op2_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    pattern = "|".join(s.replace(" ", "(?: |//)") for s in sorted(licenses.SENTENCES, key=lambda s: (len(s), s)))
    steps, fits = [], []
    for k, (name, category, ids) in enumerate(licenses.RULES):
        needle = "".join(f",{i}," for i in ids)
        steps.append(
            f"s{k + 1} AS (SELECT * EXCLUDE (rest), CASE WHEN contains(rest, '{needle}') THEN '{name}|{category}' END AS r{k},"
            f" replace(rest, '{needle}', '#') AS rest FROM s{k})"
        )
        fits.append(f"r{k}")
    names = [n for n, _, _ in licenses.RULES]
    first = list(dict.fromkeys(names))
    fit = ", ".join(
        "coalesce(" + ", ".join(f"r{k}" for k, n in enumerate(names) if n == name) + ")" for name in first
    )
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_replace(coalesce(text, ''), '(\n[ \t]{{0,8}})[.!?;:]+', '\\1', 'g') AS text FROM documents),
pieces AS (
  SELECT row_id, unnest(parts) AS piece, unnest(range(0, len(parts))) AS k FROM (
    SELECT row_id, string_split_regex(text, '\n(?:[^a-zA-Z0-9\n]*\n)+|[.!?;:]*[.!?][.!?;:]*(?:[ \t]|\r?\n)') AS parts FROM rows_)
), broken AS (
  SELECT row_id, k, replace(regexp_replace('/' || regexp_replace(regexp_replace(translate(lower(piece), '/', ' '), '[.!?;:]+[ \t]|\n', '/', 'g'),
    '[^a-z0-9/]+', ' ', 'g') || '/', ' ?(?:/ ?)+', '/', 'g'), '/', '//') AS body
  FROM pieces WHERE regexp_matches(piece, '{licenses.NEEDED}')
), matched AS (
  SELECT row_id, k, unnest(hits) AS hit, unnest(range(0, len(hits))) AS j
  FROM (SELECT row_id, k, regexp_extract_all(body, '/({pattern})/', 1) AS hits FROM broken)
), found AS (
  SELECT row_id, string_agg(id, ',' ORDER BY k, j) AS ids, count(*) AS n
  FROM (SELECT row_id, k, j, replace(hit, '//', ' ') AS sentence FROM matched) JOIN known USING (sentence) GROUP BY row_id
), s0 AS (
  SELECT d.doc_id, coalesce(f.n, 0) AS n_sentences, coalesce(f.ids, '') AS sentence_ids,
    ',' || replace(coalesce(f.ids, ''), ',', ',,') || ',' AS rest
  FROM rows_ d LEFT JOIN found f USING (row_id)
), {", ".join(steps)},
fits AS (
  SELECT doc_id, n_sentences, sentence_ids, list_filter([{fit}], lambda x: x IS NOT NULL) AS fits FROM s{len(steps)}
)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
  coalesce(array_to_string(list_transform(fits, lambda x: split_part(x, '|', 1)), ','), '') AS licenses,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(fits, lambda x: split_part(x, '|', 2)))), ','), '') AS categories
FROM fits
"""


#: Levels of the tree that the SQL has; the operator's go as deep as paths branch.
SQL_DEPTH = 8


def _op5_sql() -> str:
    u = url_filter
    rule = verdict = "NULL"
    for v, h, p in sorted(u.RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = (f"CASE WHEN {fits} THEN '{x}' ELSE {y} END" for x, y in ((h + p, rule), (v, verdict)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    levels, depth = [], SQL_DEPTH
    for d in range(1, depth + 1):
        levels.append(f"""
at{d} AS (SELECT *, array_to_string(tmpl[1:{d - 1}], '/') AS node, tmpl[{d}] AS child FROM tree{d - 1}),
child{d} AS (SELECT host, node, child, sum(lab) AS lab, sum(bad) AS bad FROM at{d} WHERE child IS NOT NULL GROUP BY host, node, child),
node{d} AS (SELECT host, node, coalesce(sum(bad)::DOUBLE / nullif(sum(lab), 0), 0) AS p, count(*) AS children FROM child{d} GROUP BY host, node),
merged{d} AS (
  SELECT host, node, child FROM child{d} JOIN node{d} USING (host, node)
  WHERE children > 1 AND (lab < {u.MIN_LABELS} OR abs(bad - lab * p) <= {u.Z}::DOUBLE * sqrt(lab * p * (1 - p)))
),
tree{d} AS (
  SELECT a.host, segs, lab, bad, CASE WHEN m.child IS NULL THEN tmpl ELSE list_concat(list_concat(tmpl[1:{d - 1}], ['*']), tmpl[{d + 1}:]) END AS tmpl
  FROM at{d} a LEFT JOIN merged{d} m ON m.host = a.host AND m.node = a.node AND m.child = a.child
)""")
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
base AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
general AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
    lambda x: regexp_replace(regexp_replace(x, '[0-9a-f]{{12,}}|[0-9A-F]{{12,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g')) AS parts FROM base
),
keyed AS (
  SELECT page_id, host, path, parts AS segs,
    try_cast(nullif(regexp_extract(path, '([0-9]+)[.a-z]*/?$', 1), '') AS BIGINT) AS number FROM general
),
known AS (
  SELECT doc_id AS number, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
tree0 AS (
  SELECT host, segs, count(k.number) AS lab, coalesce(sum(k.bad), 0) AS bad, segs AS tmpl
  FROM keyed LEFT JOIN known k USING (number) GROUP BY host, segs
),{",".join(levels)},
prior AS (SELECT 1 - coalesce(sum(bad)::DOUBLE / nullif(sum(lab), 0), 0) AS good FROM tree{depth}),
rejected AS (
  SELECT host, tmpl FROM tree{depth}, prior GROUP BY host, tmpl, good
  HAVING (sum(lab) - sum(bad) + {u.PRIOR_LABELS}::DOUBLE * good) / (sum(lab) + {u.PRIOR_LABELS}) < {u.MIN_PURITY}
),
gone AS (SELECT DISTINCT t.host, segs, TRUE AS gone FROM tree{depth} t JOIN rejected r ON r.host = t.host AND r.tmpl = t.tmpl)
SELECT page_id, k.host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN gone THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT * FROM keyed) k LEFT JOIN gone g ON g.host = k.host AND g.segs = k.segs
""".replace("host = '", "k.host = '").replace("ends_with(host,", "ends_with(k.host,")


def _op11_sql() -> str:
    words = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{words}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {split} AS ts FROM documents),
lens AS (SELECT r, doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lens),
asked AS (
  SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS q, item_id, {split} AS ts FROM benchmark))
  GROUP BY q, item_id, t
),
freq AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, total GROUP BY t
),
scores AS (
  SELECT q, item_id, r, any_value(doc_id) AS doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN freq USING (t) JOIN weights USING (t) JOIN lens USING (r), total GROUP BY q, item_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {K}
"""


def _op12_sql() -> str:
    """The edits as a recursion over turns: the four weights are texts of a padded cost and the letters so far."""

    def on(w: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({w}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({w}, 13) || '{letter}'"

    def keep(symbol: str, w: str) -> str:
        return f"CASE WHEN lower(symbol) = '{symbol}' THEN {on(w, 'more', 'K')} END"

    def other(w: str) -> str:
        return f"CASE WHEN symbol <> 'x' THEN {on(w, '2 + more', 'R')} END"

    first = f"least(w2, {on('w0', '2', 'I')}, {on('w1', '2', 'I')}, {on('w3', '2', 'I')})"
    blank = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS entries
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i))
),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ascii(c) AS BIGINT))), lambda acc, b: xor(acc // 256, entries[(xor(acc, b) % 256) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE k <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS rn FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS copies FROM placed),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank' WHEN copies > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair
  FROM seen
),
turns AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE kind END AS symbol, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more
  FROM faults
),
ids AS (SELECT DISTINCT conv_id FROM conversations),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, repeat('0', 12) AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM ids
  UNION ALL
  SELECT conv_id, rn, {on('w0', '3', 'D')}, least({on('w1', '3', 'D')}, {keep('s', 'w0')}),
    least({on('w2', '3', 'D')}, {keep('u', 'w0')}, {keep('u', 'w1')}, {keep('u', 'w3')}, {other('w0')}, {other('w1')}, {other('w3')}),
    least({on('w3', '3', 'D')}, {keep('a', 'w2')}, {other('w2')})
  FROM (
    SELECT conv_id, rn, symbol, more, w0, w1, w2, least(w3, {on('w2', '2', 'I')}) AS w3 FROM (
      SELECT p.conv_id, t.rn, t.symbol, t.more, w0, w1, w3, {first} AS w2
      FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.rn = p.rn + 1))
),
ends AS (
  SELECT conv_id, least(w0, w3, {on('w2', '2', 'I')}) AS best FROM (SELECT conv_id, w0, w3, {first} AS w2 FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS back FROM paths) WHERE back = 1)
),
audits AS (SELECT conv_id, CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM ends),
letters AS (
  SELECT conv_id, letter, idx, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY idx) AS rn FROM (
    SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS idx FROM audits WHERE audit <> '')
),
outs AS (
  SELECT l.conv_id, letter, idx, t.role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY idx) AS j
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.rn = l.rn AND letter <> 'I' WHERE letter <> 'D'
),
roled AS (SELECT *, bool_or(j = 1 AND letter = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS led FROM outs),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole
  FROM roled GROUP BY conv_id
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM audits a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
""".replace("\\\\", "\\")


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _OP1_SQL,
    "op2_license_scan": _op2_sql(),
    "op5_url_filter": _op5_sql(),
    "op11_ranked_search": _op11_sql(),
    "op12_conversation_repair": _op12_sql(),
}
