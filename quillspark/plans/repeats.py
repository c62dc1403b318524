"""The SQL of repeats: shingle joins, islands on diagonals, and a recursion over what is reported."""

from __future__ import annotations

from quillspark.functions.duplication import TRIED
from quillspark.operators.repeats import repeat_rule
from quillspark.plans.planted import PASSAGE

_WORD, _CUT = (rf"[{x}\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}''’]" for x in ("", "^"))
_SNIPPET = "CASE WHEN strlen({0}) <= 200 THEN {0} ELSE left({0}, list_max(list_filter(range(0, 201), lambda n: strlen(left({0}, n)) <= 200))) END"


def runs_sql(across: bool) -> str:
    """CTEs over ``files(g, f, text)`` that end in ``runs(g, early, late, n)``; ``across``, also ``capped(g)``, which have none."""
    rule = repeat_rule()
    k = rule.shingle_words
    apart = "a.f < b.f" if across else f"a.c + {k} <= b.c"
    reach = "n" if across else "least(n, d)"
    capped = f"\ncapped AS (SELECT DISTINCT g FROM times WHERE times > {TRIED + 1})," if across else ""
    free = " WHERE s.g NOT IN (SELECT g FROM capped)" if across else ""
    first = (
        "list_reduce(list_concat([{s: greatest(c.late, w.now) - c.d, z: CAST(0 AS BIGINT)}], w.skips),"
        " lambda acc, x: CASE WHEN acc.s > x.s AND acc.s < x.z THEN {s: x.z, z: CAST(0 AS BIGINT)} ELSE acc END).s"
    )
    return f"""
worded AS (
  SELECT g, f, list_transform(regexp_extract_all(text, '{_WORD}+'), lambda w: lower(translate(w, '’Σ', '''σ'))) AS w FROM files
),
shingles AS (
  SELECT g, f, f * 4294967296 + i - 1 AS c, array_to_string(w[i:i + {k - 1}], ' ') AS h
  FROM (SELECT g, f, w, unnest(range(1, len(w) - {k - 2})) AS i FROM worded WHERE len(w) >= {k})
),
times AS (SELECT g, h, count(*) AS times FROM shingles GROUP BY g, h HAVING count(*) > 1 {'AND min(f) < max(f)' if across else ''}),{capped}
met AS (SELECT s.g, s.f, s.c, s.h FROM shingles s JOIN times t ON t.g = s.g AND t.h = s.h{free}),
diagonals AS (SELECT a.g, b.c - a.c AS d, a.c AS early FROM met a JOIN met b ON a.g = b.g AND a.h = b.h AND {apart}),
stretches AS (
  SELECT g, d, min(early) AS early, count(*) + {k - 1} AS n FROM (SELECT *, early - row_number() OVER (PARTITION BY g, d ORDER BY early) AS island FROM diagonals)
  GROUP BY g, d, island
),
cands AS (SELECT g, d, early, early + d AS late, n, {reach} AS reach FROM stretches WHERE {reach} >= {rule.min_run_words}),
walk AS (
  SELECT g, CAST(0 AS BIGINT) AS now, CAST([] AS STRUCT(s BIGINT, z BIGINT)[]) AS skips, CAST(NULL AS BIGINT) AS early, CAST(NULL AS BIGINT) AS late, CAST(NULL AS BIGINT) AS n
  FROM (SELECT DISTINCT g FROM cands)
  UNION ALL
  SELECT g, place + ahead, list_append(skips, {{s: place, z: place + ahead}}), place - back - d, place - back, ahead + back FROM (
    SELECT *, {'place - late' if across else 'CASE WHEN ahead = d THEN 0 ELSE least(place - late, d - ahead) END'} AS back FROM (
      SELECT *, {'n - (place - late)' if across else 'least(n - (place - late), d)'} AS ahead FROM (
        SELECT g, skips, best.place AS place, -best.z AS d, best.late AS late, best.n AS n FROM (
          SELECT g, any_value(skips) AS skips, min({{place: e + d, r: -reach, z: -d, late: late, n: n}}) AS best FROM (
            SELECT w.g, w.skips, c.d, c.late, c.early, c.n, c.reach, {first} AS e FROM walk w JOIN cands c ON c.g = w.g)
          WHERE e <= early + n - {k} GROUP BY g))))
),
runs AS (SELECT g, early, late, n FROM walk WHERE n IS NOT NULL)"""


def _spans_sql(table: str) -> str:
    """CTEs that end in ``run_spans(g, f, first, n, s, e, said)`` of ``table(g, f, first, n)``."""
    return f"""
cuts AS (
  SELECT t.g, t.f, t.first, t.n, regexp_extract_all(text, '{_WORD}+|{_CUT}+') AS p
  FROM (SELECT DISTINCT g, f, first, n FROM {table}) t JOIN files ON files.g = t.g AND files.f = t.f
),
placed_words AS (SELECT *, 2 * first + CASE WHEN regexp_matches(p[1], '^{_WORD}') THEN 0 ELSE 1 END AS lead_ FROM cuts),
run_spans AS (
  SELECT g, f, first, n, CAST(strlen(array_to_string(p[1:lead_], '')) AS BIGINT) AS s, CAST(strlen(array_to_string(p[1:lead_ + 2 * n - 1], '')) AS BIGINT) AS e,
    array_to_string(p[lead_ + 1:lead_ + 2 * n - 1], '') AS said FROM placed_words
)"""


def repeats_sql(containers: str) -> str:
    """All repeats of the documents; ``containers`` are CTEs of the containers of ``docs(doc_id, text)``."""
    return f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS text FROM documents),
files AS (SELECT doc_id AS g, CAST(0 AS BIGINT) AS f, text FROM docs),
{runs_sql(False)},
kept AS (
  SELECT g, CAST(0 AS BIGINT) AS f, late AS first, early, n FROM runs
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, late, early) <= {repeat_rule().max_reports}
),
{_spans_sql('kept')}, {containers},
whole AS (
  SELECT k.g, k.early, k.first AS late, k.n, s.s, s.e, s.said, coalesce(arg_min(kind, rank), 'prose') AS container
  FROM kept k JOIN run_spans s ON s.g = k.g AND s.first = k.first AND s.n = k.n LEFT JOIN ranges r ON r.doc_id = k.g AND r.s <= s.s AND s.s < r.e
  GROUP BY k.g, k.early, k.first, k.n, s.s, s.e, s.said
)
SELECT id AS doc_id, FALSE AS capped, early, late, n, s, e, {_SNIPPET.format('said')} AS snippet, e - s > 200 AS snippet_truncated, container
FROM whole JOIN docs ON doc_id = g"""


def passages_sql(containers: str) -> str:
    """Every place of every passage that bundles share; ``containers`` are CTEs of the containers of ``texts_of(doc_id, text)``."""
    passage = PASSAGE.replace("'", "''")
    return f"""WITH RECURSIVE files AS (
  SELECT conv_id AS g, turn AS f, role AS path, coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '{passage}' ELSE '' END AS text FROM conversations
),
{runs_sql(True)},
entries AS (
  SELECT g, early, n, list_prepend(early, list(late ORDER BY late)) AS cs FROM runs GROUP BY g, early, n
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, early) <= {repeat_rule().max_reports}
),
each AS (
  SELECT g, early, n, o, c // 4294967296 AS f, c % 4294967296 AS first FROM (SELECT g, early, n, unnest(range(0, len(cs))) AS o, unnest(cs) AS c FROM entries)
),
{_spans_sql('each')},
texts_of AS (SELECT g * 4294967296 + f AS doc_id, g, f, path, text FROM files WHERE g IN (SELECT g FROM runs)),
{containers},
occurrences AS (
  SELECT x.g, x.early, x.n, x.o, t.path, s.s, s.e, s.said, coalesce(arg_min(kind, rank), 'prose') AS container
  FROM each x JOIN run_spans s ON s.g = x.g AND s.f = x.f AND s.first = x.first AND s.n = x.n JOIN texts_of t ON t.g = x.g AND t.f = x.f
  LEFT JOIN ranges r ON r.doc_id = t.doc_id AND r.s <= s.s AND s.s < r.e GROUP BY x.g, x.early, x.n, x.o, t.path, s.s, s.e, s.said
),
numbered AS (SELECT g, early, n, said, row_number() OVER (PARTITION BY g ORDER BY coalesce(path, ''), s, e, n DESC, early) AS entry FROM occurrences WHERE o = 0)
SELECT o.g AS bundle_id, CAST(entry AS INTEGER) AS entry, {_SNIPPET.format('x.said')} AS snippet, strlen(x.said) > 200 AS snippet_truncated,
  CAST(o.o AS INTEGER) AS occurrence, coalesce(path, '') AS path, o.s AS span_start, o.e AS span_end, container
FROM occurrences o JOIN numbered x ON x.g = o.g AND x.early = o.early AND x.n = o.n"""
