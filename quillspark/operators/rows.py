"""Scans of one text as columns: arrays made and searched within the row, so no plan of them has an exchange.

Every function takes and gives Spark columns. A text is a string that is not
null; places are UTF-8 bytes. An array of ranges is ``array<struct<s,e>>``, of
hits ``array<struct<rule_id,s,e>>``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.catalog import Rule
from quillspark.functions.chars import JVM_ALNUM, JVM_SPACE, JVM_WORD
from quillspark.functions.containers import KINDS, SMALL_WORDS
from quillspark.functions.scan import JOINING, PICTOGRAPHS, SNIPPET_BYTES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK = 64  #: lengths that are added up together
MARK, PAST, NEITHER = "\x01", "\x02", "\x03"  #: marks of places, and what a text that has them is read with
HIT = "array<struct<rule_id:string,s:bigint,e:bigint>>"
RANGE = "array<struct<s:bigint,e:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def numbers(n: Column) -> Column:
    """``0 … n-1``; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _sums(lens: Column) -> Column:
    """``0`` and the running sums, by appending one at a time."""
    return F.aggregate(lens, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def prefix_sums(lens: Column) -> Column:
    """``0`` and the running sums of an array of longs: block by block, as an array is copied when it grows."""

    def whole(parts: Column) -> Column:
        befores = _sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(
            befores, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, BLOCK), lambda v: v + F.get(b, i))))
        )

    def blocks(lens: Column) -> Column:
        cut = F.transform(numbers(F.ceil(F.size(lens) / BLOCK)), lambda b: _sums(F.slice(lens, b * BLOCK + 1, BLOCK)))
        return let(cut, lambda parts: F.concat(F.array(F.lit(0).cast("long")), whole(parts)))

    return F.when(F.size(lens) <= BLOCK, _sums(lens)).otherwise(blocks(lens))


def _bytes(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.octet_length(p).cast("long"))


def marked_places(text: Column, pattern: str | Column, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """The byte places where a zero-width pattern matches; ``keep`` is asked of the pieces between the matches and a match's number.

    The text must not have ``MARK``.
    """
    parts = F.split(F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(MARK)), MARK, -1)

    def places(p: Column) -> Column:
        every = numbers(F.size(p) - 1)
        some = every if keep is None else F.filter(every, lambda i: keep(p, i))
        return let(prefix_sums(_bytes(p)), lambda sums: F.transform(some, lambda i: F.get(sums, i + 1)))

    return let(parts, places)


def pieces(text: Column, pattern: str, which: Callable[[Column], Column]) -> Column:
    """Ranges of those matches of a pattern that ``which`` picks; the matches must cover the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def ranges(p: Column) -> Column:
        return let(
            prefix_sums(_bytes(p)),
            lambda sums: F.transform(
                F.filter(numbers(F.size(p)), lambda i: which(F.get(p, i))),
                lambda i: F.struct(F.get(sums, i).alias("s"), F.get(sums, i + 1).alias("e")),
            ),
        )

    return let(found, ranges)


# --- lines and containers --------------------------------------------------------


def lines(text: Column) -> Column:
    """``array<struct<k,line,s,e>>``: each line without its end; a last empty line does not count."""

    def placed(raw: Column) -> Column:
        def line(i: Column, s: Column) -> Column:
            body = F.regexp_replace(F.get(raw, i), r"\r\z", "")
            return let(body, lambda b: F.struct(i.alias("k"), b.alias("line"), s.alias("s"), (s + F.octet_length(b)).alias("e")))

        n = F.when(F.element_at(raw, -1) == "", F.size(raw) - 1).otherwise(F.size(raw))
        ends = prefix_sums(F.transform(raw, lambda r: (F.octet_length(r) + 1).cast("long")))
        return let(ends, lambda sums: F.transform(numbers(n), lambda i: line(i, F.get(sums, i))))

    return let(F.split(text, "\n", -1), placed)


def _range(s: Column, e: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


def fenced(lines_: Column, size: Column) -> Column:
    """Ranges of fenced code: marker lines toggle, an open fence runs to the end."""
    marks = F.filter(lines_, lambda x: x["line"].rlike(f"^{JVM_SPACE}*```"))
    return let(
        marks,
        lambda m: F.transform(
            F.filter(numbers(F.size(m)), lambda i: i % 2 == 0), lambda i: _range(F.get(m, i)["s"], F.coalesce(F.get(m, i + 1)["e"], size))
        ),
    )


def blockquoted(lines_: Column) -> Column:
    """Ranges of lines that begin with ``>``."""
    return F.transform(F.filter(lines_, lambda x: x["line"].rlike(f"^{JVM_SPACE}*>")), lambda x: _range(x["s"], x["e"]))


def headed(lines_: Column) -> Column:
    """Ranges of lines that begin with ``#`` or are short and in title case."""
    leads = r"^[\p{IsUppercase}0-9]"

    def title(body: Column) -> Column:
        words = F.split(body, f"{JVM_SPACE}+")
        return (
            (F.octet_length(body) <= 60) & body.rlike(leads) & ~body.rlike(r"[.!?,;:]\z")
            & F.forall(words, lambda w: w.rlike(leads) | ascii_lower(w).isin(*SMALL_WORDS))
        )

    def heading(line: Column) -> Column:
        body = F.regexp_replace(line, rf"^{JVM_SPACE}++|{JVM_SPACE}++\z", "")
        return let(body, lambda b: (b != "") & ~F.startswith(b, F.lit(">")) & (F.startswith(b, F.lit("#")) | title(b)))

    return F.transform(F.filter(lines_, lambda x: heading(x["line"])), lambda x: _range(x["s"], x["e"]))


def merged(ranges: Column) -> Column:
    """Overlapping and touching ranges as one, in order."""
    none = F.array().cast(RANGE)

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), _range(last["s"], F.greatest(last["e"], r["e"])))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["s"] <= last["e"], joined).otherwise(F.array_append(acc, r))

    return F.aggregate(F.array_sort(ranges), none, add)


def _quotes(text: Column, opening: str, closing: str) -> Column:
    """From each opening mark to the next closing one of the same session; a blank line ends a session.

    A mark that is not closed takes what is left of its session, in which nothing closes either.
    """
    body = rf"[^{closing}\n]*+(?:\n(?!{JVM_SPACE}*\n)[^{closing}\n]*+)*+"
    cover = f"{opening}{body}{closing}?|[^{opening}]++"
    return pieces(text, cover, lambda p: F.startswith(p, F.lit(opening)) & F.endswith(p, F.lit(closing)) & (F.length(p) > 1))


def quoted(text: Column) -> Column:
    """Ranges of straight and of curly double quotes in pairs, merged."""
    straight = F.when(F.contains(text, F.lit('"')), _quotes(text, '"', '"')).otherwise(F.array().cast(RANGE))
    curly = F.when(F.contains(text, F.lit("“")), _quotes(text, "“", "”")).otherwise(F.array().cast(RANGE))
    return let(F.concat(straight, curly), lambda r: F.when(F.size(r) > 0, merged(r)).otherwise(r))


def containers(text: Column) -> Column:
    """``array<struct<rank,kind,s,e>>``: every container; a lower rank takes precedence."""

    def of(lines_: Column) -> Column:
        parts = (fenced(lines_, F.octet_length(text).cast("long")), blockquoted(lines_), quoted(text), headed(lines_))
        return F.concat(*(tagged(rank, kind, p) for rank, (kind, p) in enumerate(zip(KINDS, parts))))

    def tagged(rank: int, kind: str, ranges: Column) -> Column:
        return F.transform(ranges, lambda r: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), r["s"].alias("s"), r["e"].alias("e")))

    return let(lines(text), of)


def container_at(found: Column, place: Column) -> Column:
    """The kind of the first container, by rank, that covers a place."""
    first = F.array_min(F.filter(found, lambda c: (c["s"] <= place) & (place < c["e"])))
    return F.coalesce(first["kind"], F.lit("prose"))


# --- terms ------------------------------------------------------------------------

#: Words of most texts, by which a term is looked up only if it has no other.
COMMON = ("the", "and", "was", "that", "are", "for", "this", "with", "not", "of", "to", "in", "is", "it", "as", "be", "by", "an", "on", "or", "a", "s")
STEM = 4  #: letters at a word's begin or end that a term is known by, where the word may be longer


class _Terms:
    """Terms, and by what words of a text each is known: ``(rule, term, ignore case, word, block)``.

    Wherever a term stands, its runs of word characters that its ends do not cut
    are words of the text; its last run begins a word and its first one ends
    one. By the longest of them it is looked up; a term of one run that may lie
    within a word is looked for in every text.
    """

    WHOLE, BEGIN, END = range(3)

    def __init__(self, rules: Iterable[Rule]):
        self.rows: list[tuple[str, str, bool, bool, bool]] = []
        self.by: tuple[dict[str, list[int]], ...] = ({}, {}, {})
        self.always: list[int] = []
        for r in rules:
            ci = r.case == "insensitive"
            for t in r.terms:
                t = t.translate({ord(c): c.lower() for c in UPPER}) if ci else t
                self._add((r.id, t, ci, r.boundary == "word", r.position == "block-start"))
            for t in r.exemptions:  # what exempts a rule goes by its name with a mark
                self._add(("~" + r.id, t, True, False, False))

    def _add(self, row: tuple) -> None:
        _, term, _, word, _ = row
        low = term.translate({ord(c): c.lower() for c in UPPER})
        runs = [(m.group(), word or m.start() > 0, word or m.end() < len(low)) for m in re.finditer(r"\w+", low)]
        ways = []
        for run, begun, ended in runs:
            if begun and ended:
                ways.append((0 if run in COMMON else len(run), self.WHOLE, run))
            elif begun and len(run) >= STEM:
                ways.append((len(run), self.BEGIN, run[:STEM]))
            elif ended and len(run) >= STEM:
                ways.append((len(run), self.END, run[-STEM:]))
        if ways:
            _, kind, key = max(ways)
            self.by[kind].setdefault(key, []).append(len(self.rows))
        else:
            self.always.append(len(self.rows))
        self.rows.append(row)

    def met(self, low: Column) -> Column:
        """The numbers of the terms that share with a lower-cased text what they are known by."""
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(JVM_WORD + "+"), F.lit(0)))

        def known(kind: int, these: Column) -> Column:
            keys = sorted(self.by[kind])
            if not keys:
                return F.array().cast("array<int>")
            names, lists = F.lit(keys), _ints([self.by[kind][k] for k in keys])
            return F.flatten(F.transform(F.array_intersect(these, names), lambda w: F.get(lists, F.array_position(names, w).cast("int") - 1)))

        def all_of(words: Column) -> Column:
            first = F.transform(words, lambda w: F.substring(w, 1, STEM))
            last = F.transform(words, lambda w: F.right(w, F.lit(STEM)))
            return F.concat(_ints([self.always])[0], known(self.WHOLE, words), known(self.BEGIN, first), known(self.END, last))

        return let(words, all_of)


def _ints(lists: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join("cast(array(" + ", ".join(map(str, x)) + ") as array<int>)" for x in lists) + ")")


def term_hits(text: Column, rules: Iterable[Rule]) -> Column:
    """The hits of the rules' terms, exempt ones left out, before merging."""
    terms = _Terms(rules)
    rule_ids, names, ci, word, block = (F.lit([r[k] for r in terms.rows]) for k in range(5))
    exempt = any(r[0].startswith("~") for r in terms.rows)
    starts = r"(?:\A|[\n\r.!?])[ \t\-*\x{2022}]*+\z"

    def placed(hay: Column, k: Column) -> Column:
        edge = F.when(F.get(word, k), F.lit(f"(?!{JVM_WORD}))(?<!{JVM_WORD})")).otherwise(F.lit(")"))
        pattern = F.concat(F.lit(r"(?=\Q"), F.get(names, k), F.lit(r"\E"), edge)
        at = marked_places(hay, pattern, lambda p, i: ~F.get(block, k) | F.array_join(F.slice(p, 1, i + 1), "").rlike(starts))
        return F.transform(at, lambda s: F.struct(F.get(rule_ids, k).alias("rule_id"), s.alias("s"), (s + F.octet_length(F.get(names, k))).alias("e")))

    def of(clean: Column, low: Column) -> Column:
        hay = lambda k: F.when(F.get(ci, k), low).otherwise(clean)
        here = F.filter(terms.met(low), lambda k: F.contains(hay(k), F.get(names, k)))
        return F.flatten(F.transform(here, lambda k: placed(hay(k), k)))

    def kept(hits: Column) -> Column:
        covers = F.filter(hits, lambda h: F.startswith(h["rule_id"], F.lit("~")))
        inside = lambda h, c: (F.substring(c["rule_id"], 2, 64) == h["rule_id"]) & (c["s"] <= h["s"]) & (c["e"] >= h["e"])
        return let(covers, lambda cs: F.filter(hits, lambda h: ~F.startswith(h["rule_id"], F.lit("~")) & ~F.exists(cs, lambda c: inside(h, c))))

    found = let(F.translate(text, MARK + PAST, NEITHER * 2), lambda clean: let(ascii_lower(clean), lambda low: of(clean, low)))
    return let(found, kept) if exempt else found


# --- code points, spaces, openers ---------------------------------------------------


def _class(ranges) -> str:
    """Ranges as the body of a class; beyond the basic plane by the characters themselves, which Java needs to look behind over them."""

    def one(c: int) -> str:
        return chr(c) if c > 0xFFFF else f"\\x{{{c:X}}}"

    return "".join(f"{one(lo)}-{one(hi)}" for lo, hi in ranges)


def codepoint_hits(text: Column, rule: Rule) -> Column:
    """Runs of a rule's code points; those that orthography has there are none and part a run.

    Such are a byte order mark that begins the text, a presentation selector
    after a character that is not listed, and a joiner between two letters of
    joining scripts or two pictographs, one selector aside.
    """
    listed, out = _class(rule.ranges), []
    if rule.exempt_leading_bom:
        out.append(r"(?!\A\x{FEFF})")
    if rule.exempt_presentation_selector:
        out.append(rf"(?!(?<=[^{listed}])[\x{{FE0E}}\x{{FE0F}}])")
    if rule.exempt_joining_zwj:
        for kind in (_class(JOINING), _class(PICTOGRAPHS)):
            out.append(rf"(?!(?:(?<=[{kind}])|(?<=[{kind}][\x{{FE0E}}\x{{FE0F}}]))[\x{{200C}}\x{{200D}}](?=[{kind}]))")
    one = "".join(out) + f"[{listed}]"
    clean = F.translate(text, MARK + PAST, NEITHER * 2)
    # a hit stands between marks, which are no part of it
    marks = F.regexp_replace(clean, f"((?:{one})++)", f"{MARK}$1{PAST}")
    found = F.regexp_extract_all(marks, F.lit(f"{MARK}[^{PAST}]*+{PAST}|[^{MARK}]++"), F.lit(0))

    def ranges(p: Column) -> Column:
        hit = lambda x: F.startswith(x, F.lit(MARK))
        sizes = F.transform(p, lambda x: (F.octet_length(x) - F.when(hit(x), 2).otherwise(0)).cast("long"))
        return let(
            prefix_sums(sizes),
            lambda sums: F.transform(
                F.filter(numbers(F.size(p)), lambda i: hit(F.get(p, i))),
                lambda i: F.struct(F.lit(rule.id).alias("rule_id"), F.get(sums, i).alias("s"), F.get(sums, i + 1).alias("e")),
            ),
        )

    return F.when(text.rlike(f"[{listed}]"), let(found, ranges)).otherwise(F.array().cast(HIT))


def space_hits(text: Column, rule: Rule) -> Column:
    """Typographic spaces between letters, if there are enough of them."""
    chars = "".join(f"\\x{{{c:X}}}" for c in rule.codepoints)
    pattern = rf"(?=[{chars}]\p{{IsAlphabetic}})(?<=\p{{IsAlphabetic}})"
    width = {len(chr(c).encode()) for c in rule.codepoints}
    (size,) = width  # all of one length, so a place tells the range
    places = marked_places(F.translate(text, MARK, PAST), pattern)
    hits = F.transform(places, lambda s: F.struct(F.lit(rule.id).alias("rule_id"), s.alias("s"), (s + size).alias("e")))
    some = let(hits, lambda h: F.when(F.size(h) >= rule.min_count, h).otherwise(F.array().cast(HIT)))
    return F.when(text.rlike(f"[{chars}]"), some).otherwise(F.array().cast(HIT))


def opener_hits(text: Column, rule: Rule) -> Column:
    """Sentences that open with a capitalised participle, none of the stoplist, and a short clause up to a comma."""
    most = rule.max_clause - 1
    start = rf"(?=[A-Z][a-z]{{1,26}}?ing [^,.!?;:\n]{{1,{most}}},)"
    span = rf"^([A-Z][a-z]+) ([^,.!?;:\n]{{1,{most}}}),"
    begins = r"(?:\A|[\n\r.!?])[ \t\-*\x{2022}]*+\z"

    def ahead(p: Column, i: Column) -> Column:
        """What stands from a place on, as far as a hit can reach."""
        return F.array_join(F.slice(p, i + 2, 32 + rule.max_clause), "")

    def good(p: Column, i: Column) -> Column:
        word, clause = F.regexp_extract(ahead(p, i), span, 1), F.regexp_extract(ahead(p, i), span, 2)
        before = F.array_join(F.slice(p, 1, i + 1), "").rlike(begins)
        return ~F.lower(word).isin(*sorted(rule.stoplist)) & (F.octet_length(clause) <= most) & before

    def hits(p: Column) -> Column:
        size = lambda i: F.octet_length(F.regexp_extract(ahead(p, i), span, 0))
        hit = lambda i, s: F.struct(F.lit(rule.id).alias("rule_id"), s.alias("s"), (s + size(i)).alias("e"))
        some = F.filter(numbers(F.size(p) - 1), lambda i: good(p, i))
        return let(prefix_sums(_bytes(p)), lambda sums: F.transform(some, lambda i: hit(i, F.get(sums, i + 1))))

    found = let(F.split(F.regexp_replace(F.translate(text, MARK, PAST), start, MARK), MARK, -1), hits)
    return F.when(text.rlike("[A-Z][a-z]+ing [^,.!?;:\n]+,"), found).otherwise(F.array().cast(HIT))


def tail_hits(text: Column, rule: Rule) -> Column:
    """``, not …`` and ``, never …`` that close a sentence which tells the reader to do nothing.

    From each comma the closing mark is looked for ahead, over a noun phrase of
    at most ``max_np`` bytes; behind, the last boundary of a clause is the
    as-of place where its verdict begins, if it is within ``clause_window`` bytes.
    """
    alnum, lower, token = JVM_ALNUM, r"\p{IsLowercase}", f"(?:{JVM_ALNUM}|')"
    head = r",[ \t\n\r]{0,8}+(?i:never|not)[ \t\n\r]{1,8}+"
    goes_on = rf"(?:{alnum}|[ \t]{{1,8}}+{lower})"  # what follows a full stop that ends no sentence
    phrase = rf"^({head})((?:[^;:,\n\x{{FFFD}}!?.]|\.(?={goes_on})){{0,{rule.max_np}}}+)([!?]|\.(?!{goes_on}))"
    boundary = rf"^[\s\S]*(?:\n|[!?:](?={JVM_SPACE})|\.(?={JVM_SPACE})(?!{goes_on}))"
    you = "|".join(sorted(rule.second_person, key=len, reverse=True))
    stop = F.lit(sorted(rule.stoplist))

    def ahead(p: Column, i: Column) -> Column:
        return F.array_join(F.slice(p, i + 2, rule.max_np + 64), "")

    def closed(p: Column, i: Column) -> Column:
        said = F.regexp_extract(ahead(p, i), phrase, 2)
        good = said.rlike(f"(?!{JVM_SPACE})[\\s\\S]") & (F.octet_length(said) <= rule.max_np)
        return good & ~ascii_lower(said).rlike(f"(?<!{alnum})but(?!{alnum})")

    def directive(clause: Column) -> Column:
        def told(c: Column) -> Column:
            first = lambda x: F.regexp_extract(x, f"{token}++", 0)
            commas = F.transform(F.split(c, ", ", -1), first)
            thens = F.regexp_extract_all(c, F.lit(rf"(?<!{alnum})then (?=(?:(?!{token})[\s\S])*+({token}++))"), F.lit(1))
            return F.arrays_overlap(F.concat(F.array(first(c)), F.slice(commas, 2, F.size(commas)), thens), stop)

        return let(F.lower(clause), lambda low: low.rlike(f"(?<!{alnum})(?:{you})(?!{alnum})") | told(F.translate(low, "’", "'")))

    def kept(p: Column, i: Column) -> Column:
        def judged(before: Column) -> Column:
            clause = F.regexp_replace(before, boundary, "")
            size = lambda c: F.octet_length(c) - F.when(F.length(c) == F.length(before), F.octet_length(F.substring(c, 1, 1))).otherwise(0)
            return let(clause, lambda c: (size(c) >= rule.clause_window) | ~directive(c))

        return closed(p, i) & let(F.array_join(F.slice(p, 1, i + 1), ""), judged)

    def hits(p: Column) -> Column:
        some = F.filter(numbers(F.size(p) - 1), lambda i: kept(p, i))
        size = lambda i: F.octet_length(F.regexp_extract(ahead(p, i), phrase, 0))
        hit = lambda i, at: F.struct(F.lit(rule.id).alias("rule_id"), at.alias("s"), (at + size(i)).alias("e"))
        return let(prefix_sums(_bytes(p)), lambda sums: F.transform(some, lambda i: hit(i, F.get(sums, i + 1))))

    found = let(F.split(F.regexp_replace(F.translate(text, MARK, NEITHER), f"(?={head})", MARK), MARK, -1), hits)
    return F.when(text.rlike(head), found).otherwise(F.array().cast(HIT))


def merge_contained(hits: Column) -> Column:
    """Hits without those that lie in another of the same rule; equal ones are one; in order of rule and place."""
    state = F.struct(F.lit("").alias("rule"), F.lit(-1).cast("long").alias("reach"), F.array().cast(HIT).alias("out"))
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["rule_id"].alias("rule_id"), h["s"].alias("s"), (-h["e"]).alias("z"))))

    def add(acc: Column, h: Column) -> Column:
        inside = (acc["rule"] == h["rule_id"]) & (-h["z"] <= acc["reach"])
        hit = F.struct(h["rule_id"].alias("rule_id"), h["s"].alias("s"), (-h["z"]).alias("e"))
        grown = F.struct(h["rule_id"].alias("rule"), (-h["z"]).alias("reach"), F.array_append(acc["out"], hit).alias("out"))
        return F.when(inside, acc).otherwise(grown)

    return F.when(F.size(hits) > 1, F.aggregate(order, state, add, lambda acc: acc["out"])).otherwise(hits)


# --- what is reported of a hit ----------------------------------------------------------


def snippet(text: Column, s: Column, e: Column) -> Column:
    """The bytes ``s`` to ``e`` as text, cut after ``SNIPPET_BYTES`` at a character's end."""
    # bytes as the characters of their numbers, so that a pattern can tell a whole last character
    raw = F.decode(F.substring(F.encode(text, "utf-8"), s.cast("int") + 1, F.least(e - s, F.lit(SNIPPET_BYTES)).cast("int")), "ISO-8859-1")
    whole = r"(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3})\z"
    fit = let(raw, lambda r: F.when((e - s <= SNIPPET_BYTES) | r.rlike(whole), r).otherwise(F.regexp_replace(r, r"[\xC0-\xFF][\x80-\xBF]*\z", "")))
    return F.decode(F.encode(fit, "ISO-8859-1"), "utf-8")
