import pytest

from quillspark.catalog import CatalogError, check_pattern, code_range, load_rules, make_rule, parse_rules

WORDS = {"name": "n", "category": "paste_residue", "mechanism": "word-set", "terms": ["a"]}
QUALITY = {"name": "n", "category": "quality_patterns", "class": "spike"}


def test_shape_of_the_shipped_catalog():
    rules = load_rules()
    assert len(rules) == 41
    assert sum(len(r.terms) for r in rules) == 590
    assert sum(len(r.patterns) for r in rules) == 71
    assert len({r.id for r in rules}) == 41
    terms = [t for r in rules for t in r.terms]
    assert len(set(terms)) == len(terms)


@pytest.mark.parametrize(
    "raw",
    [
        {**WORDS, "terms": []},
        {**WORDS, "class": "spike"},
        {**WORDS, "colour": "red"},
        {**WORDS, "ranges": ["41"]},
        {**WORDS, "codepoints": ["41"]},
        {**WORDS, "stoplist": ["a"]},
        {**WORDS, "max_clause": 3},
        {**WORDS, "max_np": 3},
        {**WORDS, "min_count": 3},
        {**WORDS, "exempt_leading_bom": True},
        {**WORDS, "shingle_words": 8},
        {**WORDS, "exemptions": ["éa"]},
        {**WORDS, "mechanism": "regex"},
        {**QUALITY, "mechanism": "regex", "patterns": []},
        {**QUALITY, "mechanism": "participial-opener"},
        {**QUALITY, "mechanism": "contrastive-tail"},
        {**QUALITY, "mechanism": "self-duplication", "shingle_words": 8, "min_run_words": 10},
        {**QUALITY, "mechanism": "self-duplication", "shingle_words": 8, "min_run_words": 7, "max_reports": 1},
        {**QUALITY, "mechanism": "codepoint", "ranges": ["D800"]},
        {**QUALITY, "mechanism": "codepoint", "ranges": ["42-41"]},
        {**QUALITY, "mechanism": "codepoint", "ranges": ["41"], "exemptions": ["a"]},
        {"name": "n", "category": "quality_patterns", "mechanism": "regex", "patterns": ["a"]},
        {**WORDS, "category": "other"},
        {k: v for k, v in WORDS.items() if k != "name"},
    ],
)
def test_broken_rules(raw):
    with pytest.raises(CatalogError):
        make_rule("X", raw)


@pytest.mark.parametrize("p", [r"a*", r"a+", r"a{2,}", r"(?=a)b", r"(?<!a)b", r"a?", r"a(", r"(?!x)y"])
def test_broken_patterns(p):
    with pytest.raises(CatalogError):
        check_pattern(p)


def test_edges_and_ranges():
    assert check_pattern(r"(?i)\ba{1,3}\b") == (True, True)
    assert check_pattern(r"(?im)^a[*+]\+") == (False, False)
    assert code_range("41-43") == (0x41, 0x43)


def test_empty_and_repeated():
    with pytest.raises(CatalogError):
        parse_rules("")
    with pytest.raises(CatalogError):
        parse_rules("[A]\nname='n'\n[A]\nname='n'\n")


def test_defaults():
    r = make_rule("X", WORDS)
    assert (r.case, r.boundary, r.position, r.min_count) == ("sensitive", "none", "anywhere", 1)
