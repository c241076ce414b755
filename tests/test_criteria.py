"""Criteria of queries: what is parsed, what is refused, and which subjects they leave."""

import pytest

from partloom.plans.criteria import Condition, Criteria, Pattern, Term, parse_criteria, with_criteria
from partloom.plans.query import parse
from partloom.sources import readers

S = Term("subject", "var")


def iri(x):
    return Term(x, "iri")


def test_objects_of_all_kinds():
    got = parse_criteria("""?subject <http://x/role> "promoter" . ?subject dcterms:title 'gfp'@en . ?subject role <http://r> . ?subject p:n "1"^^xsd:int .""", {"dcterms": "http://purl.org/dc/terms/"})
    assert got == Criteria((Pattern(S, iri("http://x/role"), Term("promoter", "literal")), Pattern(S, iri("http://purl.org/dc/terms/title"), Term("gfp", "literal")), Pattern(S, iri("role"), iri("http://r")), Pattern(S, iri("p:n"), Term("1", "literal"))))


def test_lists_and_the_basic_pattern():
    got = parse_criteria('?subject a ?type ; sbh:topLevel ?subject ; dcterms:title ?name ; sbol:role <r1> , "r.2" . OPTIONAL { ?subject x ?y . OPTIONAL { ?y z ?w } } ?subject sbol:displayId ?displayId')
    assert got.patterns == (Pattern(S, iri("sbol:role"), iri("r1")), Pattern(S, iri("sbol:role"), Term("r.2", "literal"))) and not got.tests
    assert not parse_criteria("FILTER () .") and not parse_criteria("")


def test_filters():
    got = parse_criteria("""?subject title ?t . FILTER (?t = "x") FILTER(CONTAINS(lcase(?t), lcase('Ab')) && STRSTARTS(str(?t), "q")) FILTER regex(?t, "^a(b|c)", "i") FILTER (?t != 'n')""")
    assert got.tests == (Condition("t", "=", "x", False), Condition("t", "contains", "Ab", True), Condition("t", "strstarts", "q", False), Condition("t", "regex", "^a(b|c)", True), Condition("t", "!=", "n", False))


@pytest.mark.parametrize("text", ["?subject <p>", "?subject <p> <o> <q> .", "?subject p ?x . FILTER (bound(?x))", "?other <p> <o> .", "?subject p ?x . ?x q ?subject .", "?subject p+ <o> .", "{ ?subject <p> <o> } UNION { ?subject <p> <q> }", "?subject p ?x . FILTER (?y = 'a')", "?subject <p> <o> . FILTER (?x = 'a'", "?subject p ?x . FILTER (?x = 'a' || ?x = 'b')"])
def test_what_is_not_understood_is_refused(text):
    with pytest.raises(ValueError):
        parse_criteria(text)


QUADS = [("a", "role", "promoter"), ("a", "title", "GFP one"), ("b", "role", "promoter"), ("b", "title", "rfp"), ("c", "role", "cds"), ("c", "title", "gfp two"), ("a", "made", "x1"), ("b", "made", "x2"), ("c", "made", "x2"), ("x1", "by", "lab1"), ("x2", "by", "lab2"), ("x2", "in", "1999"), ("set1", "member", "a"), ("set1", "member", "c"), ("set1", "title", "The set")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('?subject role "promoter" .', "ab"),
        ("?subject role 'promoter' ; title 'rfp' .", "b"),
        ("?subject role 'none' .", ""),
        ("?subject title ?t . FILTER (CONTAINS(lcase(?t), lcase('gfp')))", "ac"),
        ("?subject title ?t . FILTER (CONTAINS(?t, 'gfp'))", "c"),
        ("?subject title ?t . FILTER regex(?t, '^g.p', 'i')", "ac"),
        ("?subject made ?x . ?x by 'lab2' .", "bc"),
        ("?subject made ?x . ?x by ?l . ?x in '1999' . FILTER (?l != 'lab1') ?subject role 'cds' .", "c"),
        ("?set member ?subject . ?set title 'The set' .", "ac"),
        ("set1 member ?subject . ?subject ?any 'promoter' .", "a"),
        ("?subject made ?x .", "abc"),
        ("?subject title ?name . FILTER (?name = 'rfp')", "b"),
        ("?subject role 'promoter' . FILTER (STRSTARTS(str(?subject), 'a'))", "a"),
    ],
)
def test_subjects(spark, text, want):
    quads = spark.createDataFrame([("g", *q, "uri") for q in QUADS], readers.QUADS)
    subjects = spark.createDataFrame([(s,) for s in "abc"], "subject string")
    assert "".join(sorted(r[0] for r in with_criteria(subjects, quads, parse_criteria(text)).collect())) == want


def test_requests():
    r = parse("""PREFIX dcterms: <http://purl.org/dc/terms/> SELECT ?subject FROM <g> WHERE { ?subject a ?type . ?subject dcterms:title 'gfp' . FILTER (CONTAINS(lcase(?displayId), lcase('a')) || CONTAINS(lcase(?name), lcase('a'))) } LIMIT 5""")
    assert r.path == "criteria" and r.keywords == "a" and r.criteria.patterns == (Pattern(S, iri("http://purl.org/dc/terms/title"), Term("gfp", "literal")),)
    assert parse("where { ?subject <http://x/role> \"promoter\" }").path == "criteria"
    with pytest.raises(ValueError):
        parse("where { ?subject <p> }")
