"""Criteria of a query, triple patterns and filters about ?subject, as semi-joins over the statements.

Patterns may lead from ?subject over other variables, in either direction. What is not understood is refused, so that a
criterion is never ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "subject"
#: Variables that the basic pattern binds to columns of a part: they say nothing by themselves.
COLUMNS = {"type", "displayId", "version", "name", "description", "percentMatch", "strandAlignment", "CIGAR", "role", "sboltype", "graph"}
_TERM = re.compile(r"""\s*(?:(?P<iri><[^<>\s]*>)|(?P<literal>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?:@[\w-]+|\^\^(?:<[^<>\s]*>|[\w-]*:[\w-]+))?|\?(?P<var>\w+)|(?P<end>[.;,])(?=\s|$)|(?P<name>[\w-]*:[\w.-]*[\w-]|[\w-]+))""")
_FILTERS = (  # one variable against one text
    re.compile(r"""^(?P<low>lcase\s*\(\s*)?\?(?P<var>\w+)\s*\)?\s*(?P<op>=|!=)\s*(?:lcase\s*\(\s*)?(?P<value>"[^"]*"|'[^']*'|<[^>]*>)\s*\)?$""", re.I),
    re.compile(r"""^(?P<op>CONTAINS|STRSTARTS|STRENDS)\s*\(\s*(?:str\s*\(\s*)?(?P<low>lcase\s*\(\s*)?\?(?P<var>\w+)\s*\)?\s*,\s*(?:lcase\s*\(\s*)?(?P<value>"[^"]*"|'[^']*')\s*\)?\s*\)$""", re.I),
    re.compile(r"""^(?P<op>regex)\s*\(\s*(?:str\s*\(\s*)?\?(?P<var>\w+)\s*\)?\s*,\s*(?P<value>"[^"]*"|'[^']*')\s*(?P<low>,\s*["']i["']\s*)?\)$""", re.I),
)


@dataclass(frozen=True)
class Term:
    """A variable, an IRI or a literal; only variables are not constants."""

    value: str
    kind: str


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term


@dataclass(frozen=True)
class Condition:
    """A condition on a variable's value."""

    var: str
    op: str
    value: str
    any_case: bool

    def holds(self, x: Column) -> Column:
        if self.op == "regex":
            return F.regexp_like(x, F.lit(("(?i)" if self.any_case else "") + self.value))
        left, right = (F.lower(x), F.lit(self.value.lower())) if self.any_case else (x, F.lit(self.value))
        return {"=": lambda: left == right, "!=": lambda: left != right, "contains": lambda: F.contains(left, right), "strstarts": lambda: F.startswith(left, right), "strends": lambda: F.endswith(left, right)}[self.op]()


@dataclass(frozen=True)
class Criteria:
    patterns: tuple[Pattern, ...] = ()
    tests: tuple[Condition, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.patterns)


def _blocks(body: str) -> tuple[str, list[str]]:
    """body without OPTIONAL blocks, and without FILTERs, whose conditions are returned."""
    out, filters, i = [], [], 0
    while m := re.compile(r"\b(OPTIONAL\s*\{|FILTER\b\s*(?:\w+\s*)?\()", re.I).search(body, i):
        out.append(body[i : m.start()])
        opening, closing = ("{", "}") if m[0].endswith("{") else ("(", ")")
        depth, k, quote = 1, m.end(), ""
        while k < len(body) and depth:
            c = body[k]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c == opening) - (c == closing)
            k += 1
        if depth:
            raise ValueError(f"not closed: {body[m.start():]}")
        if opening == "(":
            word = re.match(r"FILTER\s*(\w*)", m[0], re.I)[1]
            filters.append(f"{word}({body[m.end():k - 1]})" if word else body[m.end() : k - 1])
        i = k
    return "".join([*out, body[i:]]), filters


def _test(text: str) -> Condition:
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    for form in _FILTERS:
        if m := form.match(text):
            return Condition(m["var"], m["op"].lower(), m["value"][1:-1], bool(m["low"]))
    raise ValueError(f"filter not understood: {text}")


def parse_criteria(body: str, prefixes: dict[str, str] | None = None, keywords: re.Pattern | None = None) -> Criteria:
    """The patterns and filters of a query's body. Filters that hold nothing but keywords (by that pattern) are left out,
    as are the basic pattern's own triples. ValueError for what is not understood, and for variables that don't lead to
    ?subject."""
    prefixes = prefixes or {}
    body, filters = _blocks(body)
    tests = []
    for text in filters:
        if text.strip() and (rest := keywords.sub("", text) if keywords else text).strip(" ()|&\n\t\r."):
            tests += [_test(x) for x in re.split(r"&&", rest)]
    terms: list[Term] = []
    statements: list[list[Term]] = []
    at = 0
    body = re.sub(r"(?<=[\s>\"'])\.(?=\S)", ". ", body.strip())
    while at < len(body):
        m = _TERM.match(body, at)
        if not m or m.end() == at:
            if not body[at:].strip(" .;\n\t\r"):
                break
            raise ValueError(f"criteria not understood: {body[at:].strip()}")
        at = m.end()
        if m["end"]:
            if terms:
                statements.append(terms)
            terms = statements[-1][: {".": 0, ";": 1, ",": 2}[m["end"]]] if statements else []
        elif m["var"]:
            terms.append(Term(m["var"], "var"))
        elif m["iri"]:
            terms.append(Term(m["iri"][1:-1], "iri"))
        elif m["literal"]:
            terms.append(Term(re.sub(r"\\(.)", r"\1", m["literal"][1:-1]), "literal"))
        else:
            prefix, colon, local = m["name"].partition(":")
            terms.append(Term(prefixes[prefix] + local if colon and prefix in prefixes else m["name"], "iri"))
    if terms:
        statements.append(terms)
    if bad := [s for s in statements if len(s) not in (0, 3)]:
        raise ValueError("not a triple: " + " ".join(t.value for t in bad[0]))
    found = [Pattern(*s) for s in statements if s]
    used = {t.var for t in tests} | {p.s.value for p in found if p.s.kind == "var" and p.s.value != ROOT}
    basic = lambda p: p.s == Term(ROOT, "var") and (p.o == p.s or (p.o.kind == "var" and p.o.value in COLUMNS and p.o.value not in used))
    out = Criteria(tuple(p for p in found if not basic(p)), tuple(tests))
    _check(out)
    return out


def _ends(p: Pattern) -> list[str]:
    return [t.value for t in (p.s, p.o) if t.kind == "var"]


def _check(criteria: Criteria) -> None:
    reached, open_ = {ROOT}, list(criteria.patterns)
    while near := [p for p in open_ if reached & set(_ends(p))]:
        for p in near:
            if set(_ends(p)) <= reached and len(_ends(p)) == 2:
                raise ValueError("patterns that form a circle are not served")
            reached |= set(_ends(p))
            open_.remove(p)
    if open_ or any(t.var not in reached for t in criteria.tests) or any(p.p.kind == "literal" or p.s.kind == "literal" for p in criteria.patterns):
        raise ValueError("criteria that don't lead to ?subject")


def _holding(quads: DataFrame, criteria: Criteria, var: str, used: frozenset[Pattern]) -> Iterable[DataFrame]:
    """For each pattern of the variable, the values (v) that have it."""
    for p in criteria.patterns:
        if p in used or var not in _ends(p):
            continue
        own, other, far = ("s", "o", p.o) if p.s == Term(var, "var") else ("o", "s", p.s)
        rows = quads if p.p.kind == "var" else quads.where(F.col("p") == p.p.value)
        if far.kind != "var":
            yield rows.where(F.col(other) == far.value).select(F.col(own).alias("v"))
            continue
        for t in criteria.tests:
            if t.var == far.value:
                rows = rows.where(t.holds(F.col(other)))
        for inner in _holding(quads, criteria, far.value, used | {p}):
            rows = rows.join(inner.withColumnRenamed("v", other), other, "left_semi")
        yield rows.select(F.col(own).alias("v"))


def with_criteria(subjects: DataFrame, quads: DataFrame, criteria: Criteria) -> DataFrame:
    """The subjects (column subject) that meet all criteria."""
    for t in criteria.tests:
        if t.var == ROOT:
            subjects = subjects.where(t.holds(F.col("subject")))
    for rows in _holding(quads, criteria, ROOT, frozenset()):
        subjects = subjects.join(rows.withColumnRenamed("v", "subject"), "subject", "left_semi")
    return subjects
