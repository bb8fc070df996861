"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: an AND of clauses, one for each stretch of
literals that any match must contain, each an OR of the stretch's spellings, each an AND of their trigrams. The index
holds a posting (trigram, document) for the trigrams that occur in some query. Postings are intersected by summing
them up per document and evaluating the queries; only documents that satisfy a rule's query are verified with its
expression. Rules without mandatory trigrams scan every document.

Postings are looked up on A-Z lower-cased text, which can only add candidates. Offsets are code points, end
exclusive. Matches of a rule are leftmost and non-overlapping; one whose value is too short is dropped.

Defined results: null and empty texts have no spans; rows that share a doc_id share postings and are verified one by
one; null doc_ids share one posting list; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A class or a set of spellings of more than this many members ends a literal stretch.
MAX_SPELLINGS = 16
MAX_CLASS = 6


@dataclass(frozen=True)
class Rule:
    """`lead` + `value`; the value needs `least` characters. Both are valid in Java, Python and RE2."""

    kind: str
    lead: str
    value: str
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]+", 24),
)
ADDED_RULES = (
    Rule("forge", "gh[ops]_", "[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[bp]-", "[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----"),
)
RULES = (*BASE_RULES, *ADDED_RULES)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """Clauses that all have to hold; a clause holds if all trigrams of one of its sets occur."""
    clauses: list[set[frozenset[str]]] = []

    def close(spellings: set[str]) -> None:
        sets = {trigrams(s.lower()) for s in spellings}
        if all(sets):
            clauses.append(sets)

    def spell(nodes) -> set[str] | None:
        """All strings that a short sequence can match, or None."""
        out = {""}
        for op, arg in nodes:
            if op is sre.LITERAL:
                step = {chr(arg)}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MAX_CLASS:
                step = {chr(c) for _, c in arg}
            elif op is sre.BRANCH:
                parts = [spell(b) for b in arg[1]]
                step = None if any(p is None for p in parts) else set().union(*parts)
            elif op is sre.SUBPATTERN:
                step = spell(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 5:
                one = spell(arg[2])
                step = None
                if one is not None and len(one) ** arg[1] <= MAX_SPELLINGS:
                    step = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            else:
                step = None
            if step is None or len(out) * len(step) > MAX_SPELLINGS:
                return None
            out = {a + b for a in out for b in step}
        return out

    held = {""}
    for node in sre_parse.parse(pattern):
        step = spell([node])
        if step is not None and len(held) * len(step) <= MAX_SPELLINGS:
            held = {a + b for a in held for b in step}
            continue
        close(held)
        held = step if step is not None else {""}
    close(held)
    return clauses


def query_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.lead + r.value) for s in clause for g in s})


def postings(docs: DataFrame, grams: list[str], doc_id: str = "doc_id") -> DataFrame:
    """The inverted index over `grams`: one row (trigram, doc) for each document that holds a trigram."""
    lowered = docs.select(F.col(doc_id).alias("doc"), F.lower("text").alias("lowered"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col("lowered"), g))
    return lowered.select(F.explode(held).alias("trigram"), "doc")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, rules) of the documents whose postings satisfy the query of a rule."""
    held = index.groupBy("doc").agg(F.collect_set("trigram").alias("held"))  # at most as many as query trigrams

    def satisfied(rule: Rule) -> Column:
        out = F.lit(True)
        for clause in trigram_query(rule.lead + rule.value):
            one_of = F.lit(False)
            for grams in sorted(clause, key=sorted):
                every = F.lit(True)
                for g in sorted(grams):
                    every = every & F.array_contains("held", g)
                one_of = one_of | every
            out = out & one_of
        return out

    flags = F.filter(
        F.array(*[F.when(satisfied(r), r.kind) for r in rules if trigram_query(r.lead + r.value)]),
        lambda k: k.isNotNull(),
    )
    return held.select("doc", flags.alias("rules")).where(F.size("rules") > 0)


def _spans(text: str, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of one rule. Each match of the outer expression is the text before a match
    and the match, or the rest of the text; so one pass over the text yields all lengths."""
    capture = f"(?s)(.*?)(?:({rule.lead})({rule.value})|\\z)"
    parts = F.arrays_zip(
        *[F.regexp_extract_all(text, F.lit(capture), F.lit(g)).alias(n) for g, n in ((1, "gap"), (2, "lead"), (3, "val"))]
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(state: Column, part: Column) -> Column:
        a = state["at"] + F.length(part["gap"])
        b = a + F.length(part["lead"]) + F.length(part["val"])
        span = F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end"))
        good = F.length(part["val"]) >= rule.least
        out = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(b.cast("long").alias("at"), out.alias("out"))

    return F.aggregate(parts, start, step)["out"]


def scan_secrets(
    docs: DataFrame, *, keep: list[str], rules: tuple[Rule, ...] = RULES, prefix: str = "", name: str = "spans"
) -> DataFrame:
    """`keep` columns with the array of spans (start, kind, end), sorted; kind is the rule's place in `rules`."""
    mark = prefix or "__"
    found = candidates(postings(docs, query_trigrams(rules)), rules)
    found = found.select(F.col("doc").alias(mark + "doc"), F.col("rules").alias(mark + "rules"))
    own = docs.select(
        *[F.col(c).alias(c) for c in keep], F.col("doc_id").alias(mark + "id"), F.col("text").alias(mark + "text")
    )
    joined = own.join(found, F.col(mark + "id").eqNullSafe(F.col(mark + "doc")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    arrays = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.lead + rule.value):
            here = F.array_contains(mark + "rules", rule.kind)
        else:
            here = F.col(mark + "text").rlike(f"{rule.lead}{rule.value}" if rule.least == 1 else _at_least(rule))
        arrays.append(F.when(here, _spans(mark + "text", rule, number)).otherwise(none))
    return joined.select(*keep, F.sort_array(F.concat(*arrays)).alias(name))


def _at_least(rule: Rule) -> str:
    """An expression that matches where some value of the rule is long enough: its value is one repeated class."""
    if not re.fullmatch(r"\[[^\]]+\]\+", rule.value):
        return rule.lead + rule.value
    return f"{rule.lead}{rule.value[:-1]}{{{rule.least},}}"
