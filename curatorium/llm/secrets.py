"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression. `trigram_query` derives from it a conjunction of clauses, each a list of alternatives, each a set of
trigrams that any match must hold. The index lists, for each trigram that some rule needs, the documents that hold it; intersecting
the postings gives a rule's candidate documents, and only these are searched with the rule. A rule whose expression
forces no trigram (the run of hexadecimal digits) searches every document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.llm import spans

_MOST = 32  # strings kept exactly while a query is derived


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group that must have at least `least` characters, and whether it belongs to the base."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A run's first match of "24 or more" is the whole run, so the length may stand in the expression; likewise for AKIA.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # With the key itself, up to its END line, or to the text's end where that line is missing.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,20}PRIVATE KEY-----|(?![\s\S]))"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("host_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"(?:xoxb|xoxa|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{24,}"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold for a match; a clause holds if some alternative has all its trigrams in the text folded to lower case. No clause: nothing is forced."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        alternatives = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
        if alternatives and all(alternatives):
            least = [a for a in alternatives if not any(b < a for b in alternatives)]
            clauses.append(sorted(least, key=sorted))

    def exact(items) -> set[str] | None:
        """All strings the items match, if these are few."""
        out = {""}
        for op, arg in items:
            if op is c.LITERAL:
                more = {chr(arg).lower()}
            elif op is c.IN and all(x[0] is c.LITERAL for x in arg):
                more = {chr(x[1]).lower() for x in arg}
            elif op is c.SUBPATTERN:
                more = exact(arg[3])
            elif op is c.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] != c.MAXREPEAT and arg[1] <= 2 and (one := exact(arg[2])) is not None:
                more = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
            else:
                return None
            if more is None or len(out) * len(more) > _MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        held = {""}
        for item in items:
            one = exact([item])
            if one is not None and len(held) * len(one) <= _MOST:
                held = {a + b for a in held for b in one}
                continue
            close(held)
            held = one if one is not None else {""}
            if one is None:
                op, arg = item
                if op is c.SUBPATTERN:
                    walk(arg[3])
                elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                    walk(arg[2])
        close(held)

    walk(parser.parse(pattern))
    return clauses


def trigrams(rules=RULES) -> list[str]:
    """Every trigram that some rule's query names."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for some in clause for g in some})


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: one row (trigram, doc_id) for each needed trigram that a document's lower-cased text holds."""
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in trigrams(rules)]))
    return folded.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): the postings intersected by each rule's query; documents without a candidate rule have no row."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    found = []
    for rule in rules:
        if query := trigram_query(rule.pattern):
            every = [_any(F.size(F.array_except(F.array(*map(F.lit, sorted(some))), "held")) == 0 for some in clause) for clause in query]
            found.append(F.when(_all(every), F.lit(rule.kind)))
    return held.select("doc_id", F.array_compact(F.array(*found)).alias("rules")).where(F.size("rules") > 0)


def _any(tests) -> Column:
    out = None
    for x in tests:
        out = x if out is None else out | x
    return out


def _all(tests) -> Column:
    out = None
    for x in tests:
        out = x if out is None else out & x
    return out


def _at_least(least: int):
    return lambda part: F.length(part) >= least


def scan(docs: DataFrame, rules=RULES, into: str = "secrets") -> DataFrame:
    """docs with a column `into`, an array of (start, place, end, kind) by start, then by the rule's place; code points, end exclusive.

    Matches of one rule are its leftmost non-overlapping ones, those that are too short dropped; spans of different rules may overlap.
    Null and empty texts have none. Rows that repeat a doc_id share candidate rules, as do rows without one that have equal texts, but are searched each by
    its own text. A column of docs named as `into` is replaced, all others are kept. An empty table gives no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    docs = docs.select(whole.alias("row"), F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    found = candidates(postings(docs.select(F.col("key").alias("doc_id"), text.alias("text")), rules), rules).select(F.col("doc_id").alias("of"), "rules")
    rows = docs.join(found, F.col("key") == F.col("of"), "left").drop("key", "of")
    names = []
    for k, rule in enumerate(rules):
        wanted = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        rows = rows.withColumn(f"m{k}", F.when(wanted, F.regexp_extract_all(text, F.lit(rule.pattern), 0)))
    for k, rule in enumerate(rules):
        hit = F.size(f"m{k}") > 0
        rows = rows.withColumn(f"p{k}", F.when(hit, F.split(text, rule.pattern, -1)))
        rows = rows.withColumn(f"g{k}", F.when(hit, F.regexp_extract_all(text, F.lit(rule.pattern), rule.group))) if rule.group else rows
    for k, rule in enumerate(rules):
        long = F.transform(f"g{k}", _at_least(rule.least)) if rule.group else None
        found = spans.spans(rule.kind, k, F.col(f"m{k}"), F.col(f"p{k}"), long)
        names.append(F.coalesce(F.when(F.size(f"m{k}") > 0, found), spans.none()))
    return rows.select("row.*", F.array_sort(F.concat(*names)).alias(into))


def spans_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(kind: str) -> Column:
    """How many spans of that kind the column secrets holds."""
    return F.size(F.filter("secrets", lambda s: s["kind"] == F.lit(kind))).cast("bigint")


def base_spans(found: Column, rules=RULES) -> Column:
    base = [r.kind for r in rules if r.base]
    return F.filter(found, lambda s: s["kind"].isin(base))


def _united(found: Column) -> Column:
    """Spans by start to (start, end), those that overlap made one."""
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(found, zero, step)


def masked(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by `mask`, spans that overlap by one. n_chars, if a column, is counted anew."""
    into = "secrets" + "_" * (1 + max(map(len, docs.columns)))  # no column of docs is named so
    rows, found = scan(docs, rules, into), F.col(into)
    changes = F.transform(_united(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask).alias("new")))
    built = spans.rebuilt(F.col("text"), changes)
    rows = rows.withColumn("text", F.when(F.size(found) > 0, built).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.drop(into)
