"""Secret scans over a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain: an AND of clauses, a
clause being an OR of alternatives, an alternative an AND of trigrams. The index holds a posting (trigram, document) for
every trigram that some query names, over lower-cased text. Postings are intersected per document; only documents that
satisfy a rule's query are verified with its expression. A rule without a mandatory trigram scans every document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (left to right, not overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Public formats of keys and tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
STRINGS = 64  # literal strings that one clause may name


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Query:
    """Clauses gathered from left to right; ``open`` holds the literal strings that may end here (None: anything)."""

    def __init__(self) -> None:
        self.clauses: list[frozenset[frozenset[str]]] = []
        self.open = {""}

    def close(self) -> None:
        options = {trigrams(x) for x in self.open}
        if options and all(options):
            self.clauses.append(frozenset(x for x in options if not any(y < x for y in options)))
        self.open = {""}

    def follow(self, strings: set[str]) -> None:
        grown = {a + b for a in self.open for b in strings}
        if len(grown) > STRINGS:
            self.close()
            grown = set(strings) if len(strings) <= STRINGS else {""}
        self.open = grown

    def walk(self, tree) -> None:
        for op, arg in tree:
            strings = _strings([(op, arg)])
            if strings is not None:
                self.follow(strings)
            elif op is kinds.SUBPATTERN:
                self.walk(arg[-1])
            elif op is kinds.MAX_REPEAT and arg[0] >= 1:
                once = _strings(arg[2])
                if once is not None:  # the first of several copies is a literal, the next may be anything
                    self.follow(once)
                self.close()
            else:
                self.close()


def _strings(tree) -> set[str] | None:
    """All strings that a part of a pattern matches, lower-cased; None if they are many or without bound."""
    found = {""}
    for op, arg in tree:
        if op is kinds.LITERAL:
            part = {chr(arg).lower()}
        elif op is kinds.IN:
            part = set()
            for what, x in arg:
                if what is kinds.LITERAL:
                    part.add(chr(x).lower())
                elif what is kinds.RANGE and x[1] - x[0] < 8:
                    part |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op is kinds.SUBPATTERN:
            part = _strings(arg[-1])
        elif op is kinds.BRANCH:
            options = [_strings(x) for x in arg[1]]
            part = None if None in options else set().union(*options)
        elif op is kinds.MAX_REPEAT and arg[1] <= 4:
            once = _strings(arg[2])
            part = None if once is None or len(once) ** arg[1] > STRINGS else _repeated(once, *arg[:2])
        else:
            return None
        if part is None or len(found) * len(part) > STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _repeated(once: set[str], least: int, most: int) -> set[str]:
    found, grown = set(), {""}
    for n in range(most + 1):
        if n >= least:
            found |= grown
        grown = {a + b for a in grown for b in once}
    return found


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses of alternatives of trigrams; a text with a match has, for each clause, all trigrams of some alternative."""
    query = _Query()
    query.walk(parser.parse(pattern))
    query.close()
    return sorted(sorted(sorted(x) for x in clause) for clause in set(query.clauses))


def postings(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``(trigram, <id>)`` for every trigram that a rule's query names. A null id is an id like others."""
    names = sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})
    low = docs.select(id_col, F.lower(text_of(text_col)).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in names])) if names else F.array().cast("array<string>")
    return low.select(F.explode(found).alias("trigram"), id_col)


def candidates(index: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id") -> DataFrame:
    """``(<id>, rules)``: documents whose postings satisfy the query of at least one rule that has one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    plan = [
        (t, kind, c, o, len(option), len(query))
        for kind, query in queries.items() for c, clause in enumerate(query) for o, option in enumerate(clause) for t in option
    ]
    names = "trigram string, rule string, clause int, option int, needed int, clauses int"
    terms = F.broadcast(index.sparkSession.createDataFrame(plan, names))  # as many rows as the rules have trigrams
    met = index.distinct().join(terms, "trigram").groupBy(id_col, "rule", "clauses", "clause", "option", "needed").agg(F.count("*").alias("n"))
    met = met.filter("n = needed").groupBy(id_col, "rule", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses")
    return met.groupBy(id_col).agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in code points, end exclusive, as an array of structs ``start, end, kind``."""
    pattern = F.lit(rule.pattern)
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    each = F.arrays_zip(between.alias("gap"), whole.alias("hit"), part.alias("part"))
    each = F.transform(each, lambda x: F.struct(
        F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), F.char_length(x["part"]).alias("part")))
    none = F.array().cast("array<struct<start:int,end:int,long:boolean>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["hit"]).alias("end"), (x["part"] >= rule.least).alias("long"))
        return F.when(x["hit"].isNull(), state).otherwise(
            F.struct((start + x["hit"]).alias("at"), F.array_append(state["found"], span).alias("found")))

    found = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    found = F.when(text.rlike(rule.pattern), found).otherwise(none)
    return F.transform(F.filter(found, lambda x: x["long"]), lambda x: F.struct(x["start"], x["end"]))


def _ranked(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(
    docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
    out: str = "found",
) -> DataFrame:
    """One row per input row: the id, the columns ``keep`` and ``out``, an array of structs ``start, rank, end, kind``
    ordered by start and then by the order of the rules. A null or empty text has none.

    Repeated ids share the candidates of all their rows and are verified each by itself. A null id works like others. Whole
    texts are searched, however long; an empty table gives no rows.
    """
    searched = [r for r in rules if trigram_query(r.pattern)]
    text = F.col("_text")
    base = docs.select(F.col(id_col), *keep, text_of(text_col).alias("_text"))
    if searched:
        possible = candidates(postings(docs, searched, id_col, text_col), searched, id_col).withColumnRenamed(id_col, "_id")
        base = base.join(possible.withColumnRenamed("rules", "_rules"), F.col(id_col).eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = []
    for rank, rule in enumerate(rules):
        here = spans(text, rule)
        if rule in searched:
            here = F.when(F.array_contains("_rules", rule.kind), here).otherwise(none)
        every.append(F.transform(here, _ranked(rank, rule.kind)))
    return base.select(id_col, *keep, F.array_sort(F.concat(*every)).alias(out))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(
    docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]",
    size_col: str | None = None,
) -> DataFrame:
    """``docs`` with the found spans of its text replaced by ``mask``; overlapping spans are one. A null text stays null.

    ``size_col``, if given, is set to the length of the new text.
    """
    others = [c for c in docs.columns if c != id_col]
    found = scan(docs, rules, id_col, text_col, others, "_found")
    merged = F.aggregate(
        "_found", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.array_append(done, F.struct(x["start"].alias("start"), x["end"].alias("end")))),
    )
    text = F.col(text_col).cast("string")
    rest = F.transform("_m", lambda x, i: F.concat(
        F.substring(text, F.coalesce(F.get("_m", i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get("_m", i - 1)["end"], F.lit(0))), F.lit(mask)))
    last = F.element_at("_m", -1)["end"]
    clean = F.when(F.size("_m") == 0, text).otherwise(
        F.concat(F.array_join(rest, ""), F.substring(text, last + 1, F.char_length(text))))
    out = found.withColumn("_m", merged).withColumn(text_col, clean)
    if size_col is not None:
        out = out.withColumn(size_col, F.char_length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)

