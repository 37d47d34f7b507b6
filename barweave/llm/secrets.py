"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived that every match implies.
The index holds, for the trigrams of these queries, the documents that contain them. The
postings are intersected per document; only candidates are matched by the regex. A rule
without mandatory trigrams (a run of hex digits) is matched against every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import id_key, stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the whole match) must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules first. A run of hex digits or a key of fewer characters is dropped by the count
#: in the pattern: the run is taken whole either way.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")

#: A query is None (anything matches), a trigram, or ("and" | "or", parts).
Query = None | str | tuple


def _both(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return parts[0] if len(parts) == 1 else ("and", tuple(parts)) if parts else None


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_text(text: str) -> Query:
    return _both([text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(pattern: str) -> Query:
    """What a text in lower case must contain if ``pattern`` matches somewhere in it.

    The pattern is read by Python's regex compiler. Walking its items, literal text grows a
    set of possible strings; what has no bounded set of texts ends them, and the trigrams
    seen so far stay mandatory.
    """
    most = 16

    def strings(items) -> tuple[set[str] | None, Query]:
        """All texts the items can match (None: not a small set), and their query."""
        done: list[Query] = []
        open_: set[str] = {""}

        def close() -> None:
            done.append(_either([_of_text(s) for s in sorted(open_)]))

        whole = True
        for op, arg in items:
            name, texts, query = str(op), None, None
            if name == "LITERAL":
                texts = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                texts, query = strings(arg[3])
            elif name == "BRANCH":
                ways = [strings(way) for way in arg[1]]
                query = _either([_either([_of_text(s) for s in sorted(t)]) if t is not None else q for t, q in ways])
                if all(t is not None for t, _ in ways):
                    texts = set().union(*(t for t, _ in ways))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                t, q = strings(inner)
                if (low, high) == (0, 1) and t is not None:
                    texts = t | {""}
                elif low > 0:
                    query = q if t is None else _either([_of_text(s) for s in sorted(t)])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                texts = {chr(a).lower() for _, a in arg}
            elif name == "AT":
                continue
            if texts is not None and len(open_) * len(texts) <= most:
                open_ = {a + b for a in open_ for b in texts}
                continue
            close()
            done.append(_either([_of_text(s) for s in sorted(texts)]) if texts is not None else query)
            open_, whole = {""}, False
        if whole:
            return open_, None
        close()
        return None, _both(done)

    texts, query = strings(re._parser.parse(pattern))
    return _either([_of_text(s) for s in sorted(texts)]) if texts is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index: (term, key) for each of ``terms`` in each document."""
    low = F.lower(text_or_empty())
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))
    return docs.select(id_key("doc_id").alias("key"), F.explode(found).alias("term"))


def candidates(index: DataFrame, queries: dict[str, Query], terms: list[str]) -> DataFrame:
    """Per document with postings, whether each rule's query holds.

    Postings are intersected as bits: at most one row per task and document is shuffled.
    """
    number = {t: i for i, t in enumerate(terms)}
    words = range(-(-len(terms) // 62))
    bit = F.create_map(*[F.lit(x) for t in terms for x in (t, number[t])])[F.col("term")]
    masks = index.withColumn("bit", bit).groupBy("key").agg(
        *[
            F.bit_or(F.when((F.col("bit") / 62).cast("int") == w, F.expr(f"shiftleft(1L, bit - {62 * w})")).otherwise(F.lit(0))).alias(f"m{w}")
            for w in words
        ]
    )

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            return F.col(f"m{number[q] // 62}").bitwiseAND(F.lit(1 << (number[q] % 62))) != 0
        parts = [holds(p) for p in q[1]]
        return reduce(lambda a, b: a & b, parts) if q[0] == "and" else reduce(lambda a, b: a | b, parts)

    return masks.select("key", *[holds(q).alias(f"may_{kind}") for kind, q in queries.items()])


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in characters, leftmost and non-overlapping, short ones dropped."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    # The texts between matches, by the same regex; their lengths give the places.
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    steps = F.arrays_zip(between.alias("gap"), found.alias("hit"), measured.alias("part"))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:int>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.length(x["part"]).alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    every = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.filter(every, lambda s: s["part"] >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) with found an array of (start, order, kind, end), sorted.

    A null text is empty and has no spans. Rows may repeat, doc_ids may be null; other
    columns are not read; an empty table gives no rows.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    terms = sorted(set().union(*map(trigrams, queries.values())))
    rows = docs.select("doc_id", id_key("doc_id").alias("key"), text_or_empty().alias("text"))
    if terms:
        index = stored(postings(docs, terms), "postings")
        rows = rows.join(candidates(index, queries, terms), "key", "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")

    def of(order: int, rule: Rule) -> Column:
        may = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) if rule.kind in queries else F.lit(True)
        here = F.transform(
            spans(F.col("text"), rule),
            lambda s: F.struct(s["start"], F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), s["end"]),
        )
        return F.when(may & F.col("text").rlike(rule.pattern), here).otherwise(none)

    return rows.select("doc_id", F.array_sort(F.concat(*[of(i, r) for i, r in enumerate(rules)])).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
