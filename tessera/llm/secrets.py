"""Operator 5: secret scans through a trigram inverted index, with DataFrame operations only.

Each rule's regex is parsed into a Boolean query over lower-cased trigrams that any match must hold. The index has, for
each block of doc_ids, one posting list for each trigram in use; the query unites and intersects the lists; only the
documents that remain are verified with the regex. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_ids

#: Matches of a text that are added up at a time.
PART = 256

#: Strings that one part of a regex may stand for before it counts as open.
MOST_STRINGS = 24

#: doc_ids of a block share posting lists, so no list grows beyond it.
BLOCK_IDS = 4096


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more; the others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. A hexadecimal run of 32 or more is a maximal run, so it can be asked for directly; the same holds for access keys.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Rules that the scan adds to the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets: every match of the pattern holds, for each part, one whole set.

    Lower-cased; an empty list means that no trigram is mandatory.
    """
    parts: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            parts.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def walk(items, strings: set[str]) -> set[str]:
        """Strings that may stand at the end of what was read so far, exactly since the last close()."""
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
                more = {chr(v).lower() for _, v in arg}
            elif op is sre.SUBPATTERN:
                strings = walk(arg[3], strings)
                continue
            elif op is sre.BRANCH:
                ends = [walk(b, {""}) for b in arg[1] if all(k in (sre.LITERAL, sre.IN, sre.MAX_REPEAT) for k, _ in b)]
                more = set().union(*ends) if len(ends) == len(arg[1]) else set()
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1) and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
                more = {"", chr(arg[2][0][1]).lower()}
            else:
                more = set()
            if more and len(strings) * len(more) <= MOST_STRINGS:
                strings = {s + m for s in strings for m in more}
            else:
                close(strings)
                strings = {""}
        return strings

    close(walk(sre_parser.parse(pattern), {""}))
    return parts


def posting_lists(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (block, p0, p1, ...), where p<i> lists the block's doc_ids whose text holds trigram i."""
    low = docs.select(F.col("doc_id"), F.lower("text").alias("low"))
    lists = [F.collect_set(F.when(F.contains("low", F.lit(t)), F.col("doc_id"))).alias(f"p{i}") for i, t in enumerate(trigrams)]
    return low.where(F.col("doc_id").isNotNull()).groupBy(F.floor(F.col("doc_id") / BLOCK_IDS).alias("block")).agg(*lists)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, rules): a bit for each rule whose trigram query holds; None if no rule has one."""
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    if not asked:
        return None
    trigrams = sorted({t for q in asked.values() for part in q for s in part for t in s})
    at = {t: F.col(f"p{i}") for i, t in enumerate(trigrams)}
    both = lambda x, y: F.array_intersect(x, y)
    either = lambda x, y: F.array_union(x, y)
    found = {k: reduce(both, [reduce(either, [reduce(both, [at[t] for t in sorted(s)]) for s in part]) for part in q]) for k, q in asked.items()}
    each = F.array(*[F.struct(F.lit(1 << k).alias("rule"), ids.alias("ids")) for k, ids in found.items()])
    hits = posting_lists(docs, trigrams).select(F.explode(each).alias("x")).select(F.col("x.rule").alias("rule"), F.explode("x.ids").alias("doc_id"))
    return hits.groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Structs (start, kind, end) of a rule's matches: text between matches and the matches add up to the positions.

    Matches are added up in parts of PART and then part by part, so that appending to an array doesn't copy all matches each time.
    """
    pattern = F.lit(rule.pattern)
    whole, kept = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), kept.alias("part"))
    one = "struct<start:bigint,kind:int,end:bigint>"
    start_of = lambda kind: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["hit"], F.lit("")))
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    def move(acc: Column, part: Column) -> Column:
        moved = F.transform(part["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    def parts(all_steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.call_function("div", F.size(all_steps) - 1, F.lit(PART)).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(all_steps, k * PART + 1, F.lit(PART)), start_of(one), step))

    # A lambda's own variable is worked out once; an expression from outside would be for each element.
    return F.get(F.transform(F.array(steps), lambda s: F.aggregate(parts(s), start_of(f"array<{one}>"), move, lambda acc: F.flatten(acc["spans"]))), F.lit(0))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, spans): structs (start, kind, end) of all rules, by start and then by the rule's place; code points, end exclusive.

    A null or empty text has no spans. Rows with a null doc_id can't be in a posting list and are verified directly;
    rows with one doc_id share their candidate bits and are verified each; an empty table gives no rows. Other columns are
    left out. Candidates' ids are broadcast if their count is bounded, so that texts aren't shuffled; rules without
    mandatory trigrams need no join at all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    everywhere = sum(1 << k for k, r in enumerate(rules) if not trigram_query(r.pattern))
    found = candidates(docs, rules)
    joined = docs.withColumn("rules", F.lit(0)) if found is None else with_ids(docs, cut(found, "candidates"))
    bits = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(everywhere)))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = [F.when((F.col("bits").bitwiseAND(F.lit(1 << k)) != 0) & F.regexp_like("text", F.lit(r.pattern)), rule_spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return joined.withColumn("bits", bits).select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
