"""Operator 3: quality rules as a ledger of bits.

Every rule is evaluated once for each whole text; the ledger holds the measurements and the failure bits. A policy
is a version and the rules that it applies, so applying another version or asking what a rule alone
costs is bitwise arithmetic on the ledger and never reads a text again. DataFrame functions only.

A null text has no words, as an empty one: n_words and all measurements are 0 and too_few_words fails. Repeated rows
are judged each for itself; a null doc_id stays null. Columns other than doc_id and text are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_SPACE, Scratch, id_and_text

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WORD_SPACE, " " * len(WORD_SPACE)), " "), "")


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _window(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i + k) for k in range(WINDOW)]


def _covered(w: Column, starts: Column) -> Column:
    """Words in repeated windows: exact, by the windows' own words in sorted order."""

    def by_order(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))
        repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        places = F.array_sort(F.transform(repeated, lambda i: F.get(s, i)["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, zero, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return let(F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *_window(w, i)).alias("w"), i.alias("i")))), by_order)


def n_repeat_words(w: Column) -> Column:
    """Words in windows of five that occur twice or more. Hashes that are all distinct prove that there are none."""

    def some(starts: Column) -> Column:
        hashes = F.transform(starts, lambda i: F.xxhash64(*_window(w, i)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(starts), F.lit(0)).otherwise(_covered(w, starts))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(F.sequence(F.lit(0), F.size(w) - WINDOW), some))


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements."""

    name: str
    fails: str


#: The order fixes the bits of the ledger; new rules go to the end. Distinct words grow with about the root of the length, so a long text repeats
#: one word over and over only if it has few of them by that measure, too; this holds at every length.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_upper > 20 and 2 * n_upper > n_letters"),
    Rule("exclamations", "5 * n_exclamations > n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("one_word_over_and_over", "n_words >= 10 and 4 * n_distinct_words < n_words and n_distinct_words * n_distinct_words < 16 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
#: Version -> rules that it applies.
POLICIES = {1: ("too_few_words", "repeated_words"), 2: tuple(r.name for r in RULES)}
BASE = POLICIES[1]


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failures``: bit i is set if rule i fails."""
    return _measured(id_and_text(docs).select("doc_id", F.col("text").alias("row")), F.col("row"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder: each rule is evaluated once, whatever policies and ablations read it."""
    return Scratch(docs.sparkSession, "quality-ledger").put("ledger", ledger(docs))


def _measured(carried: DataFrame, text: Column) -> DataFrame:
    """``carried`` has doc_id and row; row goes only if it is the text."""
    own = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(own, "\n"), lambda x: F.translate(x, WORD_SPACE, "") != "")
    exact = {
        "word_chars": F.length(F.translate(own, WORD_SPACE, "")),
        "n_symbols": count_of(own, SYMBOLS),
        "n_exclamations": count_of(own, "!"),
        "n_letters": F.length(F.regexp_replace(own, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(own, r"\P{Lu}+", "")),
    }
    by_words = let(words(own), lambda w: F.struct(F.size(w).alias("n_words"), n_repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    # the generator keeps the structs from being computed anew for each field, and for each rule where a filter on the verdict is pushed below
    kept = ["doc_id", "row"] if "row" in carried.columns and dict(carried.dtypes)["row"].startswith("struct") else ["doc_id"]
    told = carried.select(*kept, F.inline(F.array(F.struct(by_words.alias("w"), by_lines.alias("l"), *(c.alias(n) for n, c in exact.items())))))
    fields = ("w.n_words", *exact, "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct_words")
    whole = told.select(*kept, *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in fields))
    failures = F.lit(0)
    for i, r in enumerate(RULES):
        failures = failures.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return whole.withColumn("failures", failures.cast("long"))


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """Adds base_failed and kept; reads only the ledger."""
    fails = lambda names: F.col("failures").bitwiseAND(F.lit(mask(names))) != 0
    return entries.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE) & ~fails(POLICIES[version]))


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail nothing else, which the policy without it would keep."""
    own = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version])))
    bits = [(r.name, 1 << i) for i, r in enumerate(RULES) if r.name in POLICIES[version]]
    sums = [F.sum((own.bitwiseAND(F.lit(b)) != 0).cast("long")).alias(f"f{b}") for _, b in bits] + [F.sum((own == b).cast("long")).alias(f"o{b}") for _, b in bits]
    stacked = ", ".join(f"'{name}', coalesce(f{b}, 0L), coalesce(o{b}, 0L)" for name, b in bits)
    return entries.agg(*sums).selectExpr(f"stack({len(bits)}, {stacked}) as (rule, n_failed, n_only)")


def judged(docs: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    return apply_policy(stored(docs), version)


def passing(docs: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """The documents, all columns, that a policy keeps. Text and verdict stay in one row, so nothing moves and no ledger is stored."""
    names = docs.columns
    carried = docs.select(F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kept = apply_policy(_measured(carried, F.col("row").getField("text").cast("string")), version).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
