"""Quality rules as a bitmask ledger, DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the measurements and one
failure bit per rule.  Policies are versioned sets of rules; applying one is a bitwise
*and* with the ledger, and ablations (what a policy keeps if one rule is taken out) are
one aggregation over the bits.  ``stored`` writes the ledger to a table, so neither reads the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words: all measurements
are 0 and only the rules on too few words fail.  Very long texts are measured whole; there are no
ties.  An empty table gives an empty ledger.  Repeated rows are measured one by one;
extra columns are kept by ``ledger`` unless their names clash with its own, which win.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: White space between words.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_cased", "n_stutter", "max_word"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _bind(value: Column, body) -> Column:
    """A one-element transform binds an array to a name, so that it is computed once for all lambdas below it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """A hash of every run of eight (``WINDOW``) words, by doubling; empty for shorter texts."""

    def double(step: int):
        return lambda one: F.transform(one, lambda x, i: F.xxhash64(x, F.get(one, i + step)))

    rolled = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        rolled = _bind(rolled, double(step))
    count = F.size(words) - (WINDOW - 1)
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(F.slice(rolled, 1, F.greatest(count, F.lit(1))))


def _repeat_words(words: Column, windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that start at two or more places of the text.

    Texts whose window hashes all differ are done.  Otherwise the hashes are sorted with their
    places; equal neighbours whose words are equal are repeats.  Their places, sorted again,
    give the length of their union.
    """

    def places(keys: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            y = F.get(keys, j)
            return F.coalesce((y["h"] == x["h"]) & (F.slice(words, y["at"] + 1, width) == F.slice(words, x["at"] + 1, width)), F.lit(False))

        return F.sort_array(F.transform(F.filter(keys, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    def union(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_bind(_bind(keyed, places), union)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements of each text (long columns)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    base = docs.drop("_words", "_windows", *MEASURES).withColumn("_words", _words(text)).withColumn("_windows", _window_hashes(F.col("_words")))
    words = F.col("_words")
    long = lambda c: c.cast("long")
    return base.withColumns(
        {
            "n_words": long(F.size(words)),
            "word_chars": long(F.length(F.translate(text, BLANKS, ""))),
            "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
            "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": _repeat_words(words, F.col("_windows")),
            "n_lines": long(F.size(lines)),
            "n_upper": long(F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))),
            "n_cased": long(F.length(text) - F.length(F.regexp_replace(text, "[\\p{Lu}\\p{Ll}]", ""))),
            "n_stutter": long(F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))))),
            "max_word": long(F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0))),
        }
    ).drop("_words", "_windows")


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is a condition on the measurements.  Its bit never changes."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "n_cased >= 40 and 100 * n_upper > 60 * n_cased"),
    Rule(5, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(6, "long_words", "n_words > 0 and word_chars > 15 * n_words"),
    Rule(7, "endless_word", "max_word > 1000"),
    Rule(8, "stutter", "100 * n_stutter > 30 * n_words"),
)

#: Rules that each policy version looks at.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "shouting", "stutter"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "shouting", "short_words", "long_words", "endless_word", "stutter"),
}


def policy_mask(version: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the measurements and ``failed`` (one bit per failed rule)."""
    mask = F.lit(0).cast("long")
    for rule in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).drop("text", "failed").withColumn("failed", mask)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a table in the shared folder, so that policies and ablations read bits and not texts."""
    return materialize(ledger(docs), "ledger")


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(led: DataFrame, version: str) -> DataFrame:
    """One row per rule of the policy: documents failing it, failing it alone, and kept without it."""
    mask = policy_mask(version)
    own = F.col("failed").bitwiseAND(F.lit(mask))
    picked = [r for r in RULES if mask >> r.bit & 1]
    sums = [F.count_if(own.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"any_{r.name}") for r in picked]
    sums += [F.count_if(own == F.lit(1 << r.bit)).alias(f"only_{r.name}") for r in picked]
    one = led.agg(F.count_if(own == 0).alias("clear"), *sums)
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.col(f"any_{r.name}").alias("n_failed"), F.col(f"only_{r.name}").alias("n_only"), (F.col("clear") + F.col(f"only_{r.name}")).alias("kept_without"))
        for r in picked
    ]
    return one.select(F.inline(F.array(*rows)))
