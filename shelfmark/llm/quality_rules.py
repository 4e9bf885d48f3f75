"""Quality rules as a ledger: measure once, keep the failures as bits, decide later.

`ledger` reads each text once and stores the measurements and one bit per failed rule. A `Policy` names the rules
of one version; it, and every question of the kind "what if this rule went", needs the bits alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import field, keyed_texts, map_rows, words_of

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a SQL condition over the measurements, is true. Its bit never changes its meaning:
    a changed condition is a new rule with a new bit."""
    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
)
POLICIES = (
    Policy("base", ("few_words", "repeated_windows")),
    Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")),
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = words_of(text)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    # every UTF-8 character has one byte that is not a continuation byte
    chars = len(b"".join(words).translate(None, bytes(range(0x80, 0xC0))))
    return len(words), chars, n_symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, the measurements, `failed_bits` (bit b set: the rule with bit b fails).

    n_lines counts \\n-split lines with a word, n_dup_lines those equal to an earlier one. A null or blank text has
    all measurements 0 and so fails only rules that 0 fails. Repeated rows give repeated rows; null keys stay null;
    other columns are ignored; an empty table gives an empty ledger.
    """
    def per_batch(batch):
        return dict(zip(MEASURES, zip(*map(measure, batch.column("text").to_pylist()))))

    rows = map_rows(keyed_texts(docs, key, text), per_batch, [field(m, "bigint") for m in MEASURES])
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("bigint"))
    return rows.withColumn("failed_bits", bits).withColumnRenamed("key", key)


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {rule.name: 1 << rule.bit for rule in rules}
    return sum(bits[name] for name in set(policy.rules))


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("bigint")) != 0


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with one boolean column kept_<version> for each policy; texts are not read again."""
    return rows.select("*", *((~fails(p, rules)).alias(f"kept_{p.version}") for p in policies))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that fail nothing else (they return if the rule goes).
    Counting works on the distinct bit patterns, at most 2 to the number of rules, which is all that is shuffled."""
    mask = F.lit(mask_of(policy, rules)).cast("bigint")
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules if r.name in policy.rules))
    per_rule = patterns.select("bits", "n", F.explode(named).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return per_rule.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
        F.sum("n").alias("n_rows")).select(F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only_this_rule", "n_rows")


def keep(docs: DataFrame, policy: Policy = POLICIES[-1], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text fails no rule of the policy. The verdict is made beside the row, so
    nothing is shuffled and repeated keys do no harm."""
    def per_batch(batch):
        return dict(zip(MEASURES, zip(*map(measure, batch.column("text").to_pylist()))))

    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"))
    rows = map_rows(packed, per_batch, [field(m, "bigint") for m in MEASURES], keep=("row",))
    failed = F.lit(False)
    for rule in RULES:
        if rule.name in policy.rules:
            failed = failed | F.expr(rule.fails)
    return rows.where(~failed).select("row.*")
