"""Quality rules as a bitmask ledger.

Every text is measured once; each rule leaves one failure bit next to the measurements. Policies are
versioned sets of bits: applying one, comparing two, or asking what a rule alone rejects is integer
arithmetic over the ledger, without the texts. The ledger is a narrow map of the input: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, read

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule -> (bit, failure over the measurements). Bits never change their meaning; new rules take new bits.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
}
#: Version -> the rules that reject.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = 2


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; null counts as empty."""
    if not text:
        return (0,) * len(MEASURES)
    ws = text.encode("utf-8", "replace").split()
    n = len(ws)
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in ws), np.int64, n)
        # Pairs first, then pairs with a third word, so that no product leaves 64 bits.
        pair = w[:-1] * len(ids) + w[1:]
        if len(ids) > 1_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        gram = pair[:-1] * len(ids) + w[2:]
        _, at, count = np.unique(gram, return_inverse=True, return_counts=True)
        twice = count[at] > 1
        if twice.any():
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= twice
            repeat = int(cover.sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeat


def _measures(batches):
    for batch in batches:
        rows = np.array([measure(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
        yield pa.record_batch([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=[batch.schema.names[0], *MEASURES])


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and fail_bits, one row per row of docs.

    Null or empty texts have no words and fail the rules that say so; repeated ids, ties and other
    columns do not matter; texts are measured whole, one at a time; an empty table gives an empty ledger.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(id_col, text_col).mapInArrow(_measures, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fails in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total.cast("long"))


def mask(policy: int | tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in (POLICIES[policy] if isinstance(policy, int) else policy))


def rejects(policy: int | tuple[str, ...]) -> Column:
    """True where a policy rejects a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(rows: DataFrame, policy: int | tuple[str, ...] = CURRENT) -> DataFrame:
    """Per rule of a policy: how many rows fail it, and how many only it rejects. One pass over the ledger."""
    names = POLICIES[policy] if isinstance(policy, int) else policy
    inside = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = []
    for r in names:
        bit = F.lit(1 << RULES[r][0]).cast("long")
        sums += [F.count_if(inside.bitwiseAND(bit) != 0).alias(f"{r}__fails"), F.count_if(inside == bit).alias(f"{r}__alone")]
    one = rows.agg(F.count("*").alias("n"), F.count_if(inside != 0).alias("n_rejected"), *sums)
    stack = ", ".join(f"'{r}', {r}__fails, {r}__alone" for r in names)
    return one.selectExpr(f"stack({len(names)}, {stack}) AS (rule, n_fails, n_alone)", "n", "n_rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents"))
    base = rejects(1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejects(CURRENT)).alias("kept"), "n_lines", "fail_bits", F.lit(CURRENT).alias("policy"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM d, unnest(range(1, len(ws) - 1)) AS t(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits, 2 AS policy
FROM b
"""


def ablation_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and what only it rejects."""
    return ablation(ledger(read(spark, sf_dir, "documents")))


ABLATION_ORACLE = (
    f"WITH rows AS ({ORACLE}), p AS (SELECT *, fail_bits & {mask(CURRENT)} AS bits FROM rows)\n"
    + "\nUNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE bits & {1 << RULES[r][0]} <> 0) AS n_fails, count(*) FILTER (WHERE bits = {1 << RULES[r][0]}) AS n_alone, count(*) AS n, count(*) FILTER (WHERE bits <> 0) AS n_rejected FROM p" for r in POLICIES[CURRENT])
)
