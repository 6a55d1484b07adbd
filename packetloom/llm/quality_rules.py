"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, and its measurements
stay beside it.  Policies are versioned masks over the bits; verdicts, and what each rule adds to a
policy, come from bitwise work on the ledger without looking at a text again.

Words are `[^\\x20\\x09-\\x0D]+`.  Nulls: a null text has no words and no lines; a null doc_id stays
null.  Repeated rows each have a ledger row.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shared, textbytes as tb

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

#: (bit, name, failure as SQL over the measurements); bits are never used again for another rule.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeats", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 5 * word_chars"),
    (3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
    (6, "shouting", "100 * n_upper > 50 * word_chars"),
)
#: Versions of policies: the rules that count.
POLICIES = {
    "base-1": ("few_words", "repeats"),
    "text-1": ("few_words", "repeats", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}
CURRENT = "text-1"


def mask(policy: str) -> int:
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[policy])


def repeated(g: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the values occur twice or more in their row."""
    if len(g) < 2:
        return np.zeros(len(g), bool)
    key = tb.mix(g ^ (row.astype(np.uint64) * tb.U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(g), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of every row of one slice of text."""
    rows = len(offs) - 1

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    solid = ~tb.WHITE[data]
    _, _, row, h = tb.words(data, offs)
    g, at = tb.shingles(h, row, 3)
    step = np.zeros(len(h) + 1, np.int64)
    again = at[repeated(g, row[at])]
    np.add.at(step, again, 1)
    np.add.at(step, again + 3, -1)
    start, end, line_row, line = tb.words(data, offs, NEWLINE)
    total = np.concatenate([[0], np.cumsum(solid)])
    worded = total[end] > total[start]
    line, line_row = line[worded], line_row[worded]
    key = np.unique(tb.mix(line ^ (line_row.astype(np.uint64) * tb.U64(0x9E3779B97F4A7C15))), return_index=True)[1] if len(line) else np.empty(0, np.int64)
    n_lines = np.bincount(line_row, minlength=rows)
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": count(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": count(SYMBOL[data]),
        "n_dup_lines": n_lines - np.bincount(line_row[key], minlength=rows),
        "n_repeat_words": np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=rows) if len(h) else np.zeros(rows, np.int64),
        "n_lines": n_lines,
        "n_upper": count((data >= 65) & (data <= 90)),
    }


def measurements(docs: DataFrame) -> DataFrame:
    shared.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(1))
            for i, j in tb.row_slices(offs):
                got = measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits long."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, rule in RULES), F.lit(0)).cast("long")
    return measurements(docs).withColumn("fail_bits", bits)


def passes(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(mask(policy)) == 0


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, failed (documents that fail it), alone (that fail nothing else of
    the policy), kept_without (kept by the policy without it).  The ledger is first counted by its bits,
    which leaves 2**rules rows at most."""
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(mask(policy)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    spark = entries.sparkSession
    rules = spark.createDataFrame([(name, 1 << bit) for bit, name, _ in RULES if name in POLICIES[policy]], "rule string, bit long")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    joined = rules.join(F.broadcast(counts), F.lit(True), "left")  # a fixed set of rules against 2**rules counts
    return joined.groupBy("rule").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), hit(F.col("bits") == F.col("bit")).alias("alone"), hit(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without")
    )


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(mask("base-1")) != 0
    return ledger(shared.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (passes() & ~base).alias("kept"), "fail_bits")


OP2_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w WHERE len(w) >= 3
), b AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), c AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM b) GROUP BY r
), m AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN c ON c.r = w.r
), f AS (
  SELECT *, """
    + " + ".join(f"(CASE WHEN {rule} THEN {1 << bit} ELSE 0 END)" for bit, _, rule in RULES)
    + r""" AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM f
"""
)
