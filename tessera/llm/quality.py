"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and a mask with one bit per failed rule.
A policy is a named, versioned set of bits.  Applying a policy, or asking what would change without one of its rules,
reads only masks.  DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> (bit, condition over the measurements that holds where a document fails).  Stored ledgers keep their meaning:
#: a rule's bit never changes and is never used again; new rules take new bits.
RULES: dict[str, tuple[int, str]] = {
    "short": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "upper_case": (3, "10 * n_upper > 4 * n_letters"),
    "duplicate_lines": (4, "10 * n_dup_lines > 5 * n_lines"),
    "short_words": (5, "word_chars < 2 * n_words"),
    "long_words": (6, "word_chars > 20 * n_words"),
    "few_letters": (7, "2 * n_letters < word_chars"),
}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


#: What the base contract asks for.
BASE = Policy("base", 1, ("short", "repeated_words"))
#: The verdict of this library.  Repeated lines, which some clean texts have, are only measured.
STANDARD = Policy("standard", 1, ("short", "repeated_words", "symbols", "upper_case", "short_words", "long_words", "few_letters"))

_WS = r"\\x20\\x09-\\x0D"

#: Words in 3-word windows found twice or more.  Windows are 64-bit hashes; only texts with a repeated hash sort them.
_REPEATS = """
CASE WHEN size(win) = size(array_distinct(win)) THEN 0L ELSE
  element_at(transform(array(sort_array(transform(win, (x, i) -> struct(x AS h, i AS i)))), s ->
    aggregate(
      sort_array(transform(filter(s, (e, k) -> coalesce(e.h = get(s, k - 1).h, false) OR coalesce(e.h = get(s, k + 1).h, false)), e -> e.i)),
      struct(0L AS n, -3 AS last),
      (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last),
      a -> a.n)), 1)
END
"""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of every whole text; null counts as empty."""
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("bare", F.expr("trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM t)"))
    t = t.withColumn("w", F.expr(f"CASE WHEN bare = '' THEN array() ELSE split(bare, '[{_WS}]+') END"))
    t = t.withColumn("lines", F.expr(f"filter(split(t, '\\n'), l -> l RLIKE '[^{_WS}]')"))
    t = t.withColumn("win", F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
    return t.select(
        "doc_id",
        F.expr("CAST(size(w) AS BIGINT)").alias("n_words"),
        F.expr("CAST(length(translate(t, ' \\t\\n\\u000b\\u000c\\r', '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(f"CAST({_REPEATS} AS BIGINT)").alias("n_repeat_words"),
        F.expr("CAST(size(lines) AS BIGINT)").alias("n_lines"),
        F.expr("CAST(length(regexp_replace(t, '[^\\\\p{L}]+', '')) AS BIGINT)").alias("n_letters"),
        F.expr("CAST(length(regexp_replace(t, '[^\\\\p{Lu}]+', '')) AS BIGINT)").alias("n_upper"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``: bit i is set if rule i fails.

    Null and empty texts have no words and fail ``short``.  Ids may be null or repeat; each row stands for itself.  An
    empty table gives no rows; extra columns are ignored; very long texts are measured whole.
    """
    m = measure(docs, id_col, text_col)
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in RULES.values()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return m.withColumn("failed", mask.cast("long"))


def apply_policy(marked: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Add the policy's verdict."""
    return marked.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(marked: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those it alone removes.  One pass over masks.

    Documents are first counted by mask, of which there are at most ``2 ** rules``.  Repeated rows count each; an empty
    ledger gives zeros.
    """
    by_mask = marked.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    aggs = []
    for r in policy.rules:
        bit = 1 << RULES[r][0]
        aggs += [
            F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias(f"f_{r}"),
            F.coalesce(F.sum(F.when(F.col("m") == bit, F.col("n"))), F.lit(0)).alias(f"a_{r}"),
        ]
    row = by_mask.agg(*aggs)
    stack = ", ".join(f"'{r}', f_{r}, a_{r}" for r in policy.rules)
    return row.selectExpr(f"'{policy.name}' AS policy", f"{policy.version} AS version", f"stack({len(policy.rules)}, {stack}) AS (rule, n_failed, n_removed_alone)")


def verdicts(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger, base verdict and the policy's verdict per document."""
    marked = ledger(docs, id_col, text_col).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0)
    return apply_policy(marked, Policy(policy.name, policy.version, tuple(dict.fromkeys((*BASE.rules, *policy.rules)))))


#: DuckDB SQL for ``op3`` on the view ``documents``.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters,
        CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_upper > 4 * n_letters THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, failed,
  (failed & 3) <> 0 AS base_failed, (failed & 239) = 0 AS kept FROM f
"""
