"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy is
a named, versioned mask over those bits, so verdicts, other policies and ablations are bitwise arithmetic on the ledger
and never touch a text again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule name -> (bit, failing condition over the measurements).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "upper_case": (3, "10 * n_upper > 4 * word_chars"),
    "repeated_lines": (4, "10 * n_dup_lines > 3 * n_lines"),
    "word_length": (5, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
}

#: Policy version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "upper_case", "repeated_lines", "word_length"),
}
LATEST = "v2"

_SPACE = r"[\x20\x09-\x0D]+"


def policy_mask(rules: Sequence[str]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the measurements all rules are written over.

    Windows of three words are hashed, and only the windows whose hash is met twice are compared as strings, so the
    count of repeated words is exact. A null text counts as empty: every measurement is zero.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    words = base.select(
        "doc_id",
        F.array_remove(F.split("_t", _SPACE), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    windows = words.select(
        "doc_id",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= 3, F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
        ).alias("_h"),
    )
    order = windows.withColumn(
        "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    twice = order.withColumn("_c", F.filter("_s", lambda s, i: (s["h"] == F.get("_s", i + 1)["h"]) | ((i > 0) & (s["h"] == F.get("_s", F.greatest(i - 1, F.lit(0)))["h"]))))
    named = twice.withColumn(
        "_g",
        F.array_sort(F.transform("_c", lambda s: F.struct(F.concat_ws(" ", F.get("_w", s["i"]), F.get("_w", s["i"] + 1), F.get("_w", s["i"] + 2)).alias("g"), s["i"].alias("i")))),
    )
    found = named.withColumn("_f", F.filter("_g", lambda s, i: (s["g"] == F.get("_g", i + 1)["g"]) | ((i > 0) & (s["g"] == F.get("_g", F.greatest(i - 1, F.lit(0)))["g"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.array_sort(F.transform("_f", lambda s: s["i"])),
        start,
        lambda a, i: F.struct((a["n"] + (i + 3 - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    )
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, tuple[int, str]] = RULES) -> DataFrame:
    """Measurements plus ``fail_bits``: bit k is set where the rule of bit k fails. One row per input row.

    Null and empty texts have no word and fail ``few_words``; repeated rows are judged each; an empty table gives no
    row; other columns are ignored.
    """
    bits = sum((F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, cond in rules.values()), F.lit(0))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def failed(mask: int, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) != 0


def judge(book: DataFrame, policy: str = LATEST) -> DataFrame:
    """Verdict of a policy over a ledger: ``base_failed`` (the first policy's rules) and ``kept``."""
    base, mask = policy_mask(POLICIES["v1"]), policy_mask(POLICIES[policy])
    return book.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base | mask))


def ablations(book: DataFrame, policy: str = LATEST) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it fails, and rejections left without it.

    One pass of partial aggregation over distinct bit patterns (at most 2^rules groups).
    """
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    mask = policy_mask(POLICIES[policy])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("fail_bits", "n", F.explode(rows).alias("r")).select("fail_bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest != 0, F.col("n")).otherwise(0)).alias("n_rejected_without"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = LATEST) -> DataFrame:
    """``docs`` that a policy keeps, columns unchanged.

    The verdict is computed beside the row it judges, so no join or shuffle is needed: the row travels as a struct. The
    filter also tests a row number, which is always true but not deterministic, so the optimizer cannot push the filter
    down and thereby expand the measurements' expressions into one another.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    book = judge(ledger(whole, "_row", "_text"), policy).select(F.col("doc_id").alias("_row"), "kept", F.monotonically_increasing_id().alias("_n"))
    return book.where(F.col("kept") & (F.col("_n") >= 0)).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


#: DuckDB: the same ledger and verdict, from windows and unnested words.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_upper > 4 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept
FROM b
"""
