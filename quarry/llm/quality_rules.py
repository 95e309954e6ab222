"""Quality rules as a bitmask ledger (operator 10, DataFrame functions only).

``ledger`` evaluates every rule once, giving the measurements together with a bitmask of failed rules, and
``store`` writes it. A policy is a versioned mask of rules: ``apply_policy`` rejects a document if its
failure bits meet the mask, so policies change without measuring again, and ``ablation`` counts
from the stored bits what each rule rejects, and what it alone rejects. ``keep`` filters documents in one
pass without a ledger beside them; there only the rules of its policy are evaluated.

All rules look at one document only, so the plan is one narrow stage without a shuffle; no
key, source or group of copies can make a task larger than its input split.

Defined results: null or empty text has no words, all counts 0, and fails the rule ``few_words``.
Repeated rows and repeated or null ids are judged row by row. Only the id and the text are read
(plus the whole row with ``carry``), so other columns may bear any name. Very long texts are measured whole; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, save, table

#: (name, SQL condition over the measurements that marks a failure); the bit is the place in this list.
#: All comparisons are between whole numbers, so that any engine decides alike.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting_marks", "10 * n_marks > 4 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 60 * n_words"),
    ("few_letters", "2 * n_digits > word_chars"),
    ("upper_case", "n_upper >= 40 and 2 * n_upper > word_chars"),
    ("few_stop_words", "n_words >= 50 and n_stop_words < 2"),
    ("odd_word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("few_lettered_words", "5 * n_lettered < 4 * n_words"),
    ("bullets", "10 * n_bullets > 9 * n_lines"),
    ("ellipses", "10 * n_ellipses > 3 * n_lines"),
    ("unended_lines", "n_lines >= 4 and 10 * n_ended < n_lines"),
    ("braces", "10 * n_braces > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "shouting_marks", "repeated_lines", "long_words", "few_letters", "upper_case"],
    "v2": [name for name, _ in RULES],
}

#: Frequent English words; prose has some of them. Fixed values.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")

#: Counts over the words ``w`` and the lines ``l`` of a text.
_COUNTED = {
    "n_stop_words": f"size(filter(w, x -> length(x) <= 4 and translate(x, '{UPPER}', '{LOWER}') in {STOP_WORDS}))",
    "n_lettered": r"size(filter(w, x -> x rlike '[A-Za-z]|[^\\x00-\\x7F]'))",
    "n_bullets": r"size(filter(l, x -> x rlike '^[ \\t]*[-*•]'))",
    "n_ellipses": r"size(filter(l, x -> x rlike '([.][.][.]|…)[ \\t\\r]*\\z'))",
    "n_ended": r"""size(filter(l, x -> x rlike '[.!?"”。！？][ \\t\\r]*\\z'))""",
}

_WORDS = r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)"
_WINDOWS = "if(n_words < 5, array(), transform(sequence(0, n_words - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4))))"
_SORTED = "sort_array(transform(g, (h, i) -> struct(h, i)))"
_REPEATED = "sort_array(filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h or x.h = get(s, k + 1).h, x.i, -1)), i -> i >= 0))"
_COVERED = "aggregate(p, struct(0L as n, -5 as at), (a, i) -> struct(a.n + least(5, i - a.at) as n, i as at), a -> a.n)"


def policy_mask(name: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[name])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, rules: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed_bits`` per row, of all rules or those named; with ``carry`` also the whole input row as ``row``."""
    kept = ["doc_id", *(["row"] if carry else [])]
    extra = [F.struct("*").alias("row")] if carry else []
    lines = r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    first = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *extra)
    counted = first.select(
        *kept,
        F.expr(_WORDS).alias("w"),
        F.expr(lines).alias("l"),
        F.expr(r"length(t) - length(translate(t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("length(t) - length(translate(t, '!?', ''))").cast("long").alias("n_marks"),
        F.expr("length(t) - length(translate(t, '0123456789', ''))").cast("long").alias("n_digits"),
        F.expr("length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").cast("long").alias("n_upper"),
        F.expr("length(t) - length(translate(t, '{}', ''))").cast("long").alias("n_braces"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    measured = ["n_symbols", "n_marks", "n_digits", "n_upper", "n_braces", "word_chars"]
    windows = counted.select(
        *kept, *measured, "w", F.size("w").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        *[F.expr(count).alias(name) for name, count in _COUNTED.items()],
    )
    measured += ["n_words", "n_lines", "n_dup_lines", *_COUNTED]
    hashed = windows.select(*kept, *measured, F.expr(_WINDOWS).cast("array<bigint>").alias("g"))
    # Most texts repeat no window; only the others are sorted to find the places.
    sorts = f"if(size(array_distinct(g)) < size(g), {_SORTED}, null)"
    ordered = hashed.select(*kept, *measured, F.expr(sorts).alias("s"))
    places = ordered.select(*kept, *measured, F.expr(f"if(s is null, null, {_REPEATED})").alias("p"))
    numbers = places.select(
        *kept, *[F.col(c).cast("long").alias(c) for c in measured],
        F.expr(f"coalesce({_COVERED}, 0L)").alias("n_repeat_words"),
    )
    bits = " + ".join(f"if({condition}, {BIT[name]}L, 0L)" for name, condition in RULES if rules is None or name in rules)
    # The optimizer would copy all of the above into a filter on the bits, again and again inside itself. It
    # leaves filters above a column that is not deterministic; the condition here never holds.
    return numbers.withColumn("failed_bits", F.expr(f"if(monotonically_increasing_id() < 0, 0L, {bits})"))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a written table: texts are read and measured once, however many policies and reports follow."""
    return save(ledger(docs, id_col, text_col), "quality_ledger")


def apply_policy(measured: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a versioned policy."""
    return measured.withColumns(
        {
            "base_failed": F.col("failed_bits").bitwiseAND(F.lit(policy_mask("base"))) != 0,
            "kept": F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy) | policy_mask("base"))) == 0,
        }
    )


def ablation(measured: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents failing it, and documents only it rejects."""
    mask = policy_mask(policy)
    names = POLICIES[policy]
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask))
    totals = measured.agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(hit.bitwiseAND(F.lit(BIT[n])) != 0).alias(f"all_{n}") for n in names],
        *[F.count_if(hit == BIT[n]).alias(f"only_{n}") for n in names],
    )
    rows = ", ".join(f"'{n}', all_{n}, only_{n}" for n in names)
    return totals.selectExpr("n_docs", f"stack({len(names)}, {rows}) as (rule, n_failed, n_only)")


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were."""
    return apply_policy(ledger(docs, carry=True, rules=POLICIES["base"] + POLICIES[policy]), policy).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(store(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits",
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the widest policy rejects among all documents, and what only it rejects."""
    return ablation(store(table(spark, sf_dir, "documents")), "v2")


#: DuckDB SQL: rows are numbered, since ids may repeat.
_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS g
  FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + k AS at FROM grams JOIN twice USING (r, g), unnest(range(0, 5)) AS u(k)),
rep AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
lines AS (SELECT r, l FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count_if(regexp_matches(l, '^[ \t]*[-*•]')) AS n_bullets,
    count_if(regexp_matches(l, '([.][.][.]|…)[ \t\r]*\z')) AS n_ellipses, count_if(regexp_matches(l, '[.!?"”。！？][ \t\r]*\z')) AS n_ended
  FROM lines GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_full_match(x, '(?i)the|be|to|of|and|that|have|with') AND strlen(x) = length(x))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
    coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(n_ended, 0) AS n_ended,
    length(t) - length(regexp_replace(t, '[{}]', '', 'g')) AS n_braces
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_marks > 4 * n_words THEN 8 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 60 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_digits > word_chars THEN 64 ELSE 0 END
    + CASE WHEN n_upper >= 40 AND 2 * n_upper > word_chars THEN 128 ELSE 0 END
    + CASE WHEN n_words >= 50 AND n_stop_words < 2 THEN 256 ELSE 0 END
    + CASE WHEN word_chars NOT BETWEEN 3 * n_words AND 10 * n_words THEN 512 ELSE 0 END + CASE WHEN 5 * n_lettered < 4 * n_words THEN 1024 ELSE 0 END
    + CASE WHEN 10 * n_bullets > 9 * n_lines THEN 2048 ELSE 0 END + CASE WHEN 10 * n_ellipses > 3 * n_lines THEN 4096 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 10 * n_ended < n_lines THEN 8192 ELSE 0 END + CASE WHEN 10 * n_braces > n_words THEN 16384 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
"""
ORACLE_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits & 255 = 0 AS kept, failed_bits
FROM b
"""
ABLATION_SQL = _LEDGER_SQL + f"""
SELECT rule, count(*) AS n_docs, count_if(failed_bits & bit <> 0)::BIGINT AS n_failed, count_if(failed_bits = bit)::BIGINT AS n_only
FROM b, (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())}) AS r(rule, bit) GROUP BY rule
"""
