"""Quality rules: a threshold table compiled into one projection of ratios, in DataFrame functions only.

The measures of a text (words, characters, symbols, stop words, lines, repeats)
are columns made from its arrays of words and lines by higher-order functions.
Repeated word windows are found by sorting the text's windows, so the cost
stays near linear for any length. The table of rules then becomes a single
projection that lists, for every row, the rules that it breaks. Nothing is
shuffled and no Python code sees a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3              # words in a window of the repeat measure

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on as was this are "
    "der die das und ist nicht mit von zu den ein eine im auf "
    "le la les de des et est une un que dans pour en du "
    "el los las y no una por con del se es al").split()


@dataclass(frozen=True)
class Rule:
    """``over / under`` must lie within [least, most]; a bound of None is open, zero ``under`` breaks nothing."""

    name: str
    over: str
    under: str | None = None
    least: float | None = None
    most: float | None = None
    base: bool = False


# The base rules are the contract's; the others follow published heuristics for web text. A line limit
# of 0.3 would drop three-line texts whose last line repeats the first, hence 0.4.
RULES = [
    Rule("few_words", "n_words", least=50, base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=0.5, base=True),
    Rule("word_length", "word_chars", "n_words", least=2, most=15),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
            "n_bullet_lines", "n_ellipsis_lines"]


def _count(items: Column, holds) -> Column:
    return F.size(F.filter(items, holds))


def measure_texts(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
                  window: int = WINDOW) -> DataFrame:
    """``row`` (the carried columns as a struct) and the measures as longs.

    A null or empty text measures zero throughout. n_repeat_words counts each
    word once that lies in a window of ``window`` words found twice or more
    in its text. A line counts if it holds a word; it is a duplicate if equal,
    white space included, to an earlier one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (carry if carry is not None else docs.columns)]).alias("row")
    df = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Each step is a column of its own, so that no lambda computes an array again.
    df = df.select("row", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
                   F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"),
                   F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("words")
    starts = F.slice("words", F.lit(1), F.greatest(n - (window - 1), F.lit(0)))
    df = df.select(
        "row", "n_symbols", n.alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        _count(F.col("words"), lambda w: F.lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"^[\x20\x09]*[-*•]")).alias("n_bullet_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")).alias("n_ellipsis_lines"),
        F.sort_array(F.transform(starts, lambda w, i: F.struct(
            F.concat_ws(" ", w, *[F.get(F.col("words"), i + k) for k in range(1, window)]).alias("gram"),
            i.alias("at")))).alias("grams"))
    twice = F.filter("grams", lambda g, i: F.coalesce(F.get(F.col("grams"), i - 1)["gram"] == g["gram"], F.lit(False))
                     | F.coalesce(F.get(F.col("grams"), i + 1)["gram"] == g["gram"], F.lit(False)))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda g: g["at"]))).drop("grams")
    new = F.transform("places", lambda p, i: F.coalesce(F.least(p - F.get(F.col("places"), i - 1), F.lit(window)),
                                                        F.lit(window)))
    df = df.withColumn("n_repeat_words", F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x))
    # A generator of one row: filters on the measures stay above it, instead of being pushed down as copies of them.
    out = df.select("row", *[F.col(c).cast("long") for c in MEASURES])
    return out.select("row", F.inline(F.array(F.struct(*MEASURES))))


def broken(rules: list[Rule]) -> Column:
    """The names of the rules that a row of measures breaks, in the order of the table."""
    def breaks(r: Rule) -> Column:
        value = F.col(r.over).cast("double")
        if r.under is not None:
            value = F.try_divide(value, F.col(r.under).cast("double"))
        out = F.lit(False)
        if r.least is not None:
            out = out | (value < r.least)
        if r.most is not None:
            out = out | (value > r.most)
        return F.coalesce(out, F.lit(False))
    return F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in rules]))


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """``row``, the measures, ``broken`` (names of all broken rules) and ``kept`` (none broken).

    Every row gets a verdict; rows repeated or with a null id are judged like
    any other, and an empty table gives an empty result.
    """
    out = measure_texts(docs, text_col, carry).withColumn("broken", broken(list(rules)))
    return out.withColumn("kept", F.size("broken") == 0)


def _sql_rule(r: Rule) -> str:
    value = r.over if r.under is None else f"({r.over}::DOUBLE / nullif({r.under}, 0)::DOUBLE)"
    parts = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
    return f"CASE WHEN {' OR '.join(parts)} THEN '{r.name}' END"


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
             len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, concat_ws(',', {", ".join(_sql_rule(r) for r in RULES)}) AS broken_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, broken_rules = '' AS kept, broken_rules
FROM b
"""


def op13_quality(spark, sf_dir: str) -> DataFrame:
    found = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    base = F.array(*[F.lit(r.name) for r in RULES if r.base])
    return found.select("row.doc_id", *MEASURES[:5], F.arrays_overlap("broken", base).alias("base_failed"), "kept",
                        F.array_join("broken", ",").alias("broken_rules"))
