"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import SPACE, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("word_chars", "n_symbols", "n_words", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines")
#: The most frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to a in is was that for it as with be by on not he his but at are this have from or had an they which you were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et en un une du que qui est pour dans par sur pas plus ne se ce il au avec son sont ou mais "
    "el los las del y que por con para una su al lo como más pero sus o este sí porque se no"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie within least and most. A denominator of 0 counts as 1."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.03),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 that occur twice or more. Windows are compared by a chained 64-bit hash of their words."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    hashes = let(
        one,
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        twice = let(pairs, lambda p: F.transform(F.filter(p, lambda x, k: same(p, k - 1, x) | same(p, k + 1, x)), lambda x: x["at"]))
        return let(
            F.sort_array(twice),
            lambda at: F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return F.when(
        F.size(words) >= WINDOW,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))),
    ).otherwise(F.lit(0).cast("long"))


def _measures(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    of_words = let(
        F.array_remove(F.split(whole, SPACE, -1), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        of_words.alias("words"),
        of_lines.alias("lines"),
    )


def _broken(rule: Rule, m: Column) -> Column:
    value = m[rule.numerator].cast("double")
    if rule.denominator:
        value = value / F.greatest(m[rule.denominator], F.lit(1))
    tests = [value < rule.least] if rule.least is not None else []
    tests += [value > rule.most] if rule.most is not None else []
    return F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(rule.name))


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """df with a struct column of measures, base_failed, the names of broken rules, and kept.

    Null and empty texts have no words, so that they fail; a very long text is measured whole. Each row is judged alone: repeated rows
    and ties get equal results. Columns of df stay, but for one named as `into`. An empty table gives an empty one.
    """

    def verdict(m: Column) -> Column:
        # The contract's base, in whole numbers: fewer than 20 words, or over 30 % of them in repeated windows.
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        broken = F.filter(F.array(*[_broken(r, m) for r in rules]), lambda x: x.isNotNull())
        kept = ~base & (F.size(broken) == 0)
        return F.struct(*[m[x].alias(x) for x in MEASURES], base.alias("base_failed"), broken.alias("broken"), kept.alias("kept"))

    # One expression, bound at each step, so that a filter on `kept` that moves below the projection measures each text once.
    flat = lambda n: F.struct(
        n["word_chars"].alias("word_chars"), n["n_symbols"].alias("n_symbols"), *[n["words"][x].alias(x) for x in MEASURES[2:5]], *[n["lines"][x].alias(x) for x in MEASURES[5:]]
    )
    return df.drop(into).withColumn(into, let(_measures(df[text]), lambda n: let(flat(n), verdict)))
