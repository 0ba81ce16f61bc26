"""Quality rules: a table of thresholds compiled into one projection, without user functions.

`measured` adds the counts of each text as column expressions; `failing` turns the rows of a threshold table into one column, the
names of the rules that a document breaks. Ratios are compared as whole numbers (100 * part against percent * whole), so that no
result hangs on rounding.

Scale: one scan and no shuffle, so no key can be hot. Each array of a text (words, hashes of windows) is made once and bound to a name inside the expression. Repeated windows
are looked for by 64-bit hash; only where two hashes of a text are equal are windows sorted, and those that share a
hash are compared word by word, so that counts are exact. A text is in memory with its words while its row is worked on.

Defined cases: null and empty texts have no words and no lines with a word, count zero everywhere and fail; very long texts are read whole; repeated rows
are judged each; null ids pass through; ties: none; an empty table gives an empty result; documents' own columns, whatever their names, are
not read (but doc_id and text) and pass unchanged through `keep_passing`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WINDOW = r"[\x20\x09-\x0D]", 5
#: Rows of a threshold table that `rules_of` takes at most: they become one expression.
MOST_RULES = 1000

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from or an which not have has "
    "der die und in den von zu das mit sich des auf für ist im dem eine ein nicht als auch es an "
    "de la le et les des en un du une que pour est dans qui par au pas sur avec il ce se "
    "el y los las del por con no para su al es lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of at least `words` words breaks it if 100 * part is below least * whole or above most * whole. whole None: counts themselves, not percent."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None
    words: int = 0


#: Production thresholds. The first two are the base rules.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeats", "n_repeat_words", "n_words", most=20),
    Rule("short_words", "word_chars", "n_words", least=250),
    Rule("long_words", "word_chars", "n_words", most=1500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("shouting", "n_shouts", "n_words", most=40),
    Rule("no_letters", "n_letter_words", "n_words", least=60),
    Rule("no_stop_words", "n_stop_words", "n_words", least=2, words=50),
    Rule("same_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=50),
)
BASE = ("few_words", "repeats")


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table with Rule's columns (whole, least, most, words may be null)."""
    rows = table.select("name", "part", "whole", "least", "most", "words").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(Rule(r.name, r.part, r.whole, r.least, r.most, r.words or 0) for r in rows)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_letter_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: it stays in memory instead of going through a row of its own."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column) -> Column:
    """How many words stand in windows that the text has twice or more."""
    first = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(first, lambda _, i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    window = lambda s: F.struct(F.array_join(F.slice(words, s["i"] + 1, WINDOW), " ").alias("k"), s["i"].alias("i"))

    def twice(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["k"] == x["k"], F.lit(False))
        return F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["upto"])).alias("n"), (i + WINDOW).alias("upto"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    def confirmed(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        shown = _let(ordered, lambda o: F.sort_array(F.transform(twice(o), window)))
        return covered(_let(shown, lambda o: F.sort_array(F.transform(twice(o), lambda s: s["i"]))))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(confirmed(h)))


def measured(docs: DataFrame) -> DataFrame:
    """The documents as struct `own`, and METRICS as longs."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    text = F.coalesce("own.text", F.lit(""))
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    named = lambda counts: F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
    of_words = lambda w: named({
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_repeat_words": _repeated(w),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stops))),
    })
    of_lines = lambda x: named({
        "n_lines": F.size(x), "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_bullet_lines": F.size(F.filter(x, lambda y: y.rlike(rf"^{SPACE}*[-*•]"))),
        "n_cut_lines": F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…){SPACE}*\z"))),
    })
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols, shouts = F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.regexp_count(text, F.lit(r"\p{Lu}{2,}"))
    found = own.select("own", _let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.cast("long").alias("n_symbols"), shouts.cast("long").alias("n_shouts"))
    return found.select("own", "w.*", "l.*", "n_symbols", "n_shouts").select("own", *METRICS)


def failing(rules: Sequence[Rule]) -> Column:
    """The table as one column: names of the rules that METRICS break, in the table's order."""
    broken = []
    for r in rules:
        part = F.col(r.part) * (100 if r.whole else 1)
        whole = F.col(r.whole) if r.whole else F.lit(1)
        out = F.lit(False)
        if r.least is not None:
            out = out | (part < F.lit(r.least) * whole)
        if r.most is not None:
            out = out | (part > F.lit(r.most) * whole)
        broken.append(F.when(out & (F.col("n_words") >= r.words), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents as struct `own`, METRICS, failed (names of broken rules), base_failed and kept."""
    found = measured(docs).withColumn("failed", failing(rules))
    return found.withColumns({"base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, BASE))), "kept": F.size("failed") == 0})


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the broken rules' names; a row for each of the documents."""
    return judge(docs, rules).select("own.doc_id", *METRICS[:5], "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def keep_passing(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns."""
    return judge(docs, rules).filter("kept").select(*[F.col(f"own.`{c}`") for c in docs.columns])
