"""Rule-based document quality.

A table of thresholds is compiled into one projection: every measure is a built-in column expression, every rule a
comparison between measures, and the verdict is the list of rules that a document breaks. No user functions and no
shuffle; the work per document is its length (times a log factor for texts with repeated windows).

Nulls and empty texts have no words: all measures are 0 and the ``few_words`` rule rejects them. Repeated rows are judged
one by one. Extra columns are left alone; the measures are added under the names below and replace columns of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE_CHARS, SPACED_WORD, ascii_lower, bound_to, spaced_words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is was it for on be with as by this that are "
    "le la les de des et en un une du que qui par dans "
    "der die das und den ist zu nicht ein mit sich auf "
    "el los las y se es por con una"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if ``part * scale`` is beyond ``bound * whole``, for texts of ``least`` words or more."""

    name: str
    part: str
    whole: str
    beyond: str
    bound: int
    scale: int = 100
    least: int = 0


#: In hundredths of the whole; whole numbers keep the comparisons exact.
RULES = (
    Rule("few_words", "n_words", "one", "<", 10, scale=1),
    Rule("repeated_windows", "n_repeat_words", "n_words", ">", 20),
    Rule("short_words", "word_chars", "n_words", "<", 250),
    Rule("long_words", "word_chars", "n_words", ">", 1200),
    Rule("symbols", "n_symbols", "n_words", ">", 20),
    Rule("exclamations", "n_exclamations", "n_words", ">", 50),
    Rule("stop_words", "n_stop_words", "n_words", "<", 3, least=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", ">", 50, least=20),
)
BASE_RULES = ("few_words", "repeated_windows")
WINDOW = 5


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Most texts repeat no window; a hash set over the windows finds that out. The others sort (window, start) and keep the
    starts that equal a neighbour, whose intervals are then measured in order.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = lambda k: F.coalesce(F.get(s, k)["h"], F.lit(None).cast("long"))
            return F.filter(s, lambda x, k: near(k - 1).eqNullSafe(x["h"]) | near(k + 1).eqNullSafe(x["h"]))

        places = F.array_sort(F.transform(bound_to(ordered, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    found = bound_to(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) > window, found).otherwise(0)


def _measured(text: Column) -> Column:
    """Struct of what the rules read; each scan of the text is written once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACED_WORD))
    bare = lambda w: F.translate(ascii_lower(w), ".,;:!?", "")
    of_words = bound_to(spaced_words(text), lambda w: F.struct(
        F.size(w).alias("n_words"),
        _repeat_words(w, WINDOW).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: bare(x).isin(STOP_WORDS))).alias("n_stop_words"),
    ))
    of_lines = bound_to(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(
        of_words.alias("words"),
        of_lines.alias("lines"),
        F.length(F.translate(text, SPACE_CHARS, "")).alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        _removed(text, "!").alias("n_exclamations"),
    )


def _broken(rule: Rule, m: dict[str, Column]) -> Column:
    whole = F.lit(1) if rule.whole == "one" else m[rule.whole]
    part, bound = m[rule.part] * rule.scale, whole * rule.bound
    return (m["n_words"] >= rule.least) & (part < bound if rule.beyond == "<" else part > bound)


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the measures (long) and ``broken_rules``.

    One expression that binds what it has measured: a filter on it that is pushed down measures once, not once per rule.
    """

    def judged(x: Column) -> Column:
        m = {k: x["words"][k].cast("long") for k in ("n_words", "n_repeat_words", "n_stop_words")}
        m |= {k: x["lines"][k].cast("long") for k in ("n_lines", "n_dup_lines")}
        m |= {k: x[k].cast("long") for k in ("word_chars", "n_symbols", "n_exclamations")}
        broken = F.filter(F.array(*[F.when(_broken(r, m), F.lit(r.name)) for r in rules]), lambda r: r.isNotNull())
        return F.struct(*[c.alias(k) for k, c in m.items()], broken.alias("broken_rules"))

    return bound_to(_measured(text), judged)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE_RULES) -> DataFrame:
    """Add the measures, ``broken_rules``, ``base_failed`` and ``kept`` to ``docs``."""
    names = ["n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_exclamations", "broken_rules"]
    j = F.col("_judgement")
    out = docs.withColumn("_judgement", judgement(F.col(text_col), rules))
    out = out.withColumns({
        **{k: j[k] for k in names},
        "base_failed": F.arrays_overlap(j["broken_rules"], F.array(*[F.lit(x) for x in base])),
        "kept": F.size(j["broken_rules"]) == 0,
    })
    return out.drop("_judgement")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` that break no rule."""
    return docs.filter(F.size(judgement(F.col(text_col), rules)["broken_rules"]) == 0)
