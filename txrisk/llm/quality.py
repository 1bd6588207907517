"""Quality rules: a table of thresholds compiled into one projection [native].

Every measure is a column expression over one text (no shuffle, no user function), so a pass
over the corpus is one scan. Measures, per text:

* ``n_words``, ``word_chars``: words (runs without blanks) and their code points;
* ``n_symbols``: characters out of ``#*$%&|<>``;
* ``n_lines``, ``n_dup_lines``: lines with a word, and those of them equal to an earlier line;
* ``n_repeat_words``: words inside some 3-word window that the text has at least twice;
* ``n_stop``: words that are common function words of the corpus languages, in any case;
* ``n_shout``: exclamation marks.

Null, empty and blank texts have zeros everywhere and fail the length rule. Repeated rows get
equal results; extra columns pass through untouched, whatever their names. Very long texts cost
n log n time in their own task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import BLANKS, fresh, let, words

SYMBOLS = "#*$%&|<>"

# Common function words, by language.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were all we",
    "fr": "le la les de des du et un une en que qui dans pour par sur est au aux avec ce se ne pas il elle sont plus",
    "de": "der die das und in von zu den mit ist im für auf ein eine des sich nicht als auch es an dem er sie",
    "es": "el la los las de del y en un una que por con para se no su al lo es como más",
}


@dataclass(frozen=True)
class Rule:
    """Passes where ``low * of <= measure <= high * of``; an open side is None."""

    name: str
    measure: str
    of: str | None
    low: float | None = None
    high: float | None = None

    def passes(self, m: dict[str, Column]) -> Column:
        of = m[self.of] if self.of else F.lit(1)
        sides = [m[self.measure] >= of * self.low] if self.low is not None else []
        sides += [m[self.measure] <= of * self.high] if self.high is not None else []
        out = sides[0]
        for s in sides[1:]:
            out = out & s
        return out


#: The contract's base rules come first; a text they reject is rejected.
BASE_RULES = (
    Rule("words", "n_words", None, low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop", "n_words", low=0.03),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("shouting", "n_shout", "n_words", high=0.2),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_shout")


def _count_of(text: Column, chars: str) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c in chars), F.lit(0)).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more. Windows are put in order of their hash, so
    equal ones are neighbours; words are compared too, so no hash collision can count."""
    same = lambda p, q: ((F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1))
                         & (F.get(w, p + 2) == F.get(w, q + 2)))
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(
        F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def again(s):
        beside = lambda x, i: (F.get(s, i)["h"] == x["h"]) & same(F.get(s, i)["p"], x["p"])
        return F.filter(s, lambda x, i: beside(x, i - 1) | beside(x, i + 1))

    starts = F.array_sort(F.transform(let(F.sort_array(windows), again), lambda x: x["p"]))
    # of a window that starts d words after the one before, min(3, d) words are new
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                       lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
                       lambda a: a["n"])


def _forms(names: dict[str, str]) -> list[str]:
    low = {w for v in names.values() for w in v.split()}
    return sorted(low | {w.capitalize() for w in low} | {w.upper() for w in low})


def with_measures(df: DataFrame, text_col: str = "text", name: str = "quality") -> tuple[DataFrame, str]:
    """``df`` with one struct column of the measures; returns the frame and that column's name."""
    out, text = fresh(df, name), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stops = _forms(STOP_WORDS)
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(stops))).alias("n_stop")))
    of_lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda l: F.struct(
        F.size(l).alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).alias("n_dup_lines")))
    by_word, by_line = fresh(df, "words"), fresh(df, "lines")
    parts = df.select("*", of_words.alias(by_word), of_lines.alias(by_line))
    measures = {**{c: F.col(f"`{by_word}`")[c] for c in ("n_words", "word_chars", "n_repeat_words", "n_stop")},
                **{c: F.col(f"`{by_line}`")[c] for c in ("n_lines", "n_dup_lines")},
                "n_symbols": _count_of(text, SYMBOLS), "n_shout": _count_of(text, "!")}
    return parts.select(*[F.col(f"`{c}`") for c in df.columns],
                        F.struct(*[measures[m].cast("long").alias(m) for m in MEASURES]).alias(out)), out


def quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                  name: str = "quality") -> tuple[DataFrame, str]:
    """``df`` with a struct column of the measures, ``base_failed``, ``failed`` (names of the rules
    that the text breaks, base rules first) and ``kept`` (no rule broken)."""
    measured, col = with_measures(df, text_col, name)
    m = {c: F.col(f"`{col}`")[c] for c in MEASURES}
    base_failed = ~(BASE_RULES[0].passes(m) & BASE_RULES[1].passes(m))
    failed = F.filter(F.array(*[F.when(~r.passes(m), F.lit(r.name)) for r in (*BASE_RULES, *rules)]),
                      lambda x: x.isNotNull())
    full = F.struct(*[m[c].alias(c) for c in MEASURES], base_failed.alias("base_failed"), failed.alias("failed"),
                    (F.size(failed) == 0).alias("kept"))
    return measured.withColumn(col, full), col


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with the columns of ``df``.

    The verdict is an array of no or one element that is exploded: a plain filter would be pushed below
    the measures with a copy of their expressions for each rule, and compute them again and again."""
    judged, col = quality_rules(df, text_col, rules)
    once = F.filter(F.array(F.col(f"`{col}`")), lambda q: q["kept"])
    return judged.withColumn(col, F.explode(once)).select(*[F.col(f"`{c}`") for c in df.columns])
