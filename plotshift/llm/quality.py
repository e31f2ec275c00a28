"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule is a measure with a lowest and a highest allowed value. All measures of a text are column expressions, the table
is folded into one array of failed rule names and one verdict, and everything happens in the row: there is no shuffle,
so neither copies nor a hot source matter, and a lost executor costs its own tasks only.

Defined cases: a null text counts as empty; an empty text has no words and fails on its length; rows with the same id or
text are judged one by one; extra columns are carried along by ``apply_rules`` and dropped by ``base_measures``; the rules
on stop words and word length are made for four languages: ``report`` asks them of every text, as its SQL does,
``kept_documents`` only of texts whose letters, and label if there is one, can be of those languages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotshift.llm.frames import GAPS

# The most frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is was for that it with as on be at by this are from or an a have not which".split(),
    "fr": "le la les de des du et en un une que qui dans est pour pas sur au par avec il ce se ne plus".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "el la los las de del y en que un una por con no se para es su al lo como más pero sus le".split(),
}


#: Letters that those languages are written with; a text with more than ``FOREIGN`` of its letters outside is in another one.
ALPHABET = "A-Za-zÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜßàáâäæçèéêëíîïñóôöùúûüÿŒœŸªº"
FOREIGN = 0.01


@dataclass(frozen=True)
class Rule:
    """A text passes while ``low <= measure <= high``; an open end is None. ``listed``: made for the languages of
    ``STOP_WORDS``, so the pipeline asks it of their texts only."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    listed: bool = False


#: The thresholds in use. Shares are per word or per line with a word.
RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repetitive", "repeat_share", high=0.20),
    Rule("word_length", "mean_word_length", low=1.5, high=25.0, listed=True),
    Rule("symbols", "symbol_share", high=0.25),
    Rule("stop_words", "stop_share", low=0.02, listed=True),
    Rule("repeated_lines", "dup_line_share", high=0.50),
    Rule("shouting", "mark_share", high=0.30),
)
BASE_RULES = ("too_short", "repetitive")
RUN = 5


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``q_repeat``, the number of words inside runs of five words that occur at least twice in the text.

    ``q_runs`` holds the runs' hashes. Where they are not all distinct they are sorted with their positions; a run counts
    if its neighbour has the same hash. The positions in ascending order cover ``min(5, gap to the one before)`` new words
    each. Each step is a column of its own, so that no lambda computes an array again for every element.
    """
    pairs = F.sort_array(F.transform("q_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("q_order", F.when(F.size(F.array_distinct("q_runs")) < F.size("q_runs"), pairs))
    at = lambda i: F.try_element_at("q_order", i)["h"]
    twice = F.filter("q_order", lambda x, i: at(i + 2).eqNullSafe(x["h"]) | at(F.when(i > 0, i)).eqNullSafe(x["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-RUN).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(RUN), p - acc["last"])).alias("sum"), p.alias("last")),
        lambda acc: acc["sum"],
    )
    return df.withColumn("q_repeat", F.coalesce(covered, F.lit(0).cast("bigint")))


def _cased_stop_words() -> list[str]:
    words = {w for v in STOP_WORDS.values() for w in v}
    return sorted({x for w in words for x in (w, w.capitalize(), w.upper())})


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the rules are made of, under the prefix ``q_``."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {
            "q_words": F.filter(F.split(body, GAPS), lambda w: w != ""),
            "q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "q_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("bigint"),
            "q_marks": F.regexp_count(body, F.lit(r"[!#*$%&<>{}\[\]=~^]")).cast("bigint"),
        }
    )
    df = df.withColumns(
        {
            "q_n": F.size("q_words"),
            "q_chars": F.length(F.array_join("q_words", "")).cast("bigint"),
            "q_hash": F.transform("q_words", lambda w: F.xxhash64(w)),
            "q_dup": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
            "q_n_lines": F.size("q_lines"),
            "q_stop": F.size(F.filter("q_words", lambda w: w.isin(_cased_stop_words()))),
        }
    )
    runs = F.transform(
        F.when(F.col("q_n") >= RUN, F.sequence(F.lit(1), F.col("q_n") - (RUN - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.element_at("q_hash", i + j) for j in range(RUN)]),
    )
    return _with_repeat_words(df.withColumn("q_runs", runs))


MEASURES = {
    "n_words": lambda: F.col("q_n").cast("double"),
    "repeat_share": lambda: F.col("q_repeat") / F.greatest("q_n", F.lit(1)),
    "mean_word_length": lambda: F.col("q_chars") / F.greatest("q_n", F.lit(1)),
    "symbol_share": lambda: F.col("q_symbols") / F.greatest("q_n", F.lit(1)),
    "mark_share": lambda: F.col("q_marks") / F.greatest("q_n", F.lit(1)),
    "stop_share": lambda: (F.col("q_stop") + 1) / (F.col("q_n") + 1),  # one more of each: short texts may have none
    "dup_line_share": lambda: F.col("q_dup") / F.greatest("q_n_lines", F.lit(1)),
}


def _fails(rule: Rule) -> Column:
    value = MEASURES[rule.measure]()
    low = value < rule.low if rule.low is not None else F.lit(False)
    return low | (value > rule.high) if rule.high is not None else low


def listed(text: Column, lang: Column | None = None) -> Column:
    """Whether a text can be in a language of ``STOP_WORDS``: by its letters, and by its label where it has one."""
    size = lambda rule: F.length(text) - F.length(F.regexp_replace(text, rule, ""))
    other = rf"[\p{{L}}&&[^{ALPHABET}]]"
    written = F.when(text.rlike(other), size(other + "++") <= FOREIGN * size(r"\p{L}++")).otherwise(F.lit(True))
    if lang is None:
        return written
    return written & F.coalesce(F.lower(F.regexp_extract(lang, "^[A-Za-z]+", 0)).isin("", *STOP_WORDS), F.lit(True))


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", asked: Column | None = None) -> DataFrame:
    """``df`` with its measures, ``failed_rules`` (names in the table's order) and ``kept``.

    The base's two limits are compared in whole numbers, so that a text on the limit is judged alike everywhere. Where
    ``asked`` is false the rules of listed languages pass; without it they are asked of every text.
    """
    df = base_measures(df, text)

    def fails(rule: Rule) -> Column:
        return F.when(_fails(rule), asked).otherwise(F.lit(False)) if rule.listed and asked is not None else _fails(rule)

    base_failed = (F.col("q_n") < 10) | (100 * F.col("q_repeat") > 20 * F.col("q_n"))
    others = [r for r in rules if r.name not in BASE_RULES]
    named = {"too_short": F.col("q_n") < 10, "repetitive": 100 * F.col("q_repeat") > 20 * F.col("q_n")}
    flags = [F.when(named[r.name] if r.name in named else fails(r), F.lit(r.name)) for r in rules]
    verdict = base_failed
    for r in others:
        verdict = verdict | fails(r)
    return df.withColumns({"base_failed": base_failed, "failed_rules": F.array_compact(F.array(*flags)), "kept": ~verdict})


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts and the verdict of all rules, as the query's SQL states it for every text."""
    return apply_rules(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("q_n").cast("bigint").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with; the rules of listed languages are asked of their texts only."""
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("q_row"), "text")  # no name of theirs can clash
    asked = listed(F.col("text"), F.col("q_row.lang") if "lang" in docs.columns else None)
    # A filter on a column that is only computed in the row is moved below the projections, where every lambda would compute
    # its arrays again; one that also needs the row's number stays above them.
    judged = apply_rules(whole, asked=asked).withColumn("q_number", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("q_number") >= 0)).select("q_row.*")
