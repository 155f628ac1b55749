"""Explicit rating mentions in Russian review text.

Two heuristics exist on purpose and disagree on some texts: the prioritised one
takes the strongest pattern, the earliest one takes the first in reading order.
Both are written without lookaround so the patterns run on Java and on RE2.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .text import NOT_WORD, WORD, WS

# Patterns and word tables of the prioritised heuristic.
DIGIT_UNIT = (
    rf"(?:^|[^\p{{Nd}}])([1-5]){WS}*(?:-{WS}*)?"
    rf"(?:зв[её]зд|балл|из{WS}*5|/{WS}*5|из{WS}*пяти)"
)
VERB_DIGIT = (
    rf"(?:оценк{WORD}*|ставлю|поставил{WORD}*|поставлю|дам|даю){WS}*[:\-–]?{WS}*"
    r"([1-5])(?:[^\p{Nd}]|\z)"
)
WORD_UNIT = rf"(?:^|{NOT_WORD})(одну|одна|две|три|четыре|пять){WS}+зв[её]зд"
WORD_VALUES = {"одну": 1, "одна": 1, "две": 2, "три": 3, "четыре": 4, "пять": 5}

# Patterns of the earliest-match heuristic.  Group 1 is the left
# context that a word boundary would not consume, group 2 the mention itself.
STEMS = (
    rf"(един{WORD}*|один|двойк{WORD}*|два|тройк{WORD}*|три|"
    rf"четв[её]рк{WORD}*|четыре|пят[её]рк{WORD}*|пять)"
)
EARLY_PATTERNS = (
    rf"(^|{NOT_WORD})([1-5]){WS}*(?:/|из){WS}*5(?:{NOT_WORD}|\z)",
    rf"(^|{NOT_WORD})([1-5]){WS}*(?:звезд|звёзд|балл|\*)",
    rf"()(?:оценк{WORD}*|ставлю|поставил{WORD}*|оцениваю|оценил{WORD}*){WS}*[:\-–]?{WS}*"
    rf"([1-5])(?:{NOT_WORD}|\z)",
    rf"(?:(^|{NOT_WORD})на|ставлю|поставил{WORD}*|оценк{WORD}*|оценил{WORD}*){WS}*[:\-–]?{WS}*"
    rf"(?:бы{WS}+|только{WS}+|твёрдую{WS}+|твердую{WS}+)?" + STEMS,
)
STEM_VALUES = (
    ("един", 1), ("один", 1), ("двойк", 2), ("два", 2), ("тройк", 3), ("три", 3),
    ("четв", 4), ("четыр", 4), ("пят", 5),
)

NO_MENTION = "нет упоминания"
MENTION_MATCH = "совпадает с оценкой"
MENTION_DIFF = "не совпадает с оценкой"


# What a pattern cannot match without: literal searches decide before the pattern runs.
EARLY_NEEDS = (
    ("/", "из"), ("звезд", "звёзд", "балл", "*"), ("оцен", "став"), ("на", "оцен", "став"),
)
DIGIT_NEEDS, VERB_NEEDS, WORD_NEEDS = ("зв", "балл", "из", "/"), ("оценк", "став", "да"), ("зв",)


def _lowered(text: Column, body) -> Column:
    """``body`` of the lower-cased text, which is made once."""
    return F.transform(F.array(F.lower(text)), body)[0]


def _has(text: Column, needs: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needs])


def _found(text: Column, pattern: str, group: int, needs: tuple[str, ...]) -> Column:
    return F.when(_has(text, needs), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def prioritised_mention(text: Column) -> Column:
    """Digit with a unit, else verb with a digit, else number word with a unit."""
    values = F.create_map(*[F.lit(x) for pair in WORD_VALUES.items() for x in pair])
    return _lowered(text, lambda low: F.coalesce(
        _found(low, DIGIT_UNIT, 1, DIGIT_NEEDS).cast("int"),
        _found(low, VERB_DIGIT, 1, VERB_NEEDS).cast("int"),
        F.try_element_at(values, _found(low, WORD_UNIT, 1, WORD_NEEDS)),
    ))


def _stem_value(word: Column) -> Column:
    chain = F.when(word.startswith(STEM_VALUES[0][0]), F.lit(STEM_VALUES[0][1]))
    for stem, value in STEM_VALUES[1:]:
        chain = chain.when(word.startswith(stem), F.lit(value))
    return chain


def earliest_mention(text: Column) -> Column:
    """Value of the leftmost mention; on a tie the earlier pattern wins."""

    def hit(low: Column, i: int) -> Column:
        """Only the search reads the whole text; the groups come from the text behind its
        result, where the same pattern matches at once."""
        pattern = EARLY_PATTERNS[i]
        start = F.when(_has(low, EARLY_NEEDS[i]), F.regexp_instr(low, F.lit(pattern)))

        def groups(at: Column, tail: Column) -> Column:
            raw, left = (F.regexp_extract(tail, rf"\A(?:{pattern})", k) for k in (2, 1))
            shift = F.length(left)
            value = raw.cast("int") if i < 3 else _stem_value(raw)
            return F.struct((at + shift).alias("at"), F.lit(i).alias("no"), value.alias("value"))

        behind = F.transform(F.array(start), lambda at: F.when(at > 0, F.struct(at.alias("at"), F.substr(low, at).alias("tail"))))
        return F.transform(behind, lambda x: F.when(x.isNotNull(), groups(x["at"], x["tail"])))[0]

    return _lowered(
        text, lambda low: F.least(*[hit(low, i) for i in range(len(EARLY_PATTERNS))])["value"]
    ).cast("double")


def mention_group(mention: Column, truth: Column) -> Column:
    return (
        F.when(mention.isNull(), NO_MENTION)
        .when(mention == truth, MENTION_MATCH)
        .otherwise(MENTION_DIFF)
    )
