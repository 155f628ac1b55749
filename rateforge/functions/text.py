"""Unicode-aware text expressions.

Spark's own ``trim`` strips only U+0020 and Java's ``\\s``/``\\w`` are ASCII by
default, so the character classes are spelled out.  They use only syntax that
both Java and RE2 accept.
"""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, functions as F

# The characters Python treats as whitespace, and word characters.
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Noise patterns.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
EMOJI_WIDE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2764}\x{FE0F}]"
URL = r"https?://|www\."
CYRILLIC = "[а-яА-ЯёЁ]"
LETTER = "[A-Za-zА-Яа-яЁё]"
CAPITAL = "[A-ZА-ЯЁ]"

MAX_TEXT_CHARS = 20_000


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


@cache
def fold_table() -> tuple[str, str, dict[str, str]]:
    """What full case folding changes: characters that become one other (from, to), and
    those that become several.  Built from the Unicode data that Python carries."""
    single, several = {}, {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        folded = char.casefold()
        if folded != char:
            (single if len(folded) == 1 else several)[char] = folded
    return "".join(single), "".join(single.values()), several


@cache
def _several_class() -> str:
    """A character class of the characters with several, as ranges; characters of ASCII and
    the basic Cyrillic block are passed over by one test."""
    codes, ranges = sorted(map(ord, fold_table()[2])), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[^\x{{0}}-\x{{7F}}\x{{400}}-\x{{4FF}}](?<=[{inside}])"


# Blocks without case, or where lower case is stable: Latin to Cyrillic, scripts without case
# from Hebrew to Myanmar, punctuation and symbols, CJK, Hangul, emoji.
PLAIN_BLOCKS = ((0x0, 0x52F), (0x590, 0x109F), (0x2000, 0x20CF), (0x2600, 0x27BF), (0x3000, 0x9FFF),
                (0xAC00, 0xD7A3), (0x1F000, 0x1FAFF))
# What folding adds to lower case inside those blocks, but for the characters of ``_rare_class``.
BEYOND_LOWER = {"ß": "ss", "ς": "σ", "ſ": "s", "µ": "μ"}


@cache
def _rare_class() -> str:
    """A character outside ``PLAIN_BLOCKS``, or one that folding changes beyond lower case and
    ``BEYOND_LOWER``; ASCII is passed over by one test."""
    ranges = []
    for first, last in PLAIN_BLOCKS:
        for code in range(first, last + 1):
            char = chr(code)
            low = char.lower()
            if BEYOND_LOWER.get(low, low) != char.casefold():
                continue
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[\x{{80}}-\x{{10FFFF}}&&[^{inside}]]"


def casefold(text: Column) -> Column:
    """Full case folding.

    Texts of common characters are lower-cased and the few that folding takes further are
    replaced.  In other texts single characters are translated one by one, which costs many
    times as much; the few that become several are replaced in texts that hold any.
    """
    lower = F.lower(text)
    common = lower
    for char, folded in BEYOND_LOWER.items():
        common = F.replace(common, F.lit(char), F.lit(folded))
    before, after, several = fold_table()
    plain = F.translate(text, before, after)
    longer = plain
    for char, folded in several.items():
        longer = F.replace(longer, F.lit(char), F.lit(folded))
    rare = F.when(F.regexp_like(text, F.lit(_several_class())), longer).otherwise(plain)
    return (
        F.when(F.octet_length(text) == F.length(text), lower)
        .when(F.regexp_like(text, F.lit(_rare_class())), rare)
        .otherwise(common)
    )


def normalize_text(text: Column) -> Column:
    """Null to empty; two-character escapes n/r/t after a backslash to space; squeeze."""
    known = F.coalesce(text, F.lit(""))
    unescaped = F.regexp_replace(known, r"\\[nrt]", " ")
    return squeeze(F.when(F.contains(known, F.lit("\\")), unescaped).otherwise(known))


def norm_key(text: Column) -> Column:
    """Entity key: caseless, ё as е, whitespace squeezed, null as empty."""
    return squeeze(F.replace(casefold(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only values."""
    return ~F.coalesce(F.regexp_like(text, F.lit(NOT_WS)), F.lit(False))


def word_count(text: Column, squeezed: bool = False) -> Column:
    """Number of whitespace-separated words; null stays null.

    Once whitespace is squeezed, words are one more than the spaces; ``squeezed`` says
    the text already is in that form.
    """
    flat = text if squeezed else squeeze(text)
    gaps = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return gaps + (flat != "").cast("int")


def tokens(text: Column) -> Column:
    """All runs of word characters of the caseless text."""
    return F.regexp_extract_all(casefold(text), F.lit(f"{WORD}+"), F.lit(0))


def strip_punctuation(text: Column) -> Column:
    """Every run of characters that are neither letter nor digit becomes one space."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def text_digest(text: Column) -> Column:
    """128-bit stand-in for a long text key, so shuffles carry 32 bytes, not texts."""
    return F.md5(text)


def snippet(text: Column, n: int = 160) -> Column:
    """One-line preview: pipes and newlines replaced, cut to ``n`` with an ellipsis."""
    flat = F.translate(text, "|\n", "/ ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def squeezed_snippet(text: Column, n: int = 350) -> Column:
    """Preview of the whitespace-squeezed text."""
    flat = squeeze(F.translate(text, "|", "/"))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def truncate(text: Column, n: int = MAX_TEXT_CHARS) -> Column:
    return F.substring(text, 1, n)


def first_item(items: Column, delimiter: str = ";") -> Column:
    """First element of a delimited list, as written."""
    return F.element_at(F.split(items, delimiter), 1)


def first_item_or(items: Column, default: str, delimiter: str = ";") -> Column:
    """First element, stripped; null or blank becomes ``default``."""
    head = strip(F.coalesce(first_item(items, delimiter), F.lit("")))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit(default))


def item_count(items: Column, delimiter: str = ";") -> Column:
    return F.size(F.split(items, delimiter))


def has_emoji(text: Column, wide: bool = False) -> Column:
    return F.regexp_like(text, F.lit(EMOJI_WIDE if wide else EMOJI))


def has_url(text: Column) -> Column:
    return F.regexp_like(text, F.lit(URL))


def no_cyrillic(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(CYRILLIC))


def capital_share(text: Column) -> Column:
    """Share of capitals among letters; null when there are no letters."""
    letters = F.regexp_count(text, F.lit(LETTER))
    return F.try_divide(F.regexp_count(text, F.lit(CAPITAL)).cast("double"), letters.cast("double"))


def first_escape(text: Column) -> Column:
    """First backslash together with the character after it, or null."""
    return F.nullif(F.regexp_extract(text, r"(\\.)", 1), F.lit(""))


def shingles(words: Column, k: int = 3) -> Column:
    """Sliding k-word shingles, repeats included; a text shorter than k is one shingle."""
    whole = F.array(F.array_join(words, " "))
    sliding = F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)),
        lambda i: F.array_join(F.slice(words, i, k), " "),
    )
    return F.when(F.size(words) < k, whole).otherwise(sliding)
