"""Text normalisation as column expressions. All stay in the JVM.

Classes are written out so that Java and other engines agree: ``WORD``, ``DIGIT`` and ``SPACE`` mean what they mean for
Unicode text, not only for ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The quotation marks that the rules know, and the punctuation that is removed.
SINGLE, DOUBLE = "‘’'´`", '"”“'
QUOTES = SINGLE + DOUBLE
PUNCTUATION = r"!#$%&\\()*+,\-./:;<=>?@\[\]^_{|}~"

#: Code points that may have a compatibility form: all planes that have any.
_DECOMPOSED = 0x80, 0x20000


@lru_cache(maxsize=2)
def ascii_table(fold_case: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters with one ASCII character as their compatibility form, what that is, and those with several."""
    single, made, several = [], [], []
    for c in map(chr, range(*_DECOMPOSED)):
        if not unicodedata.decomposition(c) and c.casefold() == c:
            continue
        if fold_case and c != c.lower() and len(c.lower()) == 1:
            continue  # lower() comes first
        out = unicodedata.normalize("NFKD", c.casefold() if fold_case else c).encode("ascii", "ignore").decode()
        if len(out) == 1:
            single.append(c)
            made.append(out)
        elif out:
            several.append((c, out))
    return "".join(single), "".join(made), tuple(several)


def _where(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to texts that have the pattern. The text is computed once, however often ``change`` names it."""
    return F.get(F.transform(F.array(c), lambda x: F.when(x.rlike(pattern), change(x)).otherwise(x)), F.lit(0))


def _to_ascii(c: Column, fold_case: bool) -> Column:
    single, made, several = ascii_table(fold_case)

    def spell(x: Column) -> Column:
        # Pairs as one text that is split: a constant of the plan, whatever their number.
        pairs = F.split(F.lit("\n".join(c + text for c, text in several)), "\n")
        return F.aggregate(pairs, x, lambda text, p: F.replace(text, F.substring(p, 1, 1), F.substring(p, 2, 99)))

    def fold(x: Column) -> Column:
        spelled = _where(x, "[" + "".join(c for c, _ in several) + "]", spell)
        return F.regexp_replace(F.translate(spelled, single, made), r"[^\x00-\x7f]", "")

    return _where(c, r"[^\x00-\x7f]", fold)


def casefold(c: Column) -> Column:
    """Unicode case folding: lower case, and ``ß`` as ``ss``, final sigma as sigma."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def remove_accents(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII."""
    return _to_ascii(c, False)


def collapse_spaces(c: Column) -> Column:
    """Two or more white space characters as one space; a single tab or line break stays."""
    return F.regexp_replace(c, f"[{SPACE}]{{2,}}", " ")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


#: Fixed value: backslash runs with a letter that isn't s, and self-closing tags.
SPECIAL = rf"(\\+[A-RT-Za-rt-z]?|<[{SPACE}]*/?[{SPACE}]*[{WORD}]*[{SPACE}]*/[{SPACE}]*>)"


def remove_special_chars(c: Column) -> Column:
    return collapse_spaces(_where(c, r"[\\<]", lambda x: F.regexp_replace(x, SPECIAL, " ")))


def remove_punctuations(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(c, f"[{PUNCTUATION}]", " "))


def remove_numbers(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(c, rf"(?i)[{DIGIT}]+(st|nd|rd|th)?", ""))


def remove_apostrophe(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(c, f"[{QUOTES}]", " "))


def remove_all_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]", "")


def split_contractions(c: Column) -> Column:
    """A quotation mark between a word and up to three letters parts them: ``don't`` becomes ``don 't``."""
    return _where(c, f"[{QUOTES}]", lambda x: F.regexp_replace(x, f"([{WORD}]+)([{QUOTES}]+)([{WORD}]{{1,3}})", "$1 '$3"))


def single_quotes(c: Column) -> Column:
    return F.regexp_replace(c, f"[{DOUBLE}]", "'")


#: The rules for quotations, in order: pattern and what replaces it.
QUOTATION_RULES = (
    (f"([{QUOTES}]+)([^{SPACE}{QUOTES}]+)([{QUOTES}]+)", "$2"),
    (f"([{QUOTES}]+)([{WORD}]{{3,}})", " $2 "),
    (f"([{WORD}]+)([{QUOTES}]+)([^{WORD}{DIGIT}])", " $1 "),
    (f"([{SPACE}]*)([{QUOTES}])([{SPACE}]*)([^{WORD}])", " "),
)


def strip_quotations(c: Column) -> Column:
    def rules(x: Column) -> Column:
        for pattern, to in QUOTATION_RULES:
            x = F.regexp_replace(x, pattern, to)
        return x

    return collapse_spaces(_where(c, f"[{QUOTES}]", rules))


def normalize_text(c: Column) -> Column:
    """Case folding, ASCII folding, special characters, spaces, trimming, quotations. Null stays null."""
    return strip_quotations(trim_ws(collapse_spaces(remove_special_chars(_to_ascii(F.lower(c), True)))))


def normalize_for_tokens(c: Column) -> Column:
    """The pipeline before embeddings, lexica and taggers: punctuation goes as well."""
    return remove_punctuations(normalize_text(c))


def normalize_for_ngrams(c: Column) -> Column:
    """The pipeline before n-grams: numbers go, contractions are parted, quotation marks become single."""
    return single_quotes(split_contractions(remove_numbers(remove_punctuations(normalize_text(c)))))


def ngram_tokens(c: Column) -> Column:
    """Words of two or more word characters, as the usual vectoriser takes them."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b[\p{L}\p{N}_]{2,}\b"), F.lit(0))
