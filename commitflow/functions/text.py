"""Scalar text expressions: native column expressions, and splits of single words for the Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as Python's ``str`` methods see them, as regexes and as text. (A class that
# spells all of them out is several times slower than the Unicode-aware one.)
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
BLANK_END = r"(?U)[\s\x1c-\x1f]\z"
BLANKS_IN_LINE = r"(?U)[\s\x1c-\x1f&&[^\n]]+"
RARE_BLANK = r"(?U)[\s\x1c-\x1f&&[^ \n]]"
BLANK_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Fixed value: a token is a word run or one other character, with the blanks before it; blanks at
# the very end form a token of their own, so joining the tokens gives the text back.
PIECE = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])|\s+"

# The first-word class and the two spellings folded into "fix".
LEADING_WORD = r"^[\p{L}\p{N}_]+"
FIX_FORMS = ("fixing", "fixup")

# The punctuation split of the 13a scheme, applied in this order. The scheme also puts blanks
# around blanks, which changes no word, but costs a replacement for each of them.
SPLIT_13A = (
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# Entities unescaped by the 13a scheme, applied in this order.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
# The western normalisation of the edit-rate metric.
SPLIT_TER = (
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"'s ", " 's "),
    (r"'s$", " 's"),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
TER_PUNCT = r'[\.,\?:;!"\(\)]'


def strip(c: Column) -> Column:
    """Both ends stripped, as ``str.strip()``."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def _word_matches(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NOT_SPACE + "+"), F.lit(0))


def words(c: Column) -> Column:
    """Whitespace words, as ``str.split()`` without arguments. Without rare blanks a plain split finds the same ones."""
    plain = F.array_remove(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " "), "")
    return F.when(c.rlike(RARE_BLANK), _word_matches(c)).otherwise(plain)


def pieces(c: Column) -> Column:
    """Lossless word pieces."""
    return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


# Token schemes: name -> (splitter, glue that turns tokens back into text).
SCHEMES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "pieces": (pieces, ""),
    "words": (words, " "),
    "characters": (characters, ""),
}


def tokens(c: Column, scheme: str = "pieces") -> Column:
    return SCHEMES[scheme][0](c)


def detokenize(toks: Column, scheme: str = "pieces") -> Column:
    return F.array_join(toks, SCHEMES[scheme][1])


def token_count(c: Column, scheme: str = "pieces") -> Column:
    return F.size(tokens(F.coalesce(c, F.lit("")), scheme))


def take(arr: Column, n: int | Column) -> Column:
    """First ``n`` entries; a negative ``n`` counts as zero."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)))


def first_word(c: Column) -> Column:
    """Lower-cased word at offset 0, else null; ``fixing`` and ``fixup`` count as ``fix``."""
    w = F.nullif(F.lower(F.regexp_extract(c, LEADING_WORD, 0)), F.lit(""))
    return F.when(w.isin(*FIX_FORMS), F.lit("fix")).otherwise(w)


def plain_words(c: Column) -> Column:
    """Words after deleting ASCII punctuation and lower-casing."""
    return _word_matches(F.lower(F.regexp_replace(c, r"\p{Punct}", "")))


def prepare_13a(c: Column, lowercase: bool = False) -> Column:
    """The 13a scheme up to its punctuation split."""
    t = F.replace(c, F.lit("<skipped>"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.lower(t) if lowercase else t


def tokenize_13a(c: Column, lowercase: bool = False) -> Column:
    t = F.concat(F.lit(" "), prepare_13a(c, lowercase), F.lit(" "))
    for pattern, target in SPLIT_13A:
        t = F.regexp_replace(t, pattern, target)
    return _word_matches(t)


def rouge_words(c: Column) -> Column:
    """Lower case, every character outside a-z and 0-9 becomes a blank, whitespace split."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def prepare_ter(c: Column) -> Column:
    """The normalisation of the edit-rate metric up to its punctuation split."""
    t = F.replace(F.replace(c, F.lit("\n-"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.lower(t)


def ter_words(c: Column) -> Column:
    """Normalised, lower-cased, punctuation-free words of the edit-rate metric."""
    t = F.concat(F.lit(" "), prepare_ter(c), F.lit(" "))
    for pattern, target in SPLIT_TER:
        t = F.regexp_replace(t, pattern, target)
    return _word_matches(F.regexp_replace(t, TER_PUNCT, ""))


@dataclass(frozen=True)
class Split:
    """The units of a piece between two blanks of a prepared text, by replacements that no blank takes part in.

    Pieces that match ``plain`` are units themselves.
    """

    plain: str
    rules: tuple[tuple[str, str], ...]

    def lists(self, pieces: pa.Array) -> pa.Array:
        """The units of every piece; some of them may be empty."""
        t = pc.binary_join_element_wise("", pieces, "", " ")
        for pattern, target in self.rules:
            t = pc.replace_substring_regex(t, pattern, target.replace("$", "\\"))
        return pc.split_pattern(t, " ")

    def __call__(self, piece: str) -> tuple[str, ...]:
        return tuple(w for w in self.lists(pa.array([piece])).to_pylist()[0] if w)


# Fixed value: the blanks of ``BLANK_CHARS`` as a rule.
_BLANKS = ("[" + "".join(rf"\x{{{ord(c):x}}}" for c in BLANK_CHARS) + "]", " ")
_LETTERS = r"^[\pL\pN]+$"

# ``tokenize_13a``, ``ter_words`` and ``rouge_words`` of a piece: no rule looks past a blank.
split_13a = Split(_LETTERS, (*SPLIT_13A, _BLANKS))
split_ter = Split(_LETTERS, (*SPLIT_TER, (TER_PUNCT, ""), _BLANKS))
split_rouge = Split("^[a-z0-9]+$", (("[^a-z0-9]", " "),))
# Word runs and single other characters.
split_meteor = Split(r"^[\pL\pN_]+$", ((r"([^\pL\pN_])", " $1 "), (r"[\t\n\x0b\f\r]", " ")))


def ascii_punct_end(c: Column) -> Column:
    """True when the last character is ASCII punctuation."""
    return c.rlike(r"\p{Punct}\z")
