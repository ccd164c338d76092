"""Column functions over texts: tokens, sentences, stripping, word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .constants import GROUND_STOP

TOKEN = "[a-z0-9]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: The white space that _EDGES means.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_AFTER_STOP = r"(?<=[.!?])\s+"


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, _EDGES, "")


def trimmed(piece: Column) -> Column:
    """As strip, for pieces of bounded length: only their ends are looked at, but each takes eight bytes more a byte for a while."""
    return F.btrim(piece, F.lit(_SPACES))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column, stop: list[str]) -> Column:
    return F.array_except(tokens(text), words_array(stop))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(strip(text), pattern, -1), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Stripped parts between ends of sentences."""
    return _parts(text, _AFTER_STOP)


def sentences_and_lines(text: Column) -> Column:
    """Stripped parts between ends of sentences or of lines."""
    return _parts(text, _AFTER_STOP + r"|\n+")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def fixed_digits(x: Column, digits: int) -> Column:
    """x with one or two digits behind the point, as C and Python print it: the double's exact value is rounded, and ties
    alone go to the even digit. (format_string rounds the shortest decimal form, half up.)"""
    scale, half = 10**digits, 1 << 29

    def text(v: Column) -> Column:
        # 60 bits behind the point; bits further down are under the least midpoint, so that they decide nothing
        bits = ((v - F.floor(v)) * float(1 << 60)).cast("long")
        low = bits.bitwiseAND((1 << 30) - 1) * scale
        high = F.shiftright(bits, 30) * scale + F.shiftright(low, 30)
        rest, below, q = high.bitwiseAND((1 << 30) - 1), low.bitwiseAND((1 << 30) - 1), F.shiftright(high, 30)
        up = (rest > half) | ((rest == half) & ((below > 0) | (q % 2 == 1)))
        total = F.floor(v) * scale + q + up.cast("long")
        return F.concat(F.floor(total / scale).cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))

    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.abs(x) < float(1 << 45), F.concat(sign, let(F.abs(x), text))).otherwise(F.format_string(f"%.{digits}f", x))


def claim_groundedness(claim: Column, context_tokens: Column) -> Column:
    """Share of a claim's tokens that the context has; 1 for a claim without tokens."""
    own = token_set(claim, GROUND_STOP)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, context_tokens)) / F.size(own))


def mean_or_one(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(scores) == 0, F.lit(1.0)).otherwise(total / F.size(scores))
