"""Words of a text: separators, full case folding, stop words. All are column expressions."""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One separating character. Letters and digits of ASCII, U+007F, U+0080 to U+009F and all else beyond belong to words.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\xA0\xB0]"

#: English words that are dropped, shortest first.
STOP_WORDS = sorted(
    """
    yet you who why was too tis the she say so our own off on or of nor not no my me let its it is in if i
    how his him her has had he got get for ever else either did does do dear could cannot can by but because been be
    at as any an am a among also almost all after across about able and are from hers have however into just least
    like likely may might most must neither often only other rather said says should since some than that their them
    then there these they this to us wants we were what when where which while whom will with would your every
    """.split(),
    key=lambda w: (len(w), w[::-1]),
)


def _folding() -> tuple[str, str, dict[str, str]]:
    """What full case folding changes in a lower-cased text: single characters and their images, and the longer images."""
    source, target, longer = [], [], {}
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        if c.lower() == c and (image := c.casefold()) != c:
            if len(image) == 1:
                source.append(c)
                target.append(image)
            else:
                longer[c] = image
    return "".join(source), "".join(target), longer


_FROM, _TO, LONGER = _folding()


def _ranges(characters, gap: int = 48) -> str:
    """A regular expression's class of these characters and those between near ones: few ranges are quick to test."""
    out, codes = [], sorted(map(ord, characters))
    for n in codes:
        if out and n - out[-1][1] <= gap:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


#: Texts with none of these need no more than the two characters that fold otherwise in common languages.
_RARE = f"[{_ranges(set(_FROM) - {'ς'} | set(LONGER) - {'ß'})}]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Full case folding: lower case, then what it leaves (final sigma, long s, sharp s and the like)."""
    low = F.lower(as_column(text))
    full = F.translate(low, _FROM, _TO)
    for c, image in LONGER.items():
        full = F.replace(full, F.lit(c), F.lit(image))
    rare = low.rlike(_RARE)
    common = F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.when(low.rlike("[^\\x00-\\x7F]"), F.when(rare, full).otherwise(common)).otherwise(low)


def is_stop_word(word: Column | str) -> Column:
    return as_column(word).isin(STOP_WORDS)


def pieces(text: Column | str) -> Column:
    """Folded words before stop words go; a null text has none."""
    return F.array_remove(F.split(fold(F.coalesce(as_column(text), F.lit(""))), SEPARATOR + "+"), "")


def words(text: Column | str) -> Column:
    """The words of a text in their order, repeats kept, without stop words; a null text has none."""
    return F.filter(pieces(text), lambda w: ~is_stop_word(w))


def longer_than(values: Column | str, least: int) -> Column:
    """Whether an array has more than ``least`` elements; true for every array if least is negative."""
    return F.coalesce(F.size(as_column(values)), F.lit(0)) > least


def distinct_sorted(values: Column | str) -> Column:
    return F.array_sort(F.array_distinct(as_column(values)))


def separators(text: Column | str) -> Column:
    """The number of separating characters."""
    return F.coalesce(F.regexp_count(as_column(text), F.lit(SEPARATOR)), F.lit(0)).cast("bigint")
