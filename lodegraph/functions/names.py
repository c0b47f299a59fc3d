"""Column functions over identifiers and words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def humps(name: Column) -> Column:
    """Blanks at camel humps and acronym ends (two passes without look-around, so that any engine can say the same)."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def segments(name: Column) -> Column:
    """Lower-case segments of an identifier: humps, acronyms, runs between other signs; digits stay with their word."""
    return F.filter(F.split(F.lower(humps(name)), "[^a-z0-9]+"), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case words for the inverted index: runs of letters and digits, ``_`` separates, camel case stays whole."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda s: s != "")


def stems(word: Column) -> Column:
    """Distinct stem variants of a lower-case word, of three letters or more and other than the word itself.

    Endings taken off: ing (also with e put on, or one of two equal last letters gone), the ion of tion and sion, ment, ies for y,
    else es, else s but not ss, ed but not eed (also ied for y), er (as ing).
    """
    n = F.length(word)
    ends = lambda *x: F.coalesce(word.rlike("(" + "|".join(x) + ")$"), F.lit(False))
    base = lambda k: F.substring(word, F.lit(1), n - k)
    when = lambda cond, value: F.when(cond, value)
    doubled = lambda k: F.substring(word, n - k, F.lit(1)) == F.substring(word, n - k - 1, F.lit(1))
    ing, er, ed = ends("ing") & (n > 5), ends("er") & (n > 4), ends("ed") & ~ends("eed") & (n > 4)
    ies, es = ends("ies") & (n > 4), ends("es") & (n > 4)
    variants = F.array(
        when(ing, base(3)), when(ing, F.concat(base(3), F.lit("e"))), when(ing & doubled(3), base(4)),
        when(ends("tion", "sion") & (n > 5), base(3)), when(ends("ment") & (n > 6), base(4)),
        F.when(ies, F.concat(base(3), F.lit("y"))).when(es, base(2)).when(ends("s") & ~ends("ss") & (n > 4), base(1)),
        when(ed, base(1)), when(ed, base(2)), when(ed & ends("ied") & (n > 5), F.concat(base(3), F.lit("y"))),
        when(er, base(2)), when(er, F.concat(base(2), F.lit("e"))), when(er & doubled(2), base(3)),
    )
    return F.array_sort(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (F.length(v) >= 3) & (v != word))))


def plain_word(word: Column) -> Column:
    """A word of prose in lower case without the combining marks of its letters."""
    # Each range of marked letters decomposes in the JVM; what has no decomposition stays.
    return F.lower(F.translate(word, MARKED, UNMARKED))


# Built from the public Unicode decompositions: letters of Latin, Greek and Cyrillic with marks, and their base letters.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x530) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_PAIRS += [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0x1E00, 0x2000) if len(unicodedata.normalize("NFD", chr(c))) > 1]
MARKED = "".join(a for a, _ in _PAIRS) + "".join(chr(c) for c in range(0x300, 0x370))
UNMARKED = "".join(b for _, b in _PAIRS)


def snake_to_camel(name: Column) -> Column:
    parts = F.split(name, "_")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))), "")


def kebab_to_pascal(name: Column) -> Column:
    """``my-own-tag`` as ``MyOwnTag``."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def contains_run(whole: Column, run: Column) -> Column:
    """Whether array ``run`` occurs contiguously in array ``whole``."""
    joined = lambda a: F.concat(F.lit("\x01"), F.array_join(a, "\x01"), F.lit("\x01"))
    return F.contains(joined(whole), joined(run))


def node_id(path: Column, kind: Column, name: Column, start_line: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", path, kind, name, start_line.cast("string")), 256)
    return F.concat(kind, F.lit(":"), F.substring(digest, 1, 32))
