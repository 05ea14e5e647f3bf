"""The published Dutch suffix stemmer as Column expressions: it runs in the JVM on columns and inside lambdas over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: vowels, letters that lose their accent, and endings that lose a letter.
VOWELS = "aeiouyè"
ACCENTED, PLAIN = "äëïöüáéíóú", "aeiouaeiou"
DOUBLED = ("kk", "dd", "tt")

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _undouble(w: Column) -> Column:
    return F.when(F.substring(w, -2, 2).isin(*DOUBLED), _cut(w, 1)).otherwise(w)


def _ends(w: Column, ending: str, region: Column) -> Column:
    """The word has this ending, and it lies in the region."""
    return F.endswith(w, F.lit(ending)) & (F.length(w) - len(ending) >= region)


def _not_behind(w: Column, ending: str, *before: str) -> Column:
    """None of these stands before the ending."""
    return ~F.substring(w, -len(ending) - 1, 1).isin(*before)


def _without_en(w: Column, ending: str, p1: Column) -> Column:
    """The word without an ending -en or -ene, if a consonant stands before it (but not "gem")."""
    fit = _ends(w, ending, p1) & _not_behind(w, ending, *VOWELS) & ~F.endswith(w, F.lit("gem" + ending))
    return F.when(fit, _undouble(_cut(w, len(ending)))).otherwise(w)


def _without_s(w: Column, ending: str, p1: Column) -> Column:
    """The word without an ending -s or -se, if a consonant other than j stands before it."""
    return F.when(_ends(w, ending, p1) & _not_behind(w, ending, *VOWELS, "j"), _cut(w, len(ending))).otherwise(w)


def _without_e(w: Column, p1: Column) -> Column:
    return F.when(_ends(w, "e", p1) & _not_behind(w, "e", *VOWELS), _undouble(_cut(w, 1))).otherwise(w)


def _plural(w: Column, p1: Column) -> Column:
    """Step 1: -heden, -en(e) and -s(e)."""
    has = lambda ending: F.endswith(w, F.lit(ending))
    heid = F.when(_ends(w, "heden", p1), F.concat(_cut(w, 5), F.lit("heid"))).otherwise(w)
    en = F.when(has("ene"), _without_en(w, "ene", p1)).when(has("en"), _without_en(w, "en", p1))
    return F.when(has("heden"), heid).when(has("en") | has("ene"), en).when(has("se"), _without_s(w, "se", p1)).when(has("s"), _without_s(w, "s", p1)).otherwise(w)


def _heid(w: Column, p1: Column, p2: Column) -> Column:
    """Step 3a: -heid, and -en before it."""
    return F.when(_ends(w, "heid", p2) & _not_behind(w, "heid", "c"), _without_en(_cut(w, 4), "en", p1)).otherwise(w)


def _derived(w: Column, p1: Column, p2: Column, lost_e: Column) -> Column:
    """Step 3b: -end, -ing, -ig, -lijk, -baar and -bar."""
    ig = lambda x: _ends(x, "ig", p2) & _not_behind(x, "ig", "e")
    short = _cut(w, 3)
    return (
        F.when(_ends(w, "end", p2) | _ends(w, "ing", p2), F.when(ig(short), _cut(w, 5)).otherwise(_undouble(short)))
        .when(ig(w), _cut(w, 2))
        .when(_ends(w, "lijk", p2), _without_e(_cut(w, 4), p1))
        .when(_ends(w, "baar", p2), _cut(w, 4))
        .when(_ends(w, "bar", p2) & lost_e, short)
        .otherwise(w)
    )


def _marked(word: Column) -> Column:
    """Without accents, and with y and i that act as consonants in capitals."""
    plain = F.translate(F.lower(word), ACCENTED, PLAIN)
    first = F.when(F.startswith(plain, F.lit("y")), F.concat(F.lit("Y"), F.substring(plain, 2, 1 << 30))).otherwise(plain)
    marked = F.regexp_replace(first, f"({_V})(i{_V}|y)", "$1\x01$2")
    return F.replace(F.replace(marked, F.lit("\x01i"), F.lit("I")), F.lit("\x01y"), F.lit("Y"))


def _regions(w: Column) -> tuple[Column, Column]:
    """Where the two regions begin: behind the first and the second consonant that follows a vowel, the first after three letters."""
    reach = lambda pattern: F.nullif(F.length(F.regexp_extract(w, pattern, 0)), F.lit(0))
    first, second = reach(f"^{_C}*{_V}+{_C}"), reach(f"^{_C}*{_V}+{_C}+{_V}+{_C}")
    return F.coalesce(F.when(first < 3, 3).otherwise(first), F.length(w)), F.coalesce(second, F.length(w))


def _single_vowel(w: Column) -> Column:
    """Step 4: a double vowel between consonants becomes single; the capitals go."""
    single = F.regexp_replace(w, f"({_C})(?:(a)a|(e)e|(o)o|(u)u)([^{VOWELS}I])$", "$1$2$3$4$5$6")
    return F.translate(F.when(F.substring(w, -3, 2).isin("aa", "ee", "oo", "uu"), single).otherwise(w), "IY", "iy")


def dutch_stem(word: Column) -> Column:
    """The stem of a word; null stays null."""

    def steps(w, p1, p2):
        third = lambda one: _let(_without_e(one, p1), lambda two: _let(_heid(two, p1, p2), lambda x: _derived(x, p1, p2, one != two)))
        return _let(_plural(w, p1), third)

    regions = lambda w: F.struct(w.alias("w"), *[p.alias(n) for n, p in zip(("p1", "p2"), _regions(w))])
    return _let(_let(_let(_marked(word), regions), lambda s: steps(s["w"], s["p1"], s["p2"])), _single_vowel)
