"""Numbers in words, as column expressions; the arithmetic is on groups of three digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = ["zero", *"one two three four five six seven eight nine".split(), "ten", "eleven", "twelve", *(f"{t}teen" for t in "thir four fif six seven eigh nine".split())]
TENS = [f"{t}ty" for t in "twen thir for fif six seven eigh nine".split()]
SCALES = ["", "thousand", "million", "billion", "trillion"]
IRREGULAR = dict(zip("one two three five eight nine twelve".split(), "first second third fifth eighth ninth twelfth".split()))


def _under_thousand(n: int) -> str:
    head, rest = divmod(n, 100)
    low = SMALL[rest] if rest < 20 else TENS[rest // 10 - 2] + (f" {SMALL[rest % 10]}" if rest % 10 else "")
    return f"{SMALL[head]} hundred" + (f" {low}" if rest else "") if head else low


#: The phrases from 0 to 999, which every longer number is made of: one constant of the plan.
PHRASES = [_under_thousand(n) for n in range(1000)]


def _pick(words: list[str], index: Column) -> Column:
    return F.try_element_at(F.array(*(F.lit(w) for w in words)), (index + 1).cast("int"))


def int_words(n: Column, groups: int = 5) -> Column:
    """A whole number below 10^(3 * groups) in words; minus for negative ones."""
    size = F.abs(n)
    parts = F.array(*(F.struct((F.floor(size / F.lit(1000**k)) % 1000).cast("int").alias("n"), F.lit(f" {SCALES[k]}" if k else "").alias("s")) for k in reversed(range(groups))))
    phrases = F.array(*(F.lit(p) for p in PHRASES))
    said = F.transform(F.filter(parts, lambda g: g["n"] > 0), lambda g: F.concat(F.try_element_at(phrases, g["n"] + 1), g["s"]))
    words = F.when(size == 0, F.lit("zero")).otherwise(F.array_join(said, " "))
    return F.when(n < 0, F.concat(F.lit("minus "), words)).otherwise(words)


def digit_words(digits: Column) -> Column:
    """Each digit of a string as a word."""
    return F.array_join(F.transform(F.filter(F.split(digits, "", -1), lambda d: d != ""), lambda d: F.coalesce(_pick(SMALL, F.expr("0") + d.try_cast("int")), d)), " ")


def year_words(year: Column) -> Column:
    """A year from 1000 to 2099 as it is spoken; other numbers in plain words."""
    century, rest = F.floor(year / 100), year % 100
    old = F.when(rest == 0, F.lit("hundred")).when(rest < 10, F.concat(F.lit("oh "), _pick(PHRASES[:100], rest))).otherwise(_pick(PHRASES[:100], rest))
    new = F.when(rest == 0, F.lit("two thousand")).when(rest < 10, F.concat(F.lit("two thousand "), _pick(PHRASES[:100], rest))).otherwise(F.concat(F.lit("twenty "), _pick(PHRASES[:100], rest)))
    return F.when((year < 1000) | (year > 2099), int_words(year)).when(year < 2000, F.concat_ws(" ", _pick(PHRASES[:100], century), old)).otherwise(new)


def ordinal_words(n: Column) -> Column:
    """A whole number as an ordinal."""
    words = int_words(n)
    last = F.substring_index(words, " ", -1)
    head = F.substring(words, F.lit(1), F.length(words) - F.length(last))
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    regular = F.when(F.endswith(last, F.lit("y")), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
    return F.when(n == 0, F.lit("zeroth")).otherwise(F.concat(head, F.coalesce(F.try_element_at(irregular, last), regular)))


def plural_word(phrase: Column) -> Column:
    """A phrase whose last word is in the plural."""
    return (
        F.when(F.regexp_like(phrase, F.lit("[^aeiou]y$")), F.concat(F.regexp_replace(phrase, "y$", ""), F.lit("ies")))
        .when(F.regexp_like(phrase, F.lit("(?:s|x|z|ch|sh)$")), F.concat(phrase, F.lit("es")))
        .otherwise(F.concat(phrase, F.lit("s")))
    )


_ROMAN = "^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"


def roman_value(roman: Column) -> Column:
    """The value of a canonical roman numeral up to 3999, in either case; null for other strings."""
    up = F.upper(roman)
    values = F.transform(F.filter(F.split(up, "", -1), lambda c: c != ""), lambda c: F.try_element_at(F.create_map(*(F.lit(x) for p in zip("MDCLXVI", (1000, 500, 100, 50, 10, 5, 1)) for x in p)), c))
    # from the right, a letter below the greatest so far is taken off
    total = F.aggregate(
        F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, v: F.struct((a["sum"] + F.when(v < a["top"], -v).otherwise(v)).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"]
    )
    return F.when((up != "") & F.regexp_like(up, F.lit(_ROMAN)), total)


def to_roman(n: Column) -> Column:
    """A number from 1 to 3999 as a roman numeral."""
    ones, tens = ["", *"I II III IV V VI VII VIII IX".split()], ["", *"X XX XXX XL L LX LXX LXXX XC".split()]
    hundreds, thousands = ["", *"C CC CCC CD D DC DCC DCCC CM".split()], ["", "M", "MM", "MMM"]
    return F.concat(_pick(thousands, F.floor(n / 1000)), _pick(hundreds, F.floor(n / 100) % 10), _pick(tens, F.floor(n / 10) % 10), _pick(ones, n % 10))
