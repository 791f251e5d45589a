"""Text and map functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What scripts in pages take for white space.
BLANK = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Named references of XML.
NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}
#: Code points that are no characters: beyond the last one, and halves of pairs.
LAST, HALVES = 0x10FFFF, (0xD800, 0xDFFF)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(BLANK.replace("[", "[^", 1) + "+"))


def without_tags(html: Column, instead: str = " ") -> Column:
    """The text with each tag, from < to the next >, replaced."""
    return F.regexp_replace(html, "<[^>]+>", instead)


def other_keys(values: Column, known: tuple[str, ...]) -> Column:
    """A map without the known keys."""
    return F.map_filter(values, lambda k, _: ~k.isin(*known))


def decoded(text: Column) -> Column:
    """Character references of XML once decoded: named ones, decimal and hexadecimal numbers.

    What a decoded reference spells is not decoded again. Unknown names, numbers of no character and references
    without a semicolon stay as they are.
    """
    parts = F.split(text, "&")

    def resolve(part: Column) -> Column:
        name = F.regexp_extract(part, r"\A(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[a-z]{2,4});", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        digits = F.when(F.substring(name, 2, 1).isin("x", "X"), F.substring(name, F.lit(3), F.length(name))).otherwise(F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
        code = F.conv(digits, 16, 10).cast("int")
        number = name.startswith("#") & code.between(1, LAST) & ~code.between(*HALVES)
        # one code point, as four bytes
        character = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        found = F.when(number, character)
        for word, c in NAMED.items():
            found = found.when(name == word, c)
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), part))

    references = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), resolve)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(references, ""))).otherwise(text)
