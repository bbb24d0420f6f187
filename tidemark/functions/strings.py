"""Slugs, keys, masks and accent-free text as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode decomposition."""
    accented, plain = [], []
    for point in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        letter = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def without_accents(text: Column) -> Column:
    """Base letters only: accented letters are replaced, loose combining marks dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")


def normalized(text: Column) -> Column:
    """Lower case, no accents, single spaces, trimmed: the form patterns are matched against."""
    spaced = F.regexp_replace(without_accents(F.lower(text)), r"(?U)\s+", " ")
    return F.trim(spaced)


def slug(text: Column) -> Column:
    """'Tarjeta Crédito' -> 'tarjeta_credito', for column names made from values."""
    return F.regexp_replace(F.translate(F.lower(text), "áéíóúüñ", "aeiouun"), "[^a-z0-9]+", "_")


def plain_slug(value: str) -> str:
    """slug() of a configured value, on the driver."""
    import re

    return re.sub("[^a-z0-9]+", "_", value.lower().translate(str.maketrans("áéíóúüñ", "aeiouun")))


def city_key(city: Column) -> Column:
    """'Ciudad de México' -> 'ciudad_de_mexico'; null when nothing is left."""
    key = F.regexp_replace(normalized(city), "[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(key, "^_+|_+$", ""), F.lit(""))


def mask_tail(text: Column, shown: int = 4) -> Column:
    """'****' and the last characters; null stays null."""
    return F.concat(F.lit("****"), F.right(text, F.lit(shown)))


def mask_email(text: Column) -> Column:
    """'maria.lopez@mail.com' -> 'm***@mail.com'."""
    return F.regexp_replace(text, "^(.)[^@]*@", "$1***@")


def short_name(first: Column, last: Column) -> Column:
    """First name and the initial of the last: 'Ana R.'."""
    return F.concat_ws(" ", first, F.concat(F.left(last, F.lit(1)), F.lit(".")))


def pseudonym(value: Column, length: int = 10) -> Column:
    """The first hex digits of SHA-256: stable, and not the id."""
    return F.left(F.sha2(value.cast("string"), 256), F.lit(length))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of int, by sums of blocks: each adds one block at most and the blocks before it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)
    which = lambda i: F.floor(i / block).cast("int")

    def with_blocks(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), which(F.size(v) - 1)), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))
        return bind(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (
            total(F.slice(s, F.lit(1), which(i))) + total(F.slice(v, which(i) * block + 1, i % block + 1)))))

    return bind(values, with_blocks)


def places(text: Column, pattern: str) -> Column:
    """start and end, in code points, of every match of a pattern that never matches nothing: running sums of the lengths of
    matches and of the gaps between them."""
    def found(matches: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, match: F.length(gap) + F.length(match))
        rows = bind(running_sums(steps), lambda ends: F.zip_with(matches, ends, lambda match, end: F.struct((end - F.length(match)).alias("start"), end.alias("end"))))
        none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
        return F.when(F.size(matches) == 0, none).otherwise(rows.cast("array<struct<start:int,end:int>>"))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
