"""Text rules of XML documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the five predefined entities; fixed values
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def condense(text: Column) -> Column:
    """Runs of white space to one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def encode(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for name in ("lt", "gt", "quot", "apos"):
        out = F.replace(out, F.lit(ENTITIES[name]), F.lit(f"&{name};"))
    return out


def decode(text: Column) -> Column:
    """Predefined entities and character references; unknown entities, and references to what is no
    character (0, surrogates, above U+10FFFF), stay as they are.

    The text is cut at each reference, so that what one yields is never read again.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,8};|&(?:lt|gt|quot|apos|amp);|[^&]+|&)"), F.lit(1))

    def one(p: Column) -> Column:
        hex_code = F.conv(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)
        code = F.when(p.rlike("^&#[xX]"), hex_code).when(p.rlike("^&#[0-9]"), F.regexp_extract(p, "^&#([0-9]+);$", 1))
        number = F.when((F.length(p) > 2) & code.isNotNull(), F.try_to_number(F.lpad(code, 8, "0"), F.lit("99999999")).cast("int"))
        out = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), _char(number))
        for name, sign in ENTITIES.items():
            out = out.when(p == f"&{name};", sign)
        return out.otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def _char(code: Column) -> Column:
    """The character with a Unicode number, through its UTF-8 bytes."""
    b = lambda lead, shift: F.lpad(F.hex(F.lit(lead) + F.shiftright(code, shift).bitwiseAND(F.lit(0x3F if lead == 0x80 else 0x7F))), 2, "0")
    one = F.lpad(F.hex(code), 2, "0")
    utf8 = (
        F.when(code < 0x80, one)
        .when(code < 0x800, F.concat(b(0xC0, 6), b(0x80, 0)))
        .when(code < 0x10000, F.concat(b(0xE0, 12), b(0x80, 6), b(0x80, 0)))
        .otherwise(F.concat(b(0xF0, 18), b(0x80, 12), b(0x80, 6), b(0x80, 0)))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def character(code: Column) -> Column:
    """The character with a Unicode number; NULL for 0, surrogates and numbers above U+10FFFF."""
    return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), _char(code.cast("int")))


def skip_mark(text: Column) -> Column:
    """``text`` without a byte-order mark at its begin."""
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def int_attribute(text: Column) -> Column:
    """Leading whole number; NULL if there is none or it needs more than 32 bits."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")


def unsigned_attribute(text: Column) -> Column:
    """Leading whole number as unsigned 32 bits: negative ones wrap; NULL if there is none or it needs more."""
    v = F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("long")
    return F.when(v.between(0, 0xFFFFFFFF), v).when(v.between(-0x80000000, -1), v + (1 << 32))


def double_attribute(text: Column) -> Column:
    """Leading number; NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def bool_attribute(text: Column) -> Column:
    """Texts that begin with true, yes or 1, or with false, no or 0, in any case."""
    low = F.lower(text)
    return F.when(low.rlike("^(true|yes|1)"), True).when(low.rlike("^(false|no|0)"), False)
