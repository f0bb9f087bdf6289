"""Check digits as column expressions over strings of ASCII digits and letters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All decimal digits of the basic plane beyond ASCII, and what each stands for.
_DIGITS = [chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Generator of the bech32 checksum, and the constants of its two versions.
_BECH32_GENERATOR, _BECH32_ENDS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3), (1, 0x2BC830A3)


def digits_of(text: Column) -> Column:
    """The decimal digits of a text, as ASCII."""
    return F.translate(F.regexp_replace(text, r"\P{Nd}", ""), "".join(_DIGITS), _ASCII)


def _digit(text: Column, place) -> Column:
    return F.ascii(F.substring(text, place, F.lit(1))) - 48


def thai_id_ok(digits: Column) -> Column:
    """13 digits whose last is (11 - weighted sum mod 11) mod 10, the weights being 13 down to 2."""
    total = sum((_digit(digits, F.lit(i + 1)) * (13 - i) for i in range(12)), F.lit(0))
    return (F.length(digits) == 13) & ((F.lit(11) - total % 11) % 10 == _digit(digits, F.lit(13)))


def card_ok(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_ok(iban: Column) -> Column:
    """ISO 13616: the first four characters last, letters as two digits, remainder 1 by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.length(iban).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def base58_ok(address: Column) -> Column:
    """25 bytes of which the last four begin the double SHA-256 of the others."""

    def times(b: Column, c: Column) -> Column:
        start = F.struct((F.instr(F.lit(_BASE58), c) - 1).alias("carry"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            v = x * 58 + s["carry"]
            return F.struct(F.floor(v / 256).cast("int").alias("carry"), F.concat(s["out"], F.array((v % 256).cast("int"))).alias("out"))

        return F.aggregate(b, start, step, lambda s: s["out"])

    zeros = F.array_repeat(F.lit(0), 25)
    low_first = F.aggregate(F.split(address, ""), zeros, times)
    raw = F.array_join(F.transform(F.reverse(low_first), lambda x: F.lpad(F.hex(x), 2, "0")), "")
    body = F.unhex(F.substring(raw, 1, 42))
    again = F.sha2(F.unhex(F.sha2(body, 256)), 256)
    return F.upper(F.substring(again, 1, 8)) == F.substring(raw, 43, 8)


def bech32_ok(address: Column) -> Column:
    """The checksum of a lower-case address with the prefix bc, in either version."""

    def step(total: Column, value: Column) -> Column:
        top = F.shiftright(total, 25)
        out = F.shiftleft(total.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(value)
        for i, g in enumerate(_BECH32_GENERATOR):
            out = F.when(F.shiftright(top, i).bitwiseAND(1) == 1, out.bitwiseXOR(F.lit(g).cast("long"))).otherwise(out)
        return out

    prefix = F.array(*(F.lit(v).cast("long") for v in (3, 3, 0, 2, 3)))  # "bc" expanded
    values = F.transform(F.split(F.substring(address, F.lit(4), F.length(address)), ""), lambda c: (F.instr(F.lit(_BECH32), c) - 1).cast("long"))
    return F.aggregate(F.concat(prefix, values), F.lit(1).cast("long"), step).isin(*_BECH32_ENDS)
