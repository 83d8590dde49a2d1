"""String literals with escapes, strict base64, and a stable 64-bit hash of texts; an error text beside the value, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .limits import first_error, input_bytes
from .values import bind

ESCAPE = r"\\(?:[\\\"nrt]|u\{[0-9A-Fa-f]+\})"
#: Fixed values of the FNV-1a hash: the start, and the prime less its bit 40.
FNV_START, FNV_LOW = 0xCBF29CE484222325, 0x1B3


def literal(text: Column) -> Column:
    """The text as a double-quoted literal; control characters become ``\\u{hex}``."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        plain = F.replace(plain, F.lit(char), F.lit("\\" + name))
    control = r"[\x00-\x1f\x7f-\x9f]"
    parts = F.regexp_extract_all(plain, F.lit(rf"{control}|[^\x00-\x1f\x7f-\x9f]+"), 0)
    spelt = lambda p: F.when(F.regexp_like(p, F.lit(f"^{control}$")), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(p))), F.lit("}"))).otherwise(p)
    plain = F.array_join(F.transform(parts, spelt), "")
    return F.concat(F.lit('"'), plain, F.lit('"'))


def literal_value(raw: Column) -> Column:
    """(``value``, ``error``) of a literal as :func:`literal` writes it."""
    return bind(F.regexp_extract(raw, r'(?s)^"(.*)"$', 1), lambda inner: _value(raw, inner))


def _value(raw: Column, inner: Column) -> Column:
    rest = F.regexp_replace(inner, ESCAPE, "")
    error = (
        F.when(raw.isNull(), None)
        .when(~F.regexp_like(raw, F.lit(r'(?s)^".*"$')), "invalid string literal")
        .when(F.regexp_like(rest, F.lit(r"\\u")), "invalid unicode escape")
        .when(F.regexp_like(rest, F.lit(r"\\$")), "unterminated string escape")
        .when(F.contains(rest, F.lit("\\")), "unsupported string escape")
    )
    # escapes and the runs between them, in turn
    parts = F.regexp_extract_all(inner, F.lit(rf"(?s){ESCAPE}|[^\\]+"), 0)
    code = lambda p: F.conv(F.regexp_extract(p, r"\{(.*)\}", 1), 16, 10).cast("long")
    beyond = F.exists(parts, lambda p: F.startswith(p, F.lit("\\u")) & ((F.length(p) > 12) | (code(p) > 0x10FFFF) | code(p).between(0xD800, 0xDFFF)))
    utf8 = lambda c: F.decode(F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in c])), "utf-8")
    six = lambda c, shift: F.lit(128) + F.call_function("shiftright", c, F.lit(shift)).bitwiseAND(F.lit(63))
    top = lambda c, shift, mark: F.lit(mark) + F.call_function("shiftright", c, F.lit(shift))
    char = lambda c: (
        F.when(c < 128, utf8([c]))
        .when(c < 2048, utf8([top(c, 6, 192), six(c, 0)]))
        .when(c < 65536, utf8([top(c, 12, 224), six(c, 6), six(c, 0)]))
        .otherwise(utf8([top(c, 18, 240), six(c, 12), six(c, 6), six(c, 0)]))
    )
    plain = lambda p: (
        F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p == "\\\\", "\\").when(p == '\\"', '"')
        .when(F.startswith(p, F.lit("\\u{")), char(code(p))).otherwise(p)
    )
    error = F.coalesce(error, F.when(beyond, "invalid unicode scalar"))
    return F.struct(F.when(error.isNull() & raw.isNotNull(), F.array_join(F.transform(parts, plain), "")).alias("value"), error.alias("error"))


def base64_value(text: Column, most: int | None = None) -> Column:
    """(``data``, ``error``) of base64 text: blanks and line ends may stand anywhere, all else must be exact, unused bits zero."""
    return bind(F.translate(text, " \n\r\t", ""), lambda clean: _decoded(text, clean, most))


def _decoded(text: Column, clean: Column, most: int | None) -> Column:
    whole = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
    error = (
        F.when(F.regexp_like(clean, F.lit("[^A-Za-z0-9+/=]")), "invalid base64 byte")
        .when(F.length(clean) % 4 != 0, "invalid base64 length")
        .when(~F.regexp_like(clean, F.lit(whole)), "invalid base64 padding")
        .when(F.regexp_like(clean, F.lit("(?:[^AQgw]==|[^AEIMQUYcgkosw048]=)$")) & ~F.regexp_like(clean, F.lit("[AQgw]==$")), "non-zero base64 padding bits")
    )
    error = first_error(input_bytes(text, most), error)
    return F.struct(F.when(error.isNull(), F.try_to_binary(clean, F.lit("base64"))).alias("data"), error.alias("error"))


def stable_hash(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as sixteen hex digits; 64 bits are held as two halves, for Spark's longs don't wrap."""
    at = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    mask = F.lit(0xFFFFFFFF)

    def step(data: Column, h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(data, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        low = h["low"].bitwiseXOR(byte)
        product = low * FNV_LOW
        high = h["high"] * FNV_LOW + F.call_function("shiftright", product, F.lit(32)) + F.call_function("shiftleft", low, F.lit(8))
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("high"), F.lit(FNV_START & 0xFFFFFFFF).cast("long").alias("low"))
    part = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    folded = bind(F.hex(F.encode(text, "utf-8")), lambda data: F.aggregate(at, start, lambda h, i: step(data, h, i), lambda h: F.concat(part(h["high"]), part(h["low"]))))
    return F.when(text.isNotNull(), folded)
