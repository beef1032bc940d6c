"""Values, tags and names as text: the re-parseable form."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.functions import histogram as hg
from tsq.schema import BOOL, DOUBLE, EMPTY, HISTOGRAM, STRING

#: Escapes of control characters that have a letter.
LETTERS = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}


def escape(s: str, quote: str) -> str:
    """s with control characters, backslashes, quotes and characters beyond ASCII escaped."""
    out = []
    for c in s:
        n = ord(c)
        if n in LETTERS:
            out.append("\\" + LETTERS[n])
        elif n < 32:
            out.append(f"\\{n:03o}")
        elif c in ("\\", quote):
            out.append("\\" + c)
        elif n > 0xFFFF:
            out.append(f"\\U{n:08x}")
        elif n > 127:
            out.append(f"\\u{n:04x}")
        else:
            out.append(c)
    return "".join(out)


def quoted(s: str) -> str:
    return f'"{escape(s, chr(34))}"'


def name(s: str) -> str:
    """An identifier, in quotes unless it is lower case and plain."""
    plain = bool(s) and s[0] in "_abcdefghijklmnopqrstuvwxyz" and all(c in "_abcdefghijklmnopqrstuvwxyz0123456789" for c in s)
    return s if plain else f"'{escape(s, chr(39))}'"


def _escaped(s: Column) -> Column:
    """Text of a string in the JVM: characters that need no escape pass as they are."""
    parts = F.transform(F.split(s, ""), lambda c: _escaped_char(c))
    return F.when(s.rlike(r'^[ !#-\[\]-~]*\z'), s).otherwise(F.array_join(parts, ""))


def _escaped_char(c: Column) -> Column:
    n = F.ascii(c)
    out = F.when(c.isin("\\", '"'), F.concat(F.lit("\\"), c))
    for code, letter in LETTERS.items():
        out = out.when(n == code, "\\" + letter)
    return out.when((n < 32) & (F.length(c) > 0), F.concat(F.lit("\\"), F.lpad(F.conv(n.cast("string"), 10, 8), 3, "0"))).when(n > 0xFFFF, F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(n)), 8, "0"))).when(n > 127, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))).otherwise(c)


def value(x: Column) -> Column:
    """Text of a value: (none) for empty, texts quoted; null if absent."""
    k = x["kind"]
    d = x["d"]
    real = F.when(F.isnan(d), "nan").when((d == F.rint(d)) & (F.abs(d) < 1e15), F.format_string("%.1f", d)).otherwise(d.cast("string"))
    return (
        F.when(k == EMPTY, "(none)")
        .when(k == BOOL, F.when(x["b"], "true").otherwise("false"))
        .when(k == DOUBLE, real)
        .when(k == STRING, F.concat(F.lit('"'), _escaped(x["s"]), F.lit('"')))
        .when(k == HISTOGRAM, hg.text(x["h"]))
        .otherwise(F.coalesce(x["i"].cast("string"), x["u"].cast("string")))
    )


def _name(c: Column) -> Column:
    return F.when(c.rlike("^[_a-z][_a-z0-9]*$"), c).otherwise(F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))


def path(p: Column) -> Column:
    return F.array_join(F.transform(p, _name), ".")


def tags(t: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(t, lambda x: F.concat(_name(x.k), F.lit("="), value(x.v))), ", "), F.lit("}"))
