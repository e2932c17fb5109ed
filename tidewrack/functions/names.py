"""Column functions on JavaScript names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ECMAScript reserves.
RESERVED = (
    "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally",
    "for", "function", "if", "implements", "import", "in", "instanceof", "interface", "let", "new", "null", "package", "private", "protected", "public", "return",
    "static", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield",
)


#: Names that strict code cannot bind.
STRICT_BINDINGS = ("arguments", "eval")


def is_reserved(name: Column) -> Column:
    """Whether no binding of a module can have this name, though it is spelled like one."""
    return name.isin(*RESERVED, *STRICT_BINDINGS)


#: What a name starts with, and what it goes on with.
_START, _PART = r"\p{L}\p{Nl}_$", r"\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$\u200c\u200d"


def is_identifier(name: Column) -> Column:
    """Whether a text can name a binding: letters of any script, their marks, digits, $ and _, no digit or mark first, and no reserved word."""
    return F.coalesce(name.rlike(rf"\A[{_START}][{_PART}]*\z") & ~is_reserved(name), F.lit(False))


def to_identifier(text: Column) -> Column:
    """A binding name made of a text: what cannot stand in a name goes, and _ comes before a reserved word, a first character that cannot start a name, or nothing."""
    plain = F.regexp_replace(text, f"[^{_PART}]+", "")
    starts = plain.rlike(rf"\A[{_START}]")
    return F.when(is_reserved(plain) | ~starts, F.concat(F.lit("_"), plain)).otherwise(plain)
