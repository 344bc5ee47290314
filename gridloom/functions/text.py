"""Text columns: instance names, cell types, report fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_of(name: Column, known: list[str], aliases: dict[str, str]) -> Column:
    """The module that a hierarchical instance name belongs to: its first segment (parted by dots and slashes,
    without ``u_`` and a trailing index) that is a known module or an alias of one; empty if there is none."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"^u_", ""), r"\[\d+\]$", "")
    segments = F.transform(F.split(name, r"[./]"), bare)
    table = F.create_map(*[F.lit(x) for k, v in {**{m: m for m in known}, **aliases}.items() for x in (k, v)])
    hits = F.filter(F.transform(segments, lambda s: F.try_element_at(table, s)), lambda m: m.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit(""))


def has_token(cell: Column, *tokens: str) -> Column:
    """Whether a cell type holds one of the tokens, whatever its case."""
    return F.upper(cell).rlike("|".join(tokens))


def first_number(*fields: Column) -> Column:
    """The first field that reads as a number other than zero."""
    return F.coalesce(*(F.nullif(f.try_cast("double"), F.lit(0.0)) for f in fields))


def short_hash(col: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(col, 256), 1, digits)


def id_list(packed: Column, separator: str = ";") -> Column:
    """Integers of a packed list, in order; what is no integer becomes null."""
    return F.transform(F.filter(F.transform(F.split(packed, separator), lambda t: F.trim(t)), lambda t: t != ""), lambda t: t.try_cast("int"))
