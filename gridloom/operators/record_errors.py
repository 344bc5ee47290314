"""Records of delimited text: typed rows of the valid ones, the rest with the reason.

A record is read by a minimum-cost error parse. Its characters fall into quotes, delimiters and runs
of other text; a small automaton (field start, bare text, inside quotes, after the closing quote)
accepts what is well written, and dynamic programming over (symbol, automaton state, fields so far)
finds the cheapest way to insert or delete quotes and delimiters such that the record is accepted
with the column count of its file. Edits that mend a quoting fault (any edit of a quote, and a
delimiter put between a closing quote and text or between bare text and a quote) outweigh all edits
of other delimiters, so that they occur only where the quoting is at fault. A record of cost zero
whose values have their types loads; for the others the edits state the reason:

``quoting`` > ``column_count`` > ``value`` (no edit, but a value that is not of its type), and
``unknown_file`` where the file has no declared columns.

Defined results: a byte-order mark before and carriage returns after a record are no part of it; a
null, empty or blank record has no fields (``column_count``); records sent twice come out twice; very
long records are parsed whole; an integer beyond 64 bits is valid and loads as null; an empty table
gives empty results; input columns that clash with the columns made here raise ``ValueError``.

Plain records (no quotes, no blanks, plain numbers) are recognised by one regular expression per file
and cast in the JVM: they are the parse of cost zero. Only the rest goes to Python, in Arrow batches.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = re.compile(r"[+-]?[0-9]+")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Kind(NamedTuple):
    """Type of a field: how a text becomes a value (None: it is not of the type), the pattern of its plain
    writing, its Spark type."""

    read: Callable[[str], object]
    plain: str
    sql: T.DataType


def _integer(most: int | None) -> Callable[[str], object]:
    def read(text: str) -> object:
        if not INTEGER.fullmatch(text):
            return None
        digits = text.lstrip("+-").lstrip("0") or "0"
        if text[0] == "-" and digits != "0" or most is not None and (len(digits) > 9 or int(digits) > most):
            return None
        return int(digits) if len(digits) < 19 else BEYOND

    return read


def _number(most: float | None) -> Callable[[str], object]:
    def read(text: str) -> object:
        value = float(text) if NUMBER.fullmatch(text) else -1.0
        return value if value >= 0 and (most is None or value <= most) else None

    return read


BEYOND = object()  #: a valid integer that 64 bits do not hold
CELL = Kind(_integer(95), "(?:[0-8]?[0-9]|9[0-5])", T.IntegerType())
IDENT = Kind(_integer(None), "[0-9]{1,9}", T.LongType())
UNIT = Kind(_number(1.0), r"(?:0(?:\.[0-9]{1,15})?|1(?:\.0{1,15})?)", T.DoubleType())
LENGTH = Kind(_number(None), r"[0-9]{1,9}(?:\.[0-9]{1,9})?", T.DoubleType())
NAME = Kind(lambda text: text or None, "[A-Za-z0-9_]{1,200}", T.StringType())

#: The columns of each file.
LAYOUTS: dict[str, dict[str, Kind]] = {
    "strap_planned": {"fy": CELL, "fx": CELL, "density": UNIT},
    "activity": {"scenario": NAME, "module": NAME, "activity": UNIT, "mission_weight": UNIT},
    "bumps": {"bump_id": IDENT, "x_um": LENGTH, "y_um": LENGTH},
}

START, BARE, QUOTED, CLOSED = range(4)
#: Automaton: (state, symbol) -> state; a missing entry is a fault. Symbols: T text, C delimiter, Q quote.
STEP = {(START, "T"): BARE, (START, "C"): START, (START, "Q"): QUOTED, (BARE, "T"): BARE, (BARE, "C"): START, (QUOTED, "T"): QUOTED, (QUOTED, "C"): QUOTED, (QUOTED, "Q"): CLOSED, (CLOSED, "C"): START, (CLOSED, "Q"): QUOTED}


class Edits(NamedTuple):
    """The cheapest edits; quoting: how many of them mend the quoting."""

    quoting: int = 0
    insert_quote: int = 0
    delete_quote: int = 0
    insert_delimiter: int = 0
    delete_delimiter: int = 0


def cheapest_edits(symbols: str, columns: int) -> Edits:
    """Dynamic programming over the symbols of a record. Costs are compared as (edits that mend the
    quoting, other edits), then by kind of edit, so that the choice is always the same."""
    first = (0, 0, 0, 0, 0, 0)  # quoting, others, insert quote, delete quote, insert delimiter, delete delimiter
    layer: dict[tuple[int, int], tuple[int, ...]] = {(START, 1): first}

    def better(into: dict, key: tuple[int, int], cost: tuple[int, ...], add: tuple[int, ...]) -> bool:
        new = tuple(map(int.__add__, cost, add))
        if key in into and into[key] <= new:
            return False
        into[key] = new
        return True

    for symbol in [*symbols, "end"]:
        waiting = list(layer)
        while waiting:  # insertions before the symbol
            state, fields = key = waiting.pop()
            cost = layer[key]
            if (state, "Q") in STEP and better(layer, to := (STEP[state, "Q"], fields), cost, (1, 0, 1, 0, 0, 0)):
                waiting.append(to)
            if state != QUOTED and fields < columns:
                mends = (state, symbol) in ((BARE, "Q"), (CLOSED, "T"))
                if better(layer, to := (START, fields + 1), cost, (1 if mends else 0, 0 if mends else 1, 0, 0, 1, 0)):
                    waiting.append(to)
        if symbol == "end":
            break
        after: dict[tuple[int, int], tuple[int, ...]] = {}
        for (state, fields), cost in layer.items():
            to = STEP.get((state, symbol))
            more = fields + (symbol == "C" and state != QUOTED)
            if to is not None and more <= columns:
                better(after, (to, more), cost, (0,) * 6)
            if symbol == "Q":
                better(after, (state, fields), cost, (1, 0, 0, 1, 0, 0))
            elif symbol == "C":
                better(after, (state, fields), cost, (0, 1, 0, 0, 0, 1))
        layer = after
    best = min(layer[key] for key in layer if key[0] != QUOTED and key[1] == columns)
    return Edits(best[0], *best[2:])


_remembered = lru_cache(maxsize=50_000)(cheapest_edits)
SYMBOL = re.compile(r'[",]|[^",]+')


def fields_of(record: str) -> list[str]:
    """The fields of a record that the automaton accepts."""
    if '"' not in record:
        return [f.strip() for f in record.split(",")]
    fields, parts, state = [], [], START
    for m in SYMBOL.finditer(record):
        symbol = {'"': "Q", ",": "C"}.get(part := m.group(), "T")
        if symbol == "C" and state != QUOTED:
            fields.append("".join(parts))
            parts = []
        elif symbol != "Q" or state == CLOSED:
            parts.append(part)
        state = STEP[state, symbol]
    return [f.strip() for f in [*fields, "".join(parts)]]


def parse_record(record: str | None, layout: dict[str, Kind] | None) -> tuple[str | None, Edits, list[object]]:
    """Reason (None: the record loads), edits and values of one record."""
    if layout is None:
        return "unknown_file", Edits(), []
    record = (record or "").removeprefix("\ufeff").rstrip("\r")
    if not record.strip():
        return "column_count", Edits(insert_delimiter=len(layout)), []
    symbols = SYMBOL.sub(lambda m: {'"': "Q", ",": "C"}.get(m.group(), "T"), record)
    edits = (_remembered if len(symbols) < 200 else cheapest_edits)(symbols, len(layout))
    if edits.quoting:
        return "quoting", edits, []
    if any(edits):
        return "column_count", edits, []
    values = [kind.read(text) for kind, text in zip(layout.values(), fields_of(record), strict=True)]
    if any(v is None for v in values):
        return "value", edits, []
    return None, edits, [None if v is BEYOND else v for v in values]


def _columns(layouts: dict[str, dict[str, Kind]]) -> dict[str, T.DataType]:
    return {name: kind.sql for layout in layouts.values() for name, kind in layout.items()}


def _plain(text: Column, file: Column, layouts: dict[str, dict[str, Kind]]) -> Column:
    """Whether a record is in plain writing."""
    found = F.lit(False)
    for name, layout in layouts.items():
        found = F.when(file == name, text.rlike("^" + ",".join(k.plain for k in layout.values()) + r"\z")).otherwise(found)
    return F.coalesce(found, F.lit(False))


def _guard(df: DataFrame, keys: list[str], layouts: dict[str, dict[str, Kind]]) -> None:
    if len(set(keys)) < len(keys) or set(keys) & {"reason", "edits", *_columns(layouts)}:
        raise ValueError("keys must differ from each other and from the columns made by parsing")


def parsed_rest(df: DataFrame, keys: list[str], record: str, file: str, layouts: dict[str, dict[str, Kind]] = LAYOUTS) -> DataFrame:
    """The records that are not in plain writing, parsed: keys, reason, edits, typed columns."""
    _guard(df, keys, layouts)
    columns, edit_type = _columns(layouts), T.StructType([T.StructField(n, T.IntegerType()) for n in Edits._fields])
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("reason", T.StringType()), T.StructField("edits", edit_type), *(T.StructField(n, t) for n, t in columns.items())])
    arrow = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
    names = {f: {n: i for i, n in enumerate(layout)} for f, layout in layouts.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, lines = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            done = [parse_record(line, layouts.get(f)) for f, line in zip(files, lines, strict=True)]
            made = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1]._asdict() for d in done], pa.struct([(n, pa.int32()) for n in Edits._fields]))]
            for name, kind in columns.items():
                at = [names.get(f, {}).get(name) if d[2] else None for f, d in zip(files, done, strict=True)]
                made.append(pa.array([None if i is None else d[2][i] for i, d in zip(at, done, strict=True)], arrow[kind]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=schema.names)

    rest = df.where(~_plain(F.col(record), F.col(file), layouts))
    return rest.select(*keys, F.col(file).alias("_file"), F.col(record).alias("_record")).mapInArrow(parse, schema)


def bad_records(df: DataFrame, keys: list[str], record: str, file: str, layouts: dict[str, dict[str, Kind]] = LAYOUTS) -> DataFrame:
    """The records that do not load: keys, reason and edits."""
    return parsed_rest(df, keys, record, file, layouts).where("reason is not null").select(*keys, "reason", "edits")


def loaded_records(df: DataFrame, keys: list[str], record: str, file: str, layouts: dict[str, dict[str, Kind]] = LAYOUTS) -> DataFrame:
    """The valid records as typed rows: keys and the columns of all files (null where a file has no such column)."""
    _guard(df, keys, layouts)
    values: dict[str, Column] = {n: F.lit(None).cast(t) for n, t in _columns(layouts).items()}
    parts = F.split(F.col(record), ",")
    for name, layout in layouts.items():
        for i, (column, kind) in enumerate(layout.items()):
            values[column] = F.when(F.col(file) == name, F.try_element_at(parts, F.lit(i + 1)).try_cast(kind.sql)).otherwise(values[column])
    plain = df.where(_plain(F.col(record), F.col(file), layouts)).select(*keys, *(v.alias(n) for n, v in values.items()))
    rest = parsed_rest(df, keys, record, file, layouts).where("reason is null")
    return plain.unionByName(rest.select(plain.columns))
