"""Several values packed in one field: one row per value, with its place.

Every field is cut by a cover of segments. Segments that may stand in a cover are

* quoted pairs: a quote, single or double, up to the same quote that closes it; a doubled quote
  inside stands for one, and white space at the ends of the content is dropped;
* bare runs: longest runs of ASCII letters, digits and underscores outside quotes;
* under ``bare_hits=True`` also known whole values outside quotes, which protects the delimiters
  inside them. Where the field's grammar says that all else outside quotes separates, they may not.

A multi-pattern (Aho-Corasick) automaton of the known whole values runs over every field, and dynamic
programming picks the cover with most characters in known values. Every quote of a well-written field
stands in a pair: such a field has one admissible cover, whatever is known. Where the reading from the
left leaves quotes without partner (an apostrophe, a lost quote), any cover with no more such quotes is
admissible: those compete, and what is known decides; among equals the one that opens pairs first from
the left wins, which with nothing known is the reading from the left. A quote outside pairs only
separates, as does everything that no segment holds. Empty values are no values.

The known values are tables of any size. Those of a group lie in as many shards of about ``SHARD`` values
as they need, by hash of the value. A field meets the shards that can hold one of its candidates (all,
where there is one), each in a stream: a shard's values come first and become the automaton, its fields
follow in batches. A shard with many fields stands in several tasks. Values known of all groups are
broadcast where one automaton holds them, so that each field is read once; else they are one more group,
which all fields meet. What several automata found is gathered by field, where the cover is picked.

Defined results: null field -> no row; blank or delimiter-only field -> no row; repeated values all
come out, each with its own place; rows that repeat are each cut; very long fields are cut whole
(time linear in their length); columns of the input named like the new ones must be renamed by the
caller (``ValueError``), names beginning with ``_v_`` too; an empty table gives an empty result; a
null group knows only what is known of null groups and of all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = re.compile(r"[A-Za-z0-9_]+")
PART = re.compile(r"""[A-Za-z0-9_]+|["']""")
SHARD = 100_000  # known values of a group that one automaton holds
CHARS = 16_000_000  # characters of the values known of all that every task holds
SHARE = 50_000  # fields of a group that meet one automaton in one task
CANDIDATES = 8  # shards that a field is taken to meet, where the number of tasks is set
BUCKETS = 4_096  # of groups, whose largest sizes the driver gets


def automaton(known: Iterable[str]) -> ahocorasick.Automaton | None:
    """The multi-pattern automaton of the known values, if there is any."""
    made = ahocorasick.Automaton()
    for value in known:
        if value:
            made.add_word(value, len(value))
    if not len(made):
        return None
    made.make_automaton()
    return made


def partners(text: str) -> dict[int, int]:
    """For each quote that has one, the place of the quote that would close it."""
    closes: dict[int, int] = {}
    for quote in "'\"":
        at, later = text.rfind(quote), -1
        while at >= 0:
            if later >= 0:
                if text[later + 1 : later + 2] != quote:
                    closes[at] = later
                elif later + 1 in closes:  # a doubled quote is content; what closes its second half closes this
                    closes[at] = closes[later + 1]
            at, later = text.rfind(quote, 0, at), at
    return closes


def _content(text: str, start: int, end: int) -> str:
    """The value of the pair of quotes at ``start`` and ``end``."""
    return text[start + 1 : end].replace(text[start] * 2, text[start]).strip()


def _from_the_left(text: str) -> tuple[list[str], list[str], int]:
    """The reading from the left: its values, those of them that are quoted, and its quotes without partner."""
    closes, values, quoted, strays, at = partners(text), [], [], 0, 0
    while m := PART.search(text, at):
        at = m.end()
        if (c := m.group()) not in "\"'":
            values.append(c)
        elif (end := closes.get(m.start(), -1)) < 0:
            strays += 1
        else:
            at = end + 1
            if value := _content(text, m.start(), end):
                values.append(value)
                quoted.append(value)
    return values, quoted, strays


def candidates(text: str) -> list[str]:
    """All values that some cover of a field holds."""
    pairs = (_content(text, a, b) for a, b in partners(text).items())
    return sorted({*RUN.findall(text), *(v for v in pairs if v)})


def known_segments(text: str, *hits: ahocorasick.Automaton) -> list[int]:
    """Begin and end, one after the other, of the runs and quoted pairs of a field that an automaton knows."""
    spans = {(end + 1 - size, end + 1) for known in hits for end, size in known.iter(text)}
    found = [x for m in RUN.finditer(text) if m.span() in spans for x in m.span()]
    if '"' in text or "'" in text:
        for start, end in partners(text).items():
            if (value := _content(text, start, end)) and any(value in known for known in hits):
                found += start, end + 1
    return found


def _cover(text: str, found: set[tuple[int, int]], spans: Iterable[tuple[int, int]] | None = None) -> list[str]:
    """The values of the best cover with no more quotes outside pairs than the reading from the left leaves. ``found``:
    the runs and pairs that are known; ``spans``: known values anywhere that may stand in the cover too."""
    strays = _from_the_left(text)[2] if '"' in text or "'" in text else 0
    bare_hits = spans is not None
    bare: dict[int, list[int]] = {}
    for a, b in sorted(spans or ()):
        bare.setdefault(a, []).append(b)
    runs = {m.start(): m.end() for m in RUN.finditer(text)}
    starts = sorted({m.start() for m in PART.finditer(text)} | set(bare))
    closes = partners(text) if '"' in text or "'" in text else {}
    # by node and the number of quotes that may still stand alone: known characters, segments (fewer are better among
    # known values outside quotes), the node and number after it, the segment's end (0: none)
    none = (-1, 0, 0, 0, 0)
    best = [[none] * (strays + 1) for _ in starts] + [[(0, 0, 0, 0, 0)] * (strays + 1)]
    for i in range(len(starts) - 1, -1, -1):
        start = starts[i]
        if not bare_hits and start in runs:  # one option
            end = runs[start]
            gain = end - start if (start, end) in found else 0
            best[i] = [(rest[0] + gain, 0, i + 1, s, end) if rest[0] >= 0 else none for s, rest in enumerate(best[i + 1])]
            continue
        options: list[tuple[int, int, int, int]] = []  # end, known characters, quotes left alone, where the next segment may begin
        if text[start] in "\"'":
            if (end := closes.get(start, -1)) >= 0:
                options.append((end + 1, len(_content(text, start, end)) if (start, end + 1) in found else 0, 0, end + 1))
            options.append((0, 0, 1, start + 1))
        elif start in runs:
            options.append((runs[start], runs[start] - start if (start, runs[start]) in found else 0, 0, runs[start]))
        for end in bare.get(start, ()):
            if end > runs.get(start, 0) and not (RUN.match(text[end - 1]) and RUN.match(text[end : end + 1])):
                options.append((end, end - start, 0, end))
        options = options or [(0, 0, 0, start + 1)]
        for s in range(strays + 1):
            top = none
            for end, gain, alone, after in options:
                if alone > s or (rest := best[n := bisect_left(starts, after)][s - alone])[0] < 0:
                    continue
                made = (rest[0] + gain, rest[1] - bool(end) if bare_hits else 0, n, s - alone, end)
                if made[:2] > top[:2]:
                    top = made
            best[i][s] = top
    values, i, s = [], 0, strays
    while i < len(starts):
        start, (_, _, n, left, end) = starts[i], best[i][s]
        if end:
            pair = text[start] in "\"'" and closes.get(start, -1) == end - 1
            if value := _content(text, start, end - 1) if pair else text[start:end]:
                values.append(value)
        i, s = n, left
    return values


def _best(text: str, places: list[int]) -> list[str]:
    """The values of the best cover by begin and end of the known segments."""
    return _cover(text, set(zip(places[::2], places[1::2], strict=True)))


def segment(text: str, hits: ahocorasick.Automaton | None = None, bare_hits: bool = False) -> list[str]:
    """The values of one field, in the order of the text."""
    if hits is None:
        return _cover(text, set())
    places = known_segments(text, hits)
    spans = {(end + 1 - size, end + 1) for end, size in hits.iter(text)} if bare_hits else None
    return _cover(text, set(zip(places[::2], places[1::2], strict=True)), spans)


def quoted_values(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``value``: what stands in quotes in fields of which every quote has a partner."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read_ = (_from_the_left(x) for x in batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([q if not s else [] for _, q, s in read_], pa.list_(pa.string()))], names=[*keep, "_v_list"])

    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("_v_list", T.ArrayType(T.StringType()))])
    return df.where(F.col(column).rlike("[\"']")).select(*keep, F.col(column).cast("string")).mapInArrow(read, schema).select(*keep, F.explode("_v_list").alias("value"))


def _number(of: dict[int, int]) -> Column:
    """The number noted for the bucket of a row, 1 where none is."""
    if not of:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), _bucket()), F.lit(1))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("_v_group"), F.lit(BUCKETS)).cast("int")


def _sizes(df: DataFrame) -> tuple[dict[int, int], int]:
    """By bucket of groups, the rows of its largest group; all rows."""
    counts = df.groupBy("_v_group").count().groupBy(_bucket().alias("bucket")).agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    found = counts.collect()  # BUCKETS rows at most
    return {r["bucket"]: r["most"] for r in found}, sum(r["all"] for r in found)


def _cut_up(known: int, fields: int) -> tuple[int, int]:
    """Shards of so many known values, and tasks for each shard where so many fields meet them."""
    shards = -(-known // SHARD) or 1
    return shards, -(-fields * min(shards, CANDIDATES) // shards // SHARE) or 1


def _few(values: DataFrame) -> list[str] | None:
    """The values, if one automaton holds them."""
    size = values.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_v_text")), F.lit(0)).alias("chars")).first()
    return [r["_v_text"] for r in values.select("_v_text").collect()] if size["n"] <= SHARD and size["chars"] <= CHARS else None


def _meetings(rows: DataFrame, own: DataFrame | None, general: DataFrame | None) -> tuple[DataFrame, bool]:
    """Known values (``_v_row`` null) and fields (every row of ``rows`` once for each shard that it meets) by ``_v_group``
    and ``_v_part``, numbers of the group's automata: from 0 for what is known of it, below 0 for what is known of all.
    Then, whether each row is there once."""
    carried = [c for c in rows.columns if c not in ("_v_group", "_v_text")]
    numbered = rows.withColumn("_v_row", F.monotonically_increasing_id())
    if own is None and general is None:
        return numbered.select("_v_group", F.lit(0).alias("_v_part"), "_v_row", "_v_text", *carried), True
    fields, n_fields = _sizes(rows)
    sides: list[tuple[DataFrame, Column, Column, bool]] = []  # known values, number of shards, tasks for each, known of all
    sharded = False
    if own is not None:
        held, _ = _sizes(own)
        sizes = {b: _cut_up(held.get(b, 0), n) for b, n in fields.items()}
        sharded = any(s > 1 for s, _ in sizes.values())
        sides.append((own, _number({b: s for b, (s, _) in sizes.items() if s > 1}), _number({b: r for b, (_, r) in sizes.items() if r > 1}), False))
    if general is not None:
        shards, tasks = _cut_up(general.count(), n_fields)
        sharded = sharded or shards > 1
        sides.append((general, F.lit(shards), F.lit(tasks), True))

    def part(shard: Column, tasks: Column, salt: Column, general_: bool) -> Column:
        n = shard * tasks + salt
        return (-1 - n if general_ else n).cast("int")

    def shard(value: Column, shards: Column) -> Column:
        return F.pmod(F.xxhash64(value), shards)

    def visits(shards: Column, tasks: Column, general_: bool) -> Column:
        of = F.array(F.lit(0).cast("long"))
        if sharded:
            of = F.when(shards == 1, of).otherwise(F.array_distinct(F.transform("_v_list", lambda x: shard(x, shards))))
        whose = F.lit(None).cast("string") if general_ else F.col("_v_group")
        salt = F.pmod(F.xxhash64("_v_row"), tasks)
        return F.transform(of, lambda n: F.struct(whose.alias("_v_group"), part(n, tasks, salt, general_).alias("_v_part")))

    def parts(shards: Column, tasks: Column, general_: bool) -> Column:
        return F.transform(F.sequence(F.lit(0), tasks - 1), lambda k: part(shard(F.col("_v_text"), shards), tasks, k, general_))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_v_text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([candidates(x) for x in texts], pa.list_(pa.string()))], names=[*batch.schema.names, "_v_list"])

    met = numbered.mapInArrow(listed, T.StructType([*numbered.schema, T.StructField("_v_list", T.ArrayType(T.StringType()))])) if sharded else numbered
    out = met.select("_v_row", "_v_text", *carried, F.explode(F.concat(*(visits(*x) for _, *x in sides))).alias("_v_visit")).select("_v_visit.*", "_v_row", "_v_text", *carried)
    for values, *x in sides:
        spread = values.select("_v_group", F.explode(parts(*x)).alias("_v_part"), F.lit(None).cast("long").alias("_v_row"), "_v_text")
        out = out.unionByName(spread, allowMissingColumns=True)
    by = ["_v_group", "_v_part"]
    return out.repartition(*by).sortWithinPartitions(*by, F.col("_v_row").asc_nulls_first()), len(sides) == 1 and not sharded


def read_fields(rows: DataFrame, known: list[DataFrame], group: str | None, kind: T.DataType, covers: bool = True) -> DataFrame:
    """``rows`` without ``_v_group`` and ``_v_text``, with ``_v_values``, those of the best cover of the text; without ``covers``
    with ``_v_hits`` instead: begin and end of the text's segments that are known values."""
    shape = lambda values, by: values.select(by.alias("_v_group"), F.col("value").cast("string").alias("_v_text")).where("_v_text <> ''")
    own = [shape(v, F.col(group).cast(kind).cast("string")) for v in known if group in v.columns]
    general = [shape(v, F.lit(None).cast("string")) for v in known if group not in v.columns]
    many = reduce(DataFrame.unionByName, general).distinct() if general else None
    few = _few(many) if general else []
    meetings, once = _meetings(rows, reduce(DataFrame.unionByName, own) if own else None, many if few is None else None)
    everywhere = rows.sparkSession.sparkContext.broadcast(few or [])
    places, values = T.StructField("_v_hits", T.ArrayType(T.IntegerType())), T.StructField("_v_values", T.ArrayType(T.StringType()))
    at_once = once and covers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        always = [a for a in [automaton(everywhere.value)] if a]
        words, hits = ahocorasick.Automaton(), None
        for batch in batches:
            kept: list[int] = []
            made: list[list] = []
            for i, (g, p, row, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if (g, p) != at:
                    at, words, hits = (g, p), ahocorasick.Automaton(), None
                if row is None:
                    words.add_word(text, len(text))
                    continue
                if hits is None:
                    words.make_automaton()
                    hits = [words, *always] if len(words) else always
                found = known_segments(text, *hits)
                kept.append(i)
                made.append(_best(text, found) if at_once else found)
            if kept:
                columns = batch.take(pa.array(kept)).columns
                yield pa.RecordBatch.from_arrays([*(columns[4:] if at_once else columns[2:]), pa.array(made, pa.list_(pa.string() if at_once else pa.int32()))], names=[*batch.schema.names[4 if at_once else 2 :], values.name if at_once else places.name])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_best(x, h) for x, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, pa.list_(pa.string()))], names=[*batch.schema.names[2:], values.name])

    carried = meetings.schema.fields[4:]
    if at_once:
        return meetings.mapInArrow(scan, T.StructType([*carried, values]))
    found = meetings.mapInArrow(scan, T.StructType([*meetings.schema.fields[2:], places]))
    names = [f.name for f in carried]
    if not once:
        found = found.groupBy("_v_row").agg(*(F.first(c).alias(c) for c in ["_v_text", *names]), F.flatten(F.collect_list("_v_hits")).alias("_v_hits"))
    return found.select("_v_text", "_v_hits", *names).mapInArrow(cut, T.StructType([*carried, values])) if covers else found.select(*names, "_v_hits")


def split_packed(df: DataFrame, column: str, keys: list[str], known: list[DataFrame] = [], group: str | None = None, pos: str = "pos", value: str = "value") -> DataFrame:  # noqa: B006
    """One row per value of ``column``: ``keys``, ``pos`` (from 1) and ``value``.

    ``known``: tables with a column ``value`` of known whole values; one that has the column ``group`` too, by its name
    in ``df``, knows them for that group only. Every field meets the automata of what is known of its group and of all,
    and its cover is picked by what they found; the values are exploded in the JVM. Without known tables nothing is shuffled."""
    if {pos, value} & set(keys) or len(set(keys)) < len(keys) or any(c.startswith("_v_") for c in df.columns):
        raise ValueError("the names of keys, position and value must differ and not begin with _v_")
    kind = df.schema[group].dataType if group else T.StringType()
    grouped = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = df.where(F.col(column).isNotNull()).select(*keys, grouped.alias("_v_group"), F.col(column).cast("string").alias("_v_text"))
    read = read_fields(rows, known, group, kind)
    return read.select(*keys, F.posexplode("_v_values").alias(pos, value)).withColumn(pos, (F.col(pos) + 1).cast("int"))
