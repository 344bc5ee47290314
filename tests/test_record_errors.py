import itertools

import pytest

from gridloom.operators.record_errors import LAYOUTS, SYMBOL, bad_records, cheapest_edits, loaded_records, parse_record


def strict(record):
    """(quoting fault, number of fields) by a plain scan."""
    i = fields = 0
    while True:
        fields += 1
        if record[i : i + 1] == '"':
            i += 1
            while True:
                j = record.find('"', i)
                if j < 0:
                    return True, 0
                if record[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i == len(record):
                return False, fields
            if record[i] != ",":
                return True, 0
            i += 1
        else:
            j = record.find(",", i)
            if '"' in record[i : len(record) if j < 0 else j]:
                return True, 0
            if j < 0:
                return False, fields
            i = j + 1


def test_edits_tell_the_first_reason_of_every_short_record():
    for n in range(1, 7):
        for letters in itertools.product('a,"', repeat=n):
            record = "".join(letters)
            fault, count = strict(record)
            symbols = SYMBOL.sub(lambda m: {'"': "Q", ",": "C"}.get(m.group(), "T"), record)
            for columns in (3, 4):
                e = cheapest_edits(symbols, columns)
                assert ("quoting" if e.quoting else "column_count" if any(e) else None) == ("quoting" if fault else "column_count" if count != columns else None), record


@pytest.mark.parametrize(
    ("file", "record", "reason", "values"),
    [
        ("strap_planned", '﻿3, 4 ,5.e-1\r\r', None, [3, 4, 0.5]),
        ("strap_planned", "-0,+95,1.", None, [0, 95, 1.0]),
        ("strap_planned", '"1","2",".25"', None, [1, 2, 0.25]),
        ("strap_planned", "1,96,0", "value", []),
        ("strap_planned", "1,2,nan", "value", []),
        ("strap_planned", "1,2,０.５", "value", []),
        ("strap_planned", "1,2", "column_count", []),
        ("strap_planned", '1,2,"0.5"\n', "quoting", []),
        ("strap_planned", '1,2,0"5', "quoting", []),
        ("strap_planned", ' "1",2,0.5', "quoting", []),
        ("strap_planned", None, "column_count", []),
        ("strap_planned", " \t", "column_count", []),
        ("activity", 'idle,"a ""b"", c",.5,1E-1', None, ["idle", 'a "b", c', 0.5, 0.1]),
        ("activity", 'idle," ",.5,.1', "value", []),
        ("bumps", "99999999999999999999,0,1e3", None, [None, 0.0, 1000.0]),
        ("bumps", "-1,0,0", "value", []),
        ("other", "1,2,3", "unknown_file", []),
        (None, "1,2,3", "unknown_file", []),
    ],
)
def test_records(file, record, reason, values):
    got = parse_record(record, LAYOUTS.get(file))
    assert (got[0], got[2]) == (reason, values)


def test_long_record():
    assert parse_record("," * 20_000, LAYOUTS["bumps"])[0] == "column_count"
    assert parse_record('"' + "x" * 1_000_000, LAYOUTS["bumps"])[0] == "quoting"


def test_good_and_bad_are_all_rows(spark):
    rows = [(1, "bumps", "1,2,3"), (1, "bumps", "1,2,3"), (2, "bumps", "1,2"), (3, None, "1"), (4, "strap_planned", '"1",2,0.5'), (5, "activity", None)]
    df = spark.createDataFrame(rows, "line_id long, file_name string, raw_line string").withColumnRenamed("file_name", "f")
    assert sorted((r.line_id, r.reason) for r in bad_records(df, ["line_id"], "raw_line", "f").collect()) == [(2, "column_count"), (3, "unknown_file"), (5, "column_count")]
    good = loaded_records(df, ["line_id"], "raw_line", "f").collect()
    assert sorted((r.line_id, r.bump_id, r.density) for r in good if r.line_id == 1) == [(1, 1, None), (1, 1, None)]
    assert [(r.fy, r.fx, r.density) for r in good if r.line_id == 4] == [(1, 2, 0.5)]
    assert bad_records(df.where("line_id < 0"), ["line_id"], "raw_line", "f").count() == 0
    with pytest.raises(ValueError):
        bad_records(df.withColumnRenamed("line_id", "reason"), ["reason"], "raw_line", "f")
