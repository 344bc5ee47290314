"""Every field, well written or not, meets the automata of the known values, however these are cut up."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from gridloom.operators import packed_values
from gridloom.operators.packed_values import automaton, candidates, known_segments, quoted_values, read_fields, segment, split_packed

ROWS = [(1, "x", "5;6"), (2, "x", "'dma; 1' 9"), (3, "y", "5';6;'7'"), (4, None, "5';6;'7'"), (5, "y", "5;5"), (6, "x", ""), (7, "z", "'it''s';q"), (8, "y", "5';6;'7'"), (9, "x", "it's 'dma; 1'")]
OWN = [("x", "5"), ("x", "6"), ("y", "6"), ("y", "5"), ("y", "6"), (None, "6"), ("x", None), ("z", ""), ("w", "q"), ("x", "1"), ("x", "77")]


def frames(spark):
    return spark.createDataFrame(ROWS, "row_id int, design string, packed string"), spark.createDataFrame(OWN, "design string, value string")


def test_well_written_fields_read_what_is_known(spark, tmp_path):
    df, own = frames(spark)
    own.write.parquet(str(tmp_path / "own"))
    stored = spark.read.parquet(str(tmp_path / "own"))
    got = split_packed(df.where("row_id in (1, 2)"), "packed", ["row_id"], [stored], "design")
    assert set(stored.inputFiles()) <= set(got.inputFiles())
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "5"), (1, 2, "6"), (2, 1, "dma; 1"), (2, 2, "9")]


def test_the_cover_yields_the_values_of_every_field(monkeypatch):
    asked = []
    real = packed_values._cover
    monkeypatch.setattr(packed_values, "_cover", lambda *a: asked.append(a[:2]) or real(*a))
    assert segment("5;6", automaton(["6", "5;6"])) == ["5", "6"] and segment("7 'a'") == ["7", "a"]
    assert asked == [("5;6", {(2, 3)}), ("7 'a'", set())]


@pytest.mark.parametrize(("shard", "share", "buckets"), [(100_000, 50_000, 4096), (1, 1, 1), (2, 1, 4096), (1, 50_000, 3)])
def test_hits_and_values_however_the_known_are_cut_up(spark, monkeypatch, shard, share, buckets):
    for name, n in (("SHARD", shard), ("SHARE", share), ("BUCKETS", buckets)):
        monkeypatch.setattr(packed_values, name, n)
    df, own = frames(spark)
    known = [own, quoted_values(df, "packed", [])]
    everywhere = {"dma; 1", "it's"}  # quoted in fields whose quotes all have partners
    rows = df.selectExpr("row_id", "design as _v_group", "packed as _v_text")
    met = {r.row_id: {(a, b) for a, b in zip(r["_v_hits"][::2], r["_v_hits"][1::2])} for r in read_fields(rows, known, "design", T.StringType(), covers=False).collect()}
    out = split_packed(df, "packed", ["row_id", "design"], known, "design").collect()
    for i, design, text in ROWS:
        hits = automaton({v for d, v in OWN if d == design and v} | everywhere)
        flat = known_segments(text, hits)
        assert met.get(i, set()) == set(zip(flat[::2], flat[1::2]))
        assert [(r.design, r.value) for r in sorted((r for r in out if r.row_id == i), key=lambda r: r.pos)] == [(design, v) for v in segment(text, hits)]
    assert met[1] == {(0, 1), (2, 3)} and met[2] == {(0, 8), (6, 7)}
    assert [r.value for r in sorted((r for r in out if r.row_id == 4), key=lambda r: r.pos)] == ["5", "6", "7"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1;, '\"é", max_size=16))
def test_known_segments_are_the_candidates_that_are_known(text):
    known = {"a", "b1", "a;b", "b'a", "1, a", "ab", "1"}
    flat = known_segments(text, automaton(known))
    values = {packed_values._content(text, a, b - 1) if text[a] in "\"'" else text[a:b] for a, b in zip(flat[::2], flat[1::2])}
    assert values == known & set(candidates(text))
