import random
import resource
import time

import numpy as np

from gridloom.llm.eval_leaks import Items, Search, Suffixes, leaks, matches, runs, without_leaks, words


def test_words_are_comparable():
    assert words("Ｔｅｓｔ caﬁ́ x_y ½ ZA­B") == ["test", "cafi", "x", "y", "1", "2", "zab"]
    assert words("Straße İ") == ["strasse", "i"]
    assert words(None) == words("") == words(" .,;") == []


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")


def brute(docs, items, least):
    out = set()
    for d, t, _ in docs:
        w = words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        out |= {(d, i) for i, x in items for k in range(len(words(x)) - least + 1) if tuple(words(x)[k : k + least]) in grams}
    return out


def test_like_brute_force(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(i, text(rnd.randrange(0, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "one two")]
    docs = [(i, text(rnd.randrange(0, 80)), "") for i in range(60)] + [(100, None, ""), (101, "", "")]
    docs += [(200 + i, text(5) + " " + items[i][1].upper().replace(" ", " , ") + " " + text(5), "") for i in range(20)] + [docs[0]]
    for least in (5, 12):
        assert {(r.doc_id, r.item_id) for r in leaks(*frames(spark, docs, items), least).collect()} == brute(docs, items, least)
    one = {(r.doc_id, r.item_id) for r in matches(*frames(spark, docs, items), 5, block_bytes=100).collect()}
    assert one == brute(docs, items, 5)  # several blocks


def test_places_and_lengths(spark):
    item = "p q r s t u v w x y z one two"
    f = frames(spark, [(1, "lead in, " + item + " end. " + item, "")], [(7, item)])
    assert sorted((r.doc_word, r.item_word, r.n_words) for r in matches(*f).collect()) == [(2, 0, 13), (16, 0, 13)]
    assert leaks(*f).count() == 1
    docs = f[0].unionByName(spark.createDataFrame([(2, "clean", ""), (None, "clean", "")], "doc_id long, text string, item_id string"))
    assert sorted(r.text for r in without_leaks(docs, "doc_id", leaks(*f)).collect()) == ["clean", "clean"]


def test_long_document_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(40))
    f = frames(spark, [(1, "x " * 300_000 + item, "")], [(7, item)])
    assert leaks(*f).count() == 1
    assert leaks(*frames(spark, [], [(7, item)])).count() == 0
    assert leaks(*frames(spark, [(1, item, "")], [])).count() == 0


def test_suffixes_are_in_full_order():
    rnd = random.Random(3)
    for _ in range(40):
        codes = np.array([rnd.choice((0, 1, 1, 2, 2, 2)) for _ in range(rnd.randrange(1, 60))] + [0])
        s = Suffixes(codes)
        text = codes.tolist()
        suffix = lambda i: text[i : i + text[i:].index(0)]  # noqa: E731, B023
        want = sorted(range(len(text)), key=suffix)
        assert [suffix(i) for i in np.argsort(s.rank, kind="stable").tolist()] == [suffix(i) for i in want]
        a, b = np.array([rnd.randrange(len(text)) for _ in range(30)]), np.array([rnd.randrange(len(text)) for _ in range(30)])
        same = [next((k for k, (x, y) in enumerate(zip(suffix(i), suffix(j), strict=False)) if x != y), min(len(suffix(i)), len(suffix(j)))) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert s.common(a, b).tolist() == same
        found = runs(codes, 3)
        assert all(x == 0 if at < 0 else text[at] == x for x, at in zip(found.codes.tolist(), found.source.tolist(), strict=True))


def test_longest_match_of_every_suffix():
    rnd = random.Random(4)
    for _ in range(30):
        text = lambda n: [rnd.choice("abc") for _ in range(n)]  # noqa: E731, B023
        items = Items([(i, text(rnd.randrange(0, 20))) for i in range(4)], 3)
        shard = np.array([items.code.get(w, 0) for w in [*text(50), "?", *text(20)]] + [0])
        found = Search(items, shard)
        flat, body = items.codes.tolist(), shard.tolist()
        match = lambda i, j: next(k for k in range(len(flat)) if flat[i + k] != body[j + k] or not flat[i + k])  # noqa: E731, B023
        longest = {i: max(match(i, j) for j in range(len(body) - 1)) for i in range(len(flat)) if flat[i]}
        assert dict(zip(found.queries.tolist(), found.longest.tolist(), strict=True)) == {i: n for i, n in longest.items() if n >= 3}
        want = {(j, i, n) for i in range(len(flat)) for j in range(len(body)) if flat[i] and (n := match(i, j)) >= 3 and not (i and j and flat[i - 1] == body[j - 1] > 0)}
        assert {t for part in found.matches(7) for t in zip(*(x.tolist() for x in part), strict=True)} == want


def test_repeated_text_is_linear():
    items = Items([(1, ["a"] * 300), (2, ["a"] * 13)], 12)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = Search(items, np.r_[np.ones(1_000_000, np.int64), 0])
    assert [x.tolist() for x in found.pairs(np.zeros(1_000_001, np.int64))] == [[0, 0], [0, 1]]
    assert found.longest.max() == 300 and time.time() - began < 120
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB
