import random

import pytest

from gridloom.llm.sentences import Model, blocks, learn, sentence_units, spans, units

MODEL = Model(
    {"en": {"e.g": "xl-", "cf": "xl-", "no": "n-", "a.m": "xl-", "approx": "xn-", "etc": "-"}, "de": {"z": "x-", "b": "xl-", "nr": "xn-"}, "*": {"u.s": "xl-"}},
    {"de": {"märz", "lauf"}}, {"en": {"grid_weak"}}, {"en": {"the", "peak"}}, {},
)


def cut(text, lang="en"):
    return [text[a:b] for a, b in units(text, lang, MODEL)]


CASES = [
    ("en", "One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("en", "See e.g. No. 9! The end.", ["See e.g. No. 9!", "The end."]),
    ("en", "Was it? No. The map is. At 3 a.m. on disk.", ["Was it?", "No.", "The map is.", "At 3 a.m. on disk."]),
    ("en", "It holds. grid_weak rises.", ["It holds.", "grid_weak rises."]),
    ("en", "Wide ... but it holds. Really?!", ["Wide ... but it holds.", "Really?!"]),
    ("en", "They said 'ship it. We will see.' and left. Done.", ["They said 'ship it. We will see.' and left.", "Done."]),
    ("en", 'The log says "drop 0.1 V. Check." and moves on.', ['The log says "drop 0.1 V. Check." and moves on.']),
    ("en", "A note (“too thin. Add.”) was ignored. Next.", ["A note (“too thin. Add.”) was ignored.", "Next."]),
    ("en", "He wrote: “Lower it.” The end.", ["He wrote: “Lower it.”", "The end."]),
    ("en", "In v2.4.0 the U.S. file a.csv.gz was empty.", ["In v2.4.0 the U.S. file a.csv.gz was empty."]),
    ("en", "All endpoints.The mesh moved?No.", ["All endpoints.", "The mesh moved?", "No."]),
    ("en", "wrapped\nline. Next\none.", ["wrapped\nline.", "Next\none."]),
    ("en", "﻿  # Head. One\n- item. Two\n2) more. x\n\n[10:02:03] WARN a! b.\nprose. Here", ["# Head. One", "- item. Two", "2) more. x", "[10:02:03] WARN a! b.", "prose.", "Here"]),
    ("en", "rule No.\n14. The next", ["rule No.\n14.", "The next"]),
    ("en", "no end mark", ["no end mark"]),
    ("en", "an unclosed “quote. And more.", ["an unclosed “quote.", "And more."]),
    ("de", "Am 3. März lief es. Nahe Reihe 229. Die Bahnen.", ["Am 3. März lief es.", "Nahe Reihe 229.", "Die Bahnen."]),
    ("de", "Blöcke, z. B. host. Das „Zu hoch. Bitte.“ läuft.", ["Blöcke, z. B. host.", "Das „Zu hoch. Bitte.“ läuft."]),
    ("fr", "Le « Trop. Voir. » continue. Vue ? Oui !", ["Le « Trop. Voir. » continue.", "Vue ?", "Oui !"]),
    ("zh", "日志写道“过大。请查。”然后继续。（详见附录。）版本2.4.1好……但不足。", ["日志写道“过大。请查。”然后继续。", "（详见附录。）", "版本2.4.1好……但不足。"]),
    ("ja", "「大きい。確認。」と出た。　余裕は……と思う。次？", ["「大きい。確認。」と出た。", "余裕は……と思う。", "次？"]),
    ("hi", 'लिखा है "अधिक है। देखें।" और चला। क्या? हाँ।', ['लिखा है "अधिक है। देखें।" और चला।', "क्या?", "हाँ।"]),
    ("ar", "يقول «كبير. افحص.» ثم يتابع. هل؟ نعم.", ["يقول «كبير. افحص.» ثم يتابع.", "هل؟", "نعم."]),
    ("ko", '로그에는 "큽니다. 확인."라고 적혔다. 끝.', ['로그에는 "큽니다. 확인."라고 적혔다.', "끝."]),
    ("th", "แบบจำลองดี ขอบเหนือในรุ่นที่4 ผลครั้งที่สาม", ["แบบจำลองดี", "ขอบเหนือในรุ่นที่4", "ผลครั้งที่สาม"]),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES)
def test_cases(lang, text, want):
    assert cut(text, lang) == want


@pytest.mark.parametrize("text", [None, "", " \n\t ", "﻿", "  　"])
def test_no_content(text):
    assert units(text, "en", MODEL) == []


def test_units_cover_all_but_blanks():
    for _, text, _ in CASES:
        held = set()
        for a, b in units(text, "en", MODEL):
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            held |= set(range(a, b))
        assert all(c.isspace() or c == "﻿" for i, c in enumerate(text) if i not in held)


def test_spans_and_blocks():
    assert spans("a (b “c” d) ‘e’ it's f'") == [(2, 11), (12, 15)]
    assert [b[2] for b in blocks("x\n1. y\n\n1. a\n2. b")] == [False, True, True]


def test_long_text():
    assert len(units("Word here. " * 50_000, "en", MODEL)) == 50_000
    assert len(units('"' * 100_001, "en", MODEL)) == 1


def corpus(spark):
    rnd, rows = random.Random(7), []
    mixed = lambda *parts: " ".join(rnd.sample(parts, len(parts)))
    for i in range(120):
        rows.append((i, mixed(f"See Fig. {i} for approx. {i} tiles.", f"The map holds at disk {i}.", "Our mesh moved.", f"The mesh, cf. Table {i}, moved at disk {i}.", "Did it fall?"), "EN-x" if i % 3 else "en"))
        rows.append((1000 + i, mixed(f"Am {i % 28 + 1}. März fiel es ab.", "Die Karte stimmt.", f"Das Netz hält ca. {i} aus.", f"Nahe Reihe {i}.", "Die Bahnen sind dünn!"), "de"))
    rows += [(5000, None, "en"), (5001, "", None), (5002, "Siehe Fig. 3 und ca. 4. Die Karte.", None), (5003, "Am 6. März fiel es ab. Die Karte stimmt. Nahe Reihe 5. Die Bahnen.", "de"), (0, rows[0][1], "en")]
    rows += [(5004, "See Fig. 1 for approx. 1 tiles. The map holds at disk 1. Our mesh moved.", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_without_supervision(spark):
    docs = corpus(spark)
    model = learn(docs, "text", "lang")
    assert "x" in model.flags["en"]["approx"] and "x" in model.flags["en"]["fig"] and "x" in model.flags["de"]["ca"]
    assert "märz" in model.ordinals["de"] and "die" not in model.ordinals["de"]
    assert "x" not in model.flags["en"].get("moved", "")
    got = {}
    for r in sentence_units(docs, "doc_id", "text", "lang").collect():
        got.setdefault(r.doc_id, set()).add((r.sent_start, r.sent_end))
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = lambda i: [texts[i][a:b] for a, b in sorted(got.get(i, ()))]
    assert at(5004) == ["See Fig. 1 for approx. 1 tiles.", "The map holds at disk 1.", "Our mesh moved."]
    assert at(5003) == ["Am 6. März fiel es ab.", "Die Karte stimmt.", "Nahe Reihe 5.", "Die Bahnen."]
    assert at(5002) == ["Siehe Fig. 3 und ca. 4.", "Die Karte."]
    assert at(5000) == at(5001) == []


def test_empty_table(spark):
    assert sentence_units(corpus(spark).limit(0), "doc_id", "text", "lang").count() == 0
    with pytest.raises(ValueError):
        sentence_units(corpus(spark).withColumnRenamed("doc_id", "sent_end"), "sent_end", "text", "lang")


def test_collocations_keep_abbreviations_before_capitals():
    open_ = MODEL._replace(flags={"en": {"etc": "l-"}}, pairs={"en": {("etc", "corner")}})
    text = "Rows etc. Corner cells fail. Rows etc. Tiles hold."
    assert [text[a:b] for a, b in units(text, "en", open_)] == ["Rows etc. Corner cells fail.", "Rows etc.", "Tiles hold."]


def test_collocations_are_learned(spark):
    rnd = random.Random(6)
    words = "mesh drop bump cell rail tile grid load peak".split()
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    openers = ["The", "Each", "This", "Some", "All", "Both", "Here", "Many", "Few", "Most"]
    body = [f"{rnd.choice(openers)} {some(12)} vs. Vdd {some(12)} and vs. {some(12)}." for _ in range(300)]
    body += [f"{rnd.choice(openers)} {some(12)} vs.\n\n{rnd.choice(openers)} {some(12)} end." for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(body[i : i + 4]), "en") for i in range(0, 400, 4)], "doc_id long, text string, lang string")
    model = learn(docs, "text", "lang")
    assert ("vs", "vdd") in model.pairs["en"] and not any(first in ("the", "each") for _, first in model.pairs["en"])
    assert {word for word, _ in model.pairs["en"]} == {"vs"}


def test_log_lines_and_languages_know_no_limits():
    stamp = "[" + "node " * 30 + "2024-01-02 10:02:03.123 " + "thread " * 20 + "]"
    text = f"{stamp} a! b. c\nprose. Here"
    assert [text[a:b] for a, b in units(text, "en", MODEL)] == [f"{stamp} a! b. c", "prose.", "Here"]
    model = MODEL._replace(frequent={"und": {"de": 1.0}, "the": {"en": 1.0}})
    text = "The mesh und und und " + "x" * 300 + " z. Rand holds. The end."
    assert [text[a:b] for a, b in units(text, "en", model)] == [text[: text.index(" The end")], "The end."]
