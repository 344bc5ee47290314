"""Sentence units of texts in many languages and scripts.

Layout comes first: blank lines part blocks; heading lines, list items (in list position: at the start of a
block or after another such line) and log lines are units of their own; the other lines of a block are one
paragraph, whose line breaks are blanks. Within a paragraph each cluster of end marks is judged once:

* inside a quotation or bracket that closes again in the paragraph nothing ends;
* ``! ? 。 । ؟`` and their like end the sentence, with the closing quotes and brackets that follow;
* dots (``...``, ``…``) end it only if the next word opens a sentence;
* a single period is classified by statistics that are learned from the corpus itself, per language:

  - *abbreviations*: log-likelihood ratio of the word's having a period nearly always against the general rate,
    weighted by its length, its inner periods and its occurrences without period;
  - the ratio of its standing with a period at the *end of paragraphs*, where a sentence is over for certain:
    an abbreviation that never does so ends nothing but before a starter; one that does, or any other word, ends the sentence unless
    a number or small letter follows and the ratio says that the word is wont to be followed so;
  - *collocations*, word with period and next word: of numbers (ordinals, dates) and of abbreviations, where the next
    word follows this one more often than it starts paragraphs and follows words with period in general;
  - *sentence starters*: words whose rate at certain starts (of paragraphs, after ``!`` and ``?``) is beyond
    their general rate; of words written with a capital, those whose share of such starts is beyond half the usual.
    They tell whether a sentence is over where case says nothing.

Each is decided by a log-likelihood ratio. A period is judged by its document's language unless the frequent words of
the paragraph, or those of the sentences that it parts, speak for another; a word with too little evidence in that
language by the figures of all languages together.
Without a blank after it, a period ends a sentence only between a small letter or digit and a capital. In Thai
a blank after a Thai letter (or a number set to it) and before a Thai letter ends the sentence.

Statistics are counted in one pass over whole texts: each task adds up its words as written and the pairs of words
that a period parts, the sums are shuffled by word and written to the shared folder, ratios are computed in the JVM, and only the words that pass them (``max_words`` at most, counted first)
are broadcast for the second pass, which cuts the texts where they are read.

Defined results: null, empty and blank texts have no unit; a byte-order mark before the text belongs to none;
positions count code points; an unclosed quote or bracket is ignored; a paragraph without end marks is one unit;
repeated texts are each cut; very long texts are cut whole; a null language is a language of its own; columns
besides key, text and language are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage, unstage

PERIOD, FULL = ".．", "!?！？。｡؟۔।॥‼⁇⁈⁉።။។"
MARKS = re.compile(f"[{re.escape(PERIOD + FULL)}…⋯]+")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "‹": "›", "„": "“”", "“": "”", "‚": "‘’", "‘": "’", '"': '"', "'": "'"}
CLOSING = frozenset("".join(PAIRS.values()))
BRACKETS = frozenset("([{（［｛【《〈")
QUOTE = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSING)) + "]")
TRIM = "([{\"'“”„«»‘’‚‹›（）［］｛｝【】《》〈〉「」『』¿¡*_)]},;:!?…"
WORD = re.compile(r"\S+")
DIGITS = re.compile(r"\d+")
NUMBER = "##number##"
LONG = 60  # words of more characters, as whole runs of scripts without blanks, are known by a digest
NUMERIC = re.compile(r"[-+±~≈]?\d[\d.,:/]*%?")
LINE = re.compile("([^\n\r\x0b\x0c\x85  ]*)(\r\n|[\n\r\x0b\x0c\x85  ]|$)")
HEADING, BRACKET, TIME = re.compile(r"#+(?:\s|$)"), re.compile(r"\[([^\]]*)\]"), re.compile(r"\d:\d\d")
ITEM = re.compile(r"(?:[-*+•◦‣▪·]|\(?\d{1,4}[.)]|\(?[a-z]\))\s+\S")
THAI = re.compile(r"(?<=[ก-๛])(\d*)(\s+)(?=[ก-๛])")


def _log(line: str) -> bool:
    """Whether a line begins with a bracketed time."""
    held = BRACKET.match(line)
    return bool(held and TIME.search(held.group(1)))


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a unit of its own) of each heading, list item, log line and paragraph."""
    start = end = -1
    listing = first = True
    at = 1 if text.startswith("\ufeff") else 0
    while at < len(text):
        m = LINE.match(text, at)
        line = m.group(1)
        inner = line.strip()
        a = at + len(line) - len(line.lstrip())
        at, b = m.end(), a + len(inner)
        alone = bool(inner) and (HEADING.match(inner) or _log(inner) or ((first or listing) and ITEM.match(inner)))
        if not inner or alone:
            if start >= 0:
                yield start, end, False
            start = -1
        if alone:
            yield a, b, True
        elif inner:
            start, end = a if start < 0 else start, b
        first, listing = not inner, bool(alone)
    if start >= 0:
        yield start, end, False


def spans(text: str) -> list[tuple[int, int]]:
    """The outermost quotations and brackets that close, as (place of the opening, place after the closing)."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    for m in QUOTE.finditer(text):
        c, at = m.group(), m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if c in "'’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        if c in CLOSING:
            at_stack = next((i for i in range(len(stack) - 1, -1, -1) if c in stack[i][1]), -1)
            if at_stack >= 0 and not (c in "'’" and before.isspace()):
                found.append((stack[at_stack][0], at + 1))
                del stack[at_stack:]
                continue
        if c in PAIRS and not (c == "'" and (before.isalnum() or not after or after.isspace())):
            stack.append((at, PAIRS[c]))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


@lru_cache(maxsize=300_000)
def shape(word: str) -> str:
    """A word as the statistics count it: without quotes and commas, in small letters, digits alike."""
    word = word.strip(TRIM)
    if NUMERIC.fullmatch(word):
        return NUMBER
    word = DIGITS.sub("0", word.lower())
    return word if len(word) <= LONG else "##" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


@lru_cache(maxsize=300_000)
def opening(word: str) -> str:
    """The shape of a word that may open a sentence, with or without a period of its own."""
    return shape(word.rstrip("."))


@lru_cache(maxsize=300_000)
def kind_of(word: str) -> str:
    """n number, l small letter, u capital, o other: of the first letter or digit."""
    for c in word:
        if c.isalnum():
            return "n" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"
    return "o"


class Mark(NamedTuple):
    """A cluster of end marks outside quotations, or the end of a quotation that ends with one."""

    end: int  # where the sentence would end
    sort: str  # full, dots, period, joined, quote, bracket
    word: str  # shape of the word before, without its period
    following: str  # the next word as written; empty at the end of the paragraph
    blank: bool  # whether a blank parts them
    opened: int  # where the quotation or bracket begins


def marks(text: str) -> Iterator[Mark]:
    """The places of a paragraph that may end a sentence, in order."""
    m = MARKS.search(text)
    if not m:
        return
    held = spans(text)
    starts = {a for a, _ in held}
    at, i, n = 0, 0, len(text)
    while m:
        begin = m.start()
        while i < len(held) and held[i][1] <= begin:
            i += 1
        if i < len(held) and held[i][0] < begin:  # within a quotation or bracket
            opened, end = held[i]
            body = end - 1
            while body > opened and (text[body] in CLOSING or text[body].isspace()):
                body -= 1
            if text[body] not in PERIOD + FULL + "…⋯":
                m = MARKS.search(text, end)
                continue
            sort = "bracket" if text[opened] in BRACKETS else "quote"
        else:
            opened, end, cluster = -1, m.end(), m.group()
            sort = "period" if len(cluster) == 1 and cluster in PERIOD else "full" if any(c in FULL for c in cluster) else "dots"
        at = end
        while end < n and (text[end] in CLOSING or text[end] in "*_") and end not in starts:
            end += 1
        at = max(at, end)
        m = MARKS.search(text, at)
        if m and m.start() == end:
            continue  # judged with the marks that follow
        b = end
        while b < n and text[b].isspace():
            b += 1
        # without a blank only whether anything follows counts
        following = WORD.match(text, b).group() if n > b > end else text[b : b + 1]
        word = ""
        if sort == "period":
            joined = b == end and following
            if joined and not (following.isupper() and begin > 0 and (text[begin - 1].islower() or text[begin - 1].isdigit())):
                continue  # within a number, name or abbreviation
            piece = text[text.rfind(" ", 0, begin) + 1 : begin]
            if piece and piece[-1] not in CLOSING and not piece[-1].isspace():
                word = shape(piece.split()[-1])
            if joined:
                if len(word.rpartition(".")[2]) < 2:
                    continue
                sort = "joined"
        yield Mark(end, sort, word, following, b > end, opened)


class Model(NamedTuple):
    """What was learned: language ('*': all) -> words."""

    flags: dict[str, dict[str, str]]  # x never final, n number may follow, l small letter may follow, - plain with evidence
    ordinals: dict[str, set[str]]
    starters: dict[str, set[str]]  # written small, or in a script without case
    capitals: dict[str, set[str]]  # starters written with a capital
    frequent: dict[str, dict[str, float]]  # word -> language -> weight
    pairs: dict[str, set[tuple[str, str]]] = {}  # noqa: RUF012  abbreviations with the words that belong to them


def _flags(model: Model, lang: str, word: str) -> str:
    own = model.flags.get(lang, {}).get(word, "")
    return own if "-" in own else model.flags.get("*", {}).get(word, "")


def ends(mark: Mark, begun: int, lang: str, model: Model) -> bool:
    """Whether the sentence that begins at ``begun`` ends here."""
    if not mark.following:
        return True
    kind, first = kind_of(mark.following), opening(mark.following)
    if mark.sort == "full":
        return True
    known = model.capitals if kind == "u" else model.starters
    starter = (first in known.get(lang, ()) or first in known.get("*", ())) and not set("xnl") & set(_flags(model, lang, first))
    if mark.sort in ("quote", "bracket"):
        if mark.sort == "bracket" and mark.opened == begun:
            return True
        return mark.blank and (kind in "un" or starter)
    if mark.sort == "dots":
        return mark.blank and (kind == "u" or starter)
    flags = _flags(model, lang, mark.word)
    if mark.sort == "joined":
        return "x" not in flags
    if mark.word == NUMBER:
        return starter or not (first in model.ordinals.get(lang, ()) or first in model.ordinals.get("*", ()))
    if starter:
        return True
    if (mark.word, first) in model.pairs.get(lang, ()):
        return False
    return not ("x" in flags or kind == "n" and "n" in flags or kind == "l" and "l" in flags)


class Votes:
    """What the frequent words of a paragraph say of its language, and of the language of its parts."""

    def __init__(self, par: str, lang: str, model: Model) -> None:
        self.par, self.get = par, model.frequent.get
        votes: dict[str, float] = {}
        for word in par.lower().split():
            if word in model.frequent:
                for code, weight in model.frequent[word].items():
                    votes[code] = votes.get(code, 0.0) + weight
        self.own = self._best(votes, lang)
        self.codes, self.at, self.sums = set(votes), None, {}

    @staticmethod
    def _best(votes: dict[str, float], lang: str) -> str:
        """``lang``, unless the votes speak clearly for another."""
        if not votes:
            return lang
        best = max(votes, key=lambda x: (votes[x], x))
        return best if votes[best] > 2 * votes.get(lang, 0.0) else lang

    def near(self, start: int, end: int) -> str:
        """The language of a part."""
        if self.codes <= {self.own}:
            return self.own
        if self.at is None:  # the places of the frequent words, with the sums up to each
            found = [(m.start(), w) for m in WORD.finditer(self.par) if (w := self.get(m.group().lower()))]
            self.at = [a for a, _ in found]
            self.sums = {c: list(accumulate((w.get(c, 0.0) for _, w in found), initial=0.0)) for c in self.codes}
        a, b = bisect_left(self.at, start), bisect_left(self.at, end)
        return self._best({c: v[b] - v[a] for c, v in self.sums.items()}, self.own) if a < b else self.own


def singular(model: Model) -> frozenset[str]:
    """The words after which, or numbers before which, languages may judge a period differently: for all others the
    language need not be found."""
    return frozenset(w for flags in model.flags.values() for w, f in flags.items() if f.strip("-")) | frozenset(w for words in (*model.ordinals.values(), *({a for a, _ in p} for p in model.pairs.values())) for w in words)


def units(text: str | None, lang: str, model: Model, special: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text. ``special``: :func:`singular` of the model, if it is at hand."""
    out: list[tuple[int, int]] = []
    special = singular(model) if special is None else special
    for start, end, alone in blocks(text or ""):
        if alone:
            out.append((start, end))
            continue
        par = text[start:end]
        votes, cuts, begun = None, [], 0
        thai = [m.end(1) for m in THAI.finditer(par)] if not par.isascii() else []
        held = spans(par) if thai else []
        cuts += [c for c in thai if not any(a < c < b for a, b in held)]
        found = list(marks(par))
        for i, mark in enumerate(found):
            over = mark.sort == "full" or not mark.following or mark.sort == "period" and (opening(mark.following) if mark.word == NUMBER else mark.word) not in special
            if not over:
                votes = votes or Votes(par, lang, model)
                # a period is judged by what it parts: from the sentence's begin to the next mark
                near = votes.near(begun, found[i + 1].end if i + 1 < len(found) else len(par)) if mark.sort == "period" else votes.own
                over = ends(mark, begun, near, model)
            if over:
                cuts.append(mark.end)
                begun = mark.end
                while begun < len(par) and par[begun].isspace():
                    begun += 1
        last = 0
        for cut in sorted({*cuts, len(par)}):
            piece = par[last:cut]
            a = last + len(piece) - len(piece.lstrip())
            if a < cut:
                out.append((start + a, start + a + len(piece.strip())))
            last = cut
    return out


def language(col: Column | str) -> Column:
    """The language proper of a tag such as ``de``, ``DE`` or ``de-x``."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(col) if isinstance(col, str) else col), "^[a-z]+", 0), F.lit("?"))


FIGURES = ("bare", "dotted", "final", "number", "small", "begins", "begins_small", "begins_capital", "capital", "after_number", "after_word")


class Counts:
    """The words of one language as written, and the pairs of words that a period parts."""

    def __init__(self) -> None:
        self.words: Counter[str] = Counter()
        self.openings: Counter[str] = Counter()  # of paragraphs, and after marks that end a sentence for certain
        self.pairs: Counter[tuple[str, str]] = Counter()  # word before the period, and the next as written; empty at the end of a paragraph

    def add(self, text: str) -> None:
        for start, end, alone in blocks(text):
            if alone:
                continue
            par = text[start:end]
            words = par.split()
            self.words.update(words)
            self.openings[words[0]] += 1
            for mark in marks(par):
                if mark.sort == "full" and mark.following and mark.blank:
                    self.openings[mark.following] += 1
                elif mark.sort == "period" and mark.word:
                    self.pairs[mark.word, mark.following] += 1

    def __len__(self) -> int:
        return len(self.words) + len(self.openings) + len(self.pairs)

    def figures(self) -> Iterator[tuple[str, str | None, list[int]]]:
        """(word, None, its figures), and (word, next word, [number of the pair])."""
        rows: defaultdict[str, list[int]] = defaultdict(lambda: [0] * len(FIGURES))
        bare, dotted, final, number, small, begins, begins_small, begins_capital, capital, after_number, after_word = range(len(FIGURES))
        for w, n in self.words.items():
            if not w.endswith("."):
                rows[shape(w)][bare] += n
            if kind_of(w) == "u":
                rows[opening(w)][capital] += n
        for w, n in self.openings.items():
            row = rows[opening(w)]
            row[begins] += n
            # for those not written with a capital, case does not tell that they begin a sentence
            row[begins_small if kind_of(w) in "lo" else begins_capital] += n
        both: Counter[tuple[str, str]] = Counter()
        for (w, following), n in self.pairs.items():
            row = rows[w]
            row[dotted] += n
            if not following:
                row[final] += n
                continue
            kind, first = kind_of(following), opening(following)
            if kind in "nl":
                row[number if kind == "n" else small] += n
            rows[first][after_number if w == NUMBER else after_word] += n
            both[w, first] += n
        yield from ((w, None, row) for w, row in rows.items())
        yield from ((w, first, [n]) for (w, first), n in both.items() if w != NUMBER)


def word_figures(docs: DataFrame, text: str, lang: str, flush: int = 500_000) -> DataFrame:
    """(lang, word, next, figures) summed over all documents: of words (``next`` is null), and the number of each pair of
    words that a period parts (as the first of the figures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: defaultdict[str, Counts] = defaultdict(Counts)
        read = 0

        def batch() -> pa.RecordBatch:
            rows = [(code, w, n, f) for code, counts in sums.items() for w, n, f in counts.figures()]
            sums.clear()
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            numbers = [pa.array([r[3][i] if i < len(r[3]) else 0 for r in rows], pa.int64()) for i in range(len(FIGURES))]
            return pa.RecordBatch.from_arrays([*columns, *numbers], names=["lang", "word", "next", *FIGURES])

        for b in batches:
            for code, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[code].add(t)
                read += len(t)
                if read > 4 * flush:  # characters: no text gives more new words than that
                    read = 0
                    if sum(map(len, sums.values())) > flush:
                        yield batch()
        if sums:
            yield batch()

    schema = "lang string, word string, next string, " + ", ".join(f"{f} bigint" for f in FIGURES)
    counted = docs.where(F.col(text).isNotNull()).select(language(lang), F.col(text)).mapInArrow(run, schema)
    return counted.groupBy("lang", "word", "next").agg(*(F.sum(f).alias(f) for f in FIGURES))


def _ratio(k: Column, n: Column, rate: Column) -> Column:
    """Log-likelihood ratio of k in n against a general rate."""
    p = F.least(F.greatest(k / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    rate = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    return 2 * (k * F.log(p / rate) + (n - k) * F.log((1 - p) / (1 - rate)))


def _frequent(own: DataFrame, share: float = 0.001) -> dict[str, dict[str, float]]:
    """The frequent words of each language, weighted by how far a word is one language's own. Words that are a thousandth
    of a language's and languages that are a thousandth of the corpus: there are at most a thousand of each."""
    sizes = own.where("lang <> '?'").groupBy("lang").agg(F.sum("bare").alias("all")).where("all > 0")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    sizes = sizes.where(F.col("all") >= share * total)
    top = own.where("bare > 0 and word rlike '^[\\\\p{L}]+$'").join(F.broadcast(sizes), "lang").where(F.col("bare") >= share * F.col("all"))
    rates: dict[str, dict[str, float]] = {}
    for r in top.select("lang", "word", (F.col("bare") / F.col("all")).alias("rate")).orderBy("word", "lang").collect():
        rates.setdefault(r["word"], {})[r["lang"]] = r["rate"]
    return {w: {code: rate / sum(by.values()) for code, rate in by.items() if rate > sum(by.values()) / 2} for w, by in rates.items()}


def learn(docs: DataFrame, text: str, lang: str, evidence: int = 20, max_words: int = 2_000_000) -> Model:
    """The statistics of a corpus. ``evidence``: occurrences with period from which a language judges by itself."""
    counted = stage(word_figures(docs, text, lang), "words")
    own, pairs = counted.where("next is null").drop("next"), counted.where("next is not null").select("lang", "word", "next", F.col(FIGURES[0]).alias("n"))
    figures = own.unionByName(own.groupBy("word").agg(*(F.sum(f).alias(f) for f in FIGURES)).withColumn("lang", F.lit("*")))
    totals = figures.groupBy("lang").agg(*(F.sum(f).cast("double").alias(f"all_{f}") for f in FIGURES))
    c = F.col
    every, dotted = c("bare") + c("dotted"), F.greatest(c("dotted"), F.lit(1))
    rate = F.greatest(c("all_dotted") / (c("all_bare") + c("all_dotted")), F.lit(1e-6))
    final_rate = c("all_final") / F.greatest(c("all_dotted"), F.lit(1.0))
    capital_rate = c("all_begins_capital") / F.greatest(c("all_capital"), F.lit(1.0))
    begin_rate = c("all_begins") / F.greatest(c("all_bare") + c("all_dotted"), F.lit(1.0))
    times, among = F.greatest(every, F.lit(1)), F.greatest(c("all_after_number"), F.lit(1.0))
    start_share = (c("begins") + c("after_word") + 0.5) / F.greatest(c("all_begins") + c("all_after_word"), F.lit(1.0))
    usual = 2 * (c("dotted") * F.log(F.lit(0.99) / rate) + c("bare") * F.log(F.lit(0.01) / (1 - rate)))
    by_figure = lambda figure: c(f"all_{figure}") / F.greatest(c("all_dotted"), F.lit(1.0))
    # the ratios are written before they are compared: as one expression they outgrow generated code
    ratios = figures.join(F.broadcast(totals), "lang").select(  # a row a language
        "lang", "word", "bare", "dotted", "final", "number", "small", "begins_small", "begins_capital", "capital", "after_number",
        usual.alias("usual"), rate.alias("rate"), final_rate.alias("final_rate"), begin_rate.alias("begin_rate"), capital_rate.alias("capital_rate"), start_share.alias("start_share"), (c("begins") + c("after_word") + 0.5).alias("starts"), (c("all_begins") + c("all_after_word")).alias("all_starts"), among.alias("among"),
        _ratio(c("final"), dotted, final_rate).alias("final_llr"),
        by_figure("number").alias("number_rate"), by_figure("small").alias("small_rate"),
        _ratio(c("number"), dotted, by_figure("number")).alias("number_llr"), _ratio(c("small"), dotted, by_figure("small")).alias("small_llr"),
        _ratio(F.least(c("begins_small"), times), times, begin_rate).alias("starter_llr"),
        _ratio(F.least(c("begins_capital"), c("capital")), F.greatest(c("capital"), F.lit(1)), capital_rate / 2).alias("capital_llr"),
        _ratio(c("after_number").cast("double"), among, start_share).alias("ordinal_llr"),
    )
    ratios = stage(ratios, "ratios")
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("word") - letters + 1
    score = c("usual") * F.exp(-letters) * inner / F.power(F.greatest(letters, F.lit(1.0)), F.least(c("bare"), F.lit(200)))
    seldom_final = (c("final") / dotted < c("final_rate") / 5) & (c("final_llr") >= 3.84)
    mostly = (c("dotted") >= 4 * c("bare")) & (2 * c("number") > c("dotted")) & seldom_final & (c("final_llr") >= 7.88)
    abbreviation = (letters > 0) & (c("word") != NUMBER) & (((score >= 0.3) & (c("usual") > 0)) | mostly)
    # a word's tendency to be followed by numbers or small letters, against all words with period
    wont = lambda figure: (c(figure) / dotted > 2 * c(f"{figure}_rate")) & (c(f"{figure}_llr") >= 7.88)
    starter = (c("begins_small") >= 2) & (c("begins_small") / times > c("begin_rate")) & (c("starter_llr") >= 7.88)
    capital = (c("begins_capital") >= 5) & (c("begins_capital") / F.greatest(c("capital"), F.lit(1)) > c("capital_rate") / 2) & (c("capital_llr") >= 7.88)
    ordinal = (c("after_number") >= F.when(c("lang") == "*", 2).otherwise(evidence)) & (c("after_number") / c("among") > 5 * c("start_share")) & (c("ordinal_llr") >= 7.88)
    judged = ratios.select("lang", "word", "dotted", "final", abbreviation.alias("abbreviation"), seldom_final.alias("seldom"), wont("number").alias("n"), wont("small").alias("l"), starter.alias("starter"), ordinal.alias("ordinal"), capital.alias("capital"))
    judged = stage(judged, "judged")
    a, none = c("abbreviation"), F.lit("")
    cased = F.lower("word") != F.upper("word")  # small letters say nothing after words of a script without case
    flags = F.concat(F.when(a & c("seldom"), "x").otherwise(none), F.when(a & c("n"), "n").otherwise(none), F.when(a & cased & c("l"), "l").otherwise(none), F.when(c("dotted") >= evidence, "-").otherwise(none))
    told = judged.select("lang", "word", flags.alias("flags"), (c("starter") & ~a).alias("starter"), "ordinal", (c("capital") & ~a).alias("capital")).where("flags rlike '[xnl]' or starter or ordinal or capital or (flags = '-' and lang <> '*')")
    # plain words need no entry unless all languages together say otherwise
    odd = told.where("lang = '*' and flags rlike '[xnl]'").select("word").distinct()
    told = told.where("flags rlike '[xnl]' or starter or ordinal or capital").unionByName(told.where("flags = '-' and not starter and not ordinal and not capital").join(odd, "word", "left_semi").select(told.columns))
    got = told.limit(max_words + 1).toArrow()
    # collocations of abbreviations that may end sentences too: against the next word's share of all starts, within one
    # language only (in all together, the words of one language follow each other more than those of others)
    open_ = judged.where("abbreviation and not seldom").select("lang", "word", (c("dotted") - c("final")).alias("times"))
    beside = pairs.where(c("n") >= evidence).join(open_, ["lang", "word"]).join(ratios.select("lang", F.col("word").alias("next"), "starts", "all_starts"), ["lang", "next"])
    elsewhere = (c("starts") - c("n")) / F.greatest(c("all_starts") - c("n"), F.lit(1.0))
    held = beside.where((c("n") / c("times") > 5 * elsewhere) & (_ratio(c("n").cast("double"), c("times").cast("double"), elsewhere) >= 7.88))
    together = held.select("lang", "word", "next").limit(max_words + 1).toArrow()
    frequent = _frequent(own)
    for made in (counted, ratios, judged):
        unstage(made)
    if max(got.num_rows, together.num_rows) > max_words:
        raise ValueError(f"more than {max_words} words to broadcast; raise max_words if the executors' memory allows")
    model = Model({}, {}, {}, {}, frequent, {})
    for code, word, flag, begins, ordinal_, capital_ in zip(*(got.column(i).to_pylist() for i in range(6)), strict=True):
        if flag:
            model.flags.setdefault(code, {})[word] = flag
        if begins:
            model.starters.setdefault(code, set()).add(word)
        if capital_:
            model.capitals.setdefault(code, set()).add(word)
        if ordinal_:
            model.ordinals.setdefault(code, set()).add(word)
    for code, word, following in zip(*(together.column(i).to_pylist() for i in range(3)), strict=True):
        model.pairs.setdefault(code, set()).add((word, following))
    return model


def sentence_units(docs: DataFrame, key: str, text: str, lang: str, model: Model | None = None) -> DataFrame:
    """One row per unit: ``key``, sent_start, sent_end."""
    if key in ("sent_start", "sent_end"):
        raise ValueError("the key must not be named like a position")
    model = model or learn(docs, text, lang)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, _units array<struct<sent_start:int,sent_end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        special = singular(known)
        for b in batches:
            flat: list[tuple[int, int]] = []
            offsets = [0]
            for code, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                flat += units(t, code, known, special)
                offsets.append(len(flat))
            places = np.array(flat, np.int32).reshape(-1, 2)
            made = pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], names=["sent_start", "sent_end"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)], names=[key, "_units"])

    rows = docs.where(F.col(text).isNotNull()).select(key, language(lang), F.col(text)).mapInArrow(run, schema)
    return rows.select(key, F.explode("_units").alias("_u")).select(key, "_u.sent_start", "_u.sent_end")
