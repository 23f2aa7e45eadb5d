"""Toxicity: a weighted grammar of composed transducers scores the clauses it matches."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import carried, carried_as, cut, documents, ship, table, with_arrays
from colscope.llm.fitting import fit_sample, remainder

#: Labelled rows to fit on at most, and lexicon entries learned at most.
FIT_ROWS, LEXICON_ROWS = 12_000, 2000
THRESHOLD = 0.7
#: An entry must stand in so many different surroundings in toxic texts, and this share of the texts
#: that hold it must be toxic. Copies of one text are one surrounding, so their words aren't learned.
CONTEXTS, PURITY = 6, 0.9
#: Stems are so many letters long.
STEMS = range(4, 8)

#: Word classes whose words don't depend on the labels: threats, targets, negation, reported speech.
THREATS = "kill hurt destroy murder beat töten umbringen verletzen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she they them him her his their du dich dir ihr euch sie er ihnen tu te toi vous ils elles lui tú ti usted ustedes ellos ellas él ella".split()
NEGATIONS = "not no never nor without isn't aren't don't nicht kein keine keinen nie niemals ohne ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says wrote called quoted according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según".split()

#: Other forms of the threats, by stem and ending; past forms tell of violence and are no threats.
THREAT_FORMS = [
    ("kill destroy murder hurt beat", "s ing"),
    ("töt verletz vernicht", "e est et t en"),
    ("umbring", "e st t en"),
    ("tu frapp", "e es ons ez ent erai eras era erons erez eront"),
    ("détrui", "s t sons sez sent rai ras ra rons rez ront"),
    ("mat golpe", "o as a amos an aré arás ará aremos arán ando"),
    ("destru", "yo yes ye imos yen iré irás irá iremos irán yendo"),
]
#: Spanish verbs end in the one they aim at.
AIMED_FORMS = ("matar golpear destruir matándo golpeándo destruyéndo", "te os lo la le los las les")
#: Targets that are never the one who acts, and those that always are.
OBJECTS = "them him dich dir euch ihn ihm ihnen te toi ti os".split()
SUBJECTS = "he she they du er tu ils tú".split()

INSULT, THREAT, AIMED_THREAT, TARGET, OBJECT, SUBJECT, NEGATION, REPORT, OTHER, BREAK = CLASSES = range(10)
HITS, AIMS = (INSULT, THREAT, AIMED_THREAT), (TARGET, OBJECT, SUBJECT)
#: What is said of a word: three marks that number a hit's place, what kind of hit it is, and whether a
#: threat is aimed at someone.
NEGATED, REPORTED, TARGETED, MENACING, AIMED, ABUSIVE = 1, 2, 4, 8, 16, 32
MARKS = 8
PLACES = 3 * MARKS
#: An entry's weight in log odds is cut here, so no single word decides more than certainty needs.
MOST_WEIGHT = 6.0
#: Where no label says otherwise, an aimed threat alone gets this score.
AIMED_SCORE = 0.9

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words, and the commas and quotes at which quoted speech ends.
_TOKEN = re.compile(WORD.pattern + r"|[,\"'“”‘’«»]")
#: An end mark before a closing quote is the quotation's: who said it may still follow.
_END = re.compile(r"[.!?;](?![\"'”’»])|\n")


class Speller:
    """A transducer over letters: reads a word and gives its class and weight, or none.

    Whole words end in their last state; a stem's last state takes any further letters.
    """

    def __init__(self, symbol: int, words: dict[str, float], stems: dict[str, float] | None = None):
        self.arcs: list[dict[str, int]] = [{}]
        self.words = {self._state(w): (symbol, x) for w, x in words.items()}
        self.stems = {self._state(w): (symbol, x) for w, x in (stems or {}).items()}

    def _state(self, entry: str) -> int:
        state = 0
        for letter in entry:
            to = self.arcs[state].setdefault(letter, len(self.arcs))
            if to == len(self.arcs):
                self.arcs.append({})
            state = to
        return state

    def read(self, word: str) -> tuple[tuple[int, float] | None, tuple[int, float] | None]:
        """What the word is as a whole, and by its longest stem."""
        state, stem = 0, None
        for letter in word:
            to = self.arcs[state].get(letter)
            if to is None:
                return None, stem
            state = to
            stem = self.stems.get(state, stem)
        return self.words.get(state), stem


def forms(stems: str, endings: str) -> list[str]:
    return [stem + ending for stem in stems.split() for ending in endings.split()]


THREAT_WORDS = [*THREATS, *(w for stems, endings in THREAT_FORMS for w in forms(stems, endings))]
AIMED_WORDS = forms(*AIMED_FORMS)
#: The threat machine, and those of the words that mark an insult or a threat.
SPELLERS = [
    Speller(c, dict.fromkeys(words, 1.0))
    for c, words in (
        (THREAT, THREAT_WORDS), (AIMED_THREAT, AIMED_WORDS), (OBJECT, OBJECTS), (SUBJECT, SUBJECTS),
        (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS),
    )
]


@dataclass(frozen=True)
class Machine:
    """A transducer over word classes: in each state a class leads to a state and sets a mark or none."""

    states: int
    step: Callable[[int, int], tuple[int, int]]


def hit(marks: dict[int, int]) -> Machine:
    """Marks words of the classes given, wherever they stand."""
    return Machine(1, lambda state, symbol: (0, marks.get(symbol, 0)))


def scope(triggers: tuple[int, ...], reach: int, mark: int, hits: tuple[int, ...] = HITS) -> Machine:
    """Marks insults and threats up to ``reach`` words behind a word of the classes ``triggers``."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == BREAK:
            return state, 0
        left = reach if symbol in triggers else max(0, state - 1)
        return left, mark if state and symbol in hits else 0

    return Machine(reach + 1, step)


def told(before: int, reach: int, mark: int) -> Machine:
    """Read from the right: marks insults and threats up to ``reach`` words ahead of the comma or quote
    that stands up to ``before`` words ahead of a reporting verb."""

    def step(state: int, symbol: int) -> tuple[int, int]:
        waiting, reached = (state, 0) if state <= before else (0, state - before)
        if symbol == REPORT:
            return before, 0
        if symbol == BREAK:
            return (before + reach if waiting else state), 0
        now = mark if reached and symbol in HITS else 0
        return (waiting - 1 if waiting else before + reached - 1 if reached > 1 else 0), now

    return Machine(before + reach + 1, step)


def compose(machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """The machines run side by side as one: tables of next states and of joint marks, by state and class."""
    seen: dict[tuple[int, ...], int] = {(0,) * len(machines): 0}
    nexts, marks = [], []
    for states in seen_in_order(seen):
        row = [[m.step(s, symbol) for m, s in zip(machines, states, strict=True)] for symbol in CLASSES]
        nexts.append([seen.setdefault(tuple(to for to, _ in r), len(seen)) for r in row])
        marks.append([sum(mark for _, mark in r) for r in row])
    return np.array(nexts), np.array(marks)


def seen_in_order(seen: dict) -> Iterator[tuple[int, ...]]:
    at = 0
    while at < len(seen):
        yield list(seen)[at]
        at += 1


#: Negation reaches 3 words, reported speech 6, a target 4. The insult machine, of learned words, and the
#: threat machine spell words into classes (Speller) and mark them here.
GRAMMAR = [
    hit({INSULT: ABUSIVE}), hit({THREAT: MENACING, AIMED_THREAT: MENACING | AIMED | TARGETED}),
    scope((NEGATION,), 3, NEGATED), scope((REPORT,), 6, REPORTED), scope(AIMS, 4, TARGETED, (INSULT, THREAT)),
]
#: Whom a threat is aimed at, where the object stands first ("ich werde dich töten").
OBJECT_FIRST = [scope((OBJECT,), 4, AIMED, (THREAT,))]
#: Read from the right: the target and the object behind a hit, and who said it.
FROM_RIGHT = [
    scope(AIMS, 4, TARGETED, (INSULT, THREAT)), scope((TARGET, OBJECT), 4, AIMED, (THREAT,)), told(4, 12, REPORTED),
]


def place(mark: int) -> int:
    """A hit's place among the weights: insults, threats, aimed threats, by three marks each."""
    return mark % MARKS + (MARKS * (1 + bool(mark & AIMED)) if mark & MENACING else 0)


def lowered(text: str) -> str:
    """The text in lower case, character by character, so places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def run(nexts: list[list[int]], marks: list[list[int]], classes: list[int]) -> list[int]:
    """The marks a composed machine sets on each word."""
    state, out = 0, []
    for symbol in classes:
        out.append(marks[state][symbol])
        state = nexts[state][symbol]
    return out


def own_marks(bias: float) -> np.ndarray:
    """What the grammar says by itself: an insult counts, a threat near a target half, an aimed threat as
    much as AIMED_SCORE needs, any other threat nothing; denied and reported ones count half of that."""
    prior = np.array([0.5 ** bin(m & (NEGATED | REPORTED)).count("1") for m in range(MARKS)])
    near = np.array([0.5 if m & TARGETED else 0 for m in range(MARKS)])
    return np.concatenate([prior, prior * near, prior * (np.log(AIMED_SCORE / (1 - AIMED_SCORE)) - bias)])


class Grammar:
    """The lexicon's insults, the word classes and the composed machines with a weight for each mark.

    ``words`` and ``stems`` give weights in log odds; ``marks`` multiplies a hit's weight by what the
    machines say of it (8 insult marks, 8 threat marks, 8 of aimed threats); ``bias`` is the score
    without a match. Letters are spelled into classes, and classes read from the left and the right.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], marks: np.ndarray | None = None, bias: float = -3.0):
        self.words, self.stems, self.bias = words, stems, bias
        self.marks = own_marks(bias) if marks is None else marks
        self.left, self.object, self.right = ([t.tolist() for t in compose(m)] for m in (GRAMMAR, OBJECT_FIRST, FROM_RIGHT))
        self.insult = Speller(INSULT, words, stems)
        self._build()

    def _build(self) -> None:
        self.hits = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREAT_WORDS, *AIMED_WORDS}:
            self.hits.add_word(w, len(w))
        if len(self.hits):
            self.hits.make_automaton()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "hits"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._build()

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's class, and its weight."""
        whole, stem = self.insult.read(word)
        if whole is None:
            whole = next((found for s in SPELLERS if (found := s.read(word)[0])), None)
        return whole or stem or (OTHER, 0.0)

    def clauses(self, low: str) -> Iterator[tuple[int, int]]:
        """Start and end of each clause that holds an insult or a threat, once each."""
        end = 0
        if not len(self.hits):
            return
        for at, n in self.hits.iter(low):
            first = at - n + 1
            if first < end or first and low[first - 1].isalpha():
                continue
            start = max([end, *(m.end() for m in _END.finditer(low, end, first))])
            found = _END.search(low, at)
            end = found.start() if found else len(low)
            yield start, end

    def matches(self, text: str | None) -> list[tuple[int, int, np.ndarray]]:
        """The clauses matched, each with the weights of its insults and threats by mark."""
        out = []
        low = lowered(text or "")
        for start, end in self.clauses(low):
            read = [self.symbol(m.group()) if m.group()[0].isalpha() else (BREAK, 0.0) for m in _TOKEN.finditer(low, start, end)]
            classes = [symbol for symbol, _ in read]
            said = [a | b for a, b in zip(run(*self.left, classes), run(*self.object, classes), strict=True)]
            behind = run(*self.right, classes[::-1])[::-1]
            sums = np.zeros(PLACES)
            for (_, weight), a, b in zip(read, said, behind, strict=True):
                if a & (ABUSIVE | MENACING):
                    sums[place(a | b)] += weight
            if sums.any():
                out.append((start, end, sums))
        return out

    def features(self, text: str | None) -> np.ndarray:
        """By mark, the weights of all matched clauses, cut at MOST_WEIGHT."""
        total = np.zeros(PLACES)
        for _, _, sums in self.matches(text):
            total += sums
        return np.minimum(total, MOST_WEIGHT)

    def probability(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + features @ self.marks, -30, 30))))

    def score(self, text: str | None) -> float:
        return self.probability(self.features(text))


def fitted_marks(x: np.ndarray, y: np.ndarray, pull: float = 3.0) -> tuple[np.ndarray, float]:
    """Weights of the marks and the bias: logistic regression by Newton steps, drawn to what the
    grammar says by itself at that bias."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.append(own_marks(-3.0), -3.0)
    stiff = np.full(len(w), pull)
    stiff[-1] = 0.1
    for _ in range(30):
        prior = np.append(own_marks(w[-1]), -3.0)
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + stiff * (w - prior)
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(stiff)
        w -= np.linalg.solve(curve, slope)
    # places no labelled row has stay as the grammar says at the last bias
    w[:-1] = np.where(x.any(axis=0), w[:-1], own_marks(w[-1]))
    return np.maximum(w[:-1], 0), float(w[-1])


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word or stem: texts that hold it by label, and hashes of its surroundings in toxic ones."""
    for batch in batches:
        texts: tuple[Counter, Counter] = (Counter(), Counter())
        around: dict[str, set[int]] = {}
        for text, label in zip(batch["_text"], batch["_label"], strict=True):
            words = WORD.findall(lowered(text or ""))
            keys: set[str] = set()
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                own = [f"={word}", *(f"{word[:n]}" for n in STEMS if n < len(word))]
                keys.update(own)
                if label:
                    for k in own:
                        around.setdefault(k, set()).add(hash_of(before, after))
            texts[int(label)].update(keys)
        rows = [(k, texts[1][k], texts[0][k], sorted(around.get(k, ()))[:CONTEXTS * 4]) for k in texts[0].keys() | texts[1].keys()]
        yield pd.DataFrame(rows, columns=["entry", "toxic", "clean", "around"])


def hash_of(before: str, after: str) -> int:
    """A number for a pair of neighbours that is the same in every process."""


    return zlib.crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))


def lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems with their log odds, learned from labelled texts.

    Counted in tasks and summed by shuffle; only entries that pass, the LEXICON_ROWS most frequent at
    most, reach the driver. A stem that a shorter one or its own words cover is left out.
    """
    counted = sample.mapInPandas(_evidence, "entry string, toxic long, clean long, around array<long>")
    summed = counted.groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
        F.size(F.array_distinct(F.flatten(F.collect_list("around")))).alias("contexts"),
    )
    passed = (
        summed.where((F.col("contexts") >= CONTEXTS) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
        .orderBy(F.col("toxic").desc(), "entry")
        .limit(LEXICON_ROWS)
        .collect()
    )
    found = {r["entry"]: (r["toxic"], min(MOST_WEIGHT, float(np.log((r["toxic"] + 0.5) / (r["clean"] + 0.5))) + 1)) for r in passed}
    words = {k[1:]: w for k, (_, w) in found.items() if k[0] == "="}
    stems: dict[str, float] = {}
    for stem in sorted((k for k in found if k[0] != "="), key=len):
        own = sum(found[f"={w}"][0] for w in words if w.startswith(stem))
        shorter = any(stem[:n] in stems for n in range(4, len(stem)))
        if not shorter and found[stem][0] > 1.1 * own:
            stems[stem] = found[stem][1]
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """A grammar with the lexicon and the marks' weights learned from up to ``rows`` labelled documents."""
    ship(docs.sparkSession)
    sample = cut(fit_sample(docs, labels, "toxic", 3, 1, rows).select("_text", "_label"))
    grammar = Grammar(*lexicon(sample))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [grammar.features(t).tolist() for t in batch["_text"]]
            yield pd.DataFrame({"x": x, "y": batch["_label"]})

    got = sample.mapInPandas(featured, "x array<double>, y int").collect()
    if got:
        grammar.marks, grammar.bias = fitted_marks(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    return grammar


SPANS = "array<struct<start:int,end:int,score:double>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1, higher: toxic likelier), predicted, and clauses: the
    matched clauses' places in the text and scores by themselves.

    Only the text is read. A null or empty one, or one without a match, gets the score of the bias.
    Rows may repeat; columns named like a result are replaced. An empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    results = ("score", "predicted", "clauses")
    first, _, last = carried(docs, results)
    rest, text_name = docs.select(*first), carried_as(docs, results, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(batch.schema.get_field_index(text_name)):
                found = own.matches(text.as_py())
                total = np.sum([f[2] for f in found], axis=0) if found else np.zeros(PLACES)
                scores.append(own.probability(np.minimum(total, MOST_WEIGHT)))
                spans.append([{"start": a, "end": b, "score": own.probability(np.minimum(x, MOST_WEIGHT))} for a, b, x in found])
            yield with_arrays(batch, score=pa.array(scores, pa.float64()), clauses=pa.array(spans, ARROW_SPANS))

    schema = rest.withColumn("score", F.lit(0.0)).withColumn("clauses", F.lit(None).cast(SPANS)).schema
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rest.mapInArrow(scored, schema).select(*last, "score", "clauses", predicted)


def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grammar = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, grammar).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted"
    )
