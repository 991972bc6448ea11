"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.columns import counted, text_of
from tarmac.llm.labelled import SAMPLE, fit_logistic, labelled_sample, remainder

# Seed words of the grammar's classes, English, French, German and Spanish.
INSULT = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard "
    "vermin abruti crétin connard salaud ordure minable dummkopf trottel abschaum arschloch versager widerlich idiota "
    "imbécil estúpido estúpida basura patético asqueroso escoria"
)
HARM = (
    "kill hurt destroy murder beat stab shoot strangle burn tuer frapper détruire assassiner brûler töten umbringen "
    "schlagen vernichten erschießen matar golpear destruir asesinar quemar"
)
INTENT = "will gonna shall going i'll we'll vais allons werde werden will voy vamos"
TARGET = "you your yourself u they them he she him her these those people tu toi vous ils elles du dich ihr euch sie tú te usted ustedes ellos ellas"
NEGATION = "not no never isn't aren't wasn't don't doesn't nobody neither nor ne pas jamais nicht kein keine nie niemals nunca tampoco jamás"
REPORT = (
    "said says say wrote writes called calls claimed claims quoted quote reported reportedly according dit écrit appelé selon sagte "
    "schrieb nannte laut dijo escribió llamó según"
)

OTHER, INSULTING, HARMING, INTENDING, TARGETING, NEGATING, REPORTING, END = range(8)
SEED_WEIGHT = 2.0
TRIM = ".,;:!?\"'()[]{}<>*_“”‘’«»…-–—"
STOPS = ".;!?\n"
LINE_ENDS = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
WORDS_KEPT = 300_000
PREFIXES = (4, 5, 6)


class Lexicon(NamedTuple):
    """Weights of insulting words and of beginnings of words, learned or given."""

    words: dict[str, float]
    starts: dict[str, float]


def bare(word: str) -> str:
    return word.strip(TRIM)


def scored_tokens(text: str) -> list[str]:
    """The words of a text, split at white space as in ``terms``, with one token for each line end between them."""
    first, *rest = LINE_ENDS.split(text.lower())
    found = first.split()
    for line in rest:
        found.append("\n")
        found += line.split()
    return found


def terms(text: str) -> set[str]:
    """Distinct words of a text, and with a trailing star their beginnings."""
    words = {bare(w) for w in text.lower().split()} - {""}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


class Symbols(dict):
    """Token to (class, weight, closes the clause): the lexical transducer, as a bounded memo."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.classes = {w: c for c, words in ((REPORTING, REPORT), (NEGATING, NEGATION), (TARGETING, TARGET), (INTENDING, INTENT), (HARMING, HARM)) for w in words.split()}
        self.seeds = set(INSULT.split())

    def __missing__(self, token: str):
        word = bare(token)
        weight = self.lexicon.words.get(word)
        if weight is None:
            weight = max((self.lexicon.starts.get(word[:n], 0.0) for n in PREFIXES if len(word) > n), default=0.0)
        if not weight and word in self.seeds:
            weight = SEED_WEIGHT
        kind = INSULTING if weight else self.classes.get(word, OTHER)
        closes = token[-1] in STOPS
        out = (kind, weight, closes) if kind or closes else None
        if len(self) < WORDS_KEPT:
            self[token] = out
        return out


def negation(state: int, kind: int) -> tuple[int, float]:
    """Scope of a negation: the three tokens after it weigh a quarter."""
    return (3, 1.0) if kind == NEGATING else (max(0, state - 1), 0.25 if state else 1.0)


def reported(state: int, kind: int) -> tuple[int, float]:
    """After a verb of saying the rest of the clause weighs half."""
    return (1, 1.0) if kind == REPORTING else (state, 0.5 if state else 1.0)


def insult(state: int, kind: int, weight: float) -> tuple[int, float]:
    """Insults add their weight; one that follows another in the clause adds half as much again."""
    return (1, weight * (1.5 if state else 1.0)) if kind == INSULTING else (state, 0.0)


def threat(state: int, kind: int) -> tuple[int, float]:
    """Intent, then harm, then a target, with other tokens between: only the whole path weighs."""
    if state == 0 and kind == INTENDING or state == 1 and kind == HARMING:
        return state + 1, 0.0
    return (0, 4.0) if state == 2 and kind == TARGETING else (state, 0.0)


def clause_weight(symbols: list[tuple[int, float]]) -> float:
    """The weight of a clause: the four transducers run side by side over its symbols.

    A target anywhere in the clause makes an insult weigh a quarter more.
    """
    n = r = i = t = 0
    total, aimed = 0.0, False
    for kind, weight in symbols:
        n, less = negation(n, kind)
        r, half = reported(r, kind)
        i, a = insult(i, kind, weight)
        t, b = threat(t, kind)
        total += (a + b) * less * half
        aimed |= kind == TARGETING
    return total * (1.25 if aimed else 1.0)


def text_weights(text: str, symbols: Symbols) -> tuple[float, float, float]:
    """Largest and summed weight of the matched clauses, and their sum per hundred tokens.

    Tokens that have no class only count for the distance to a negation. Clauses without an insult or a
    harm weigh nothing and are not run.
    """
    found = list(map(symbols.__getitem__, scored_tokens(text)))
    most = total = 0.0
    start = 0
    for at in [i for i, s in enumerate(found) if s is not None and s[0] in (INSULTING, HARMING)]:
        if at < start:
            continue
        begin = at
        while begin > start and (found[begin - 1] is None or not found[begin - 1][2]):
            begin -= 1
        end = at
        while end < len(found) - 1 and (found[end] is None or not found[end][2]):
            end += 1
        weight = clause_weight([(OTHER, 0.0) if s is None else s[:2] for s in found[begin : end + 1]])
        most, total = max(most, weight), total + weight
        start = end + 1
    return most, total, 100.0 * total / max(1, len(found))


def features(texts, symbols: Symbols) -> np.ndarray:
    found = np.array([text_weights(t, symbols) for t in texts], dtype=float).reshape(-1, 3)
    return np.column_stack([np.minimum(found[:, 0], 8), np.log1p(found[:, 1]), np.log1p(found[:, 2])])


def learn_lexicon(sample: DataFrame, least: int = 8, sure: float = 0.9, entries: int = 20_000) -> Lexicon:
    """Words and beginnings of words that mark toxic texts.

    A term has to occur in ``least`` toxic texts of the sample and ``sure`` of its weighted texts must be
    toxic; its weight is a tenth of the smoothed log odds above that of the labels. ``entries`` bounds what
    the driver and the tasks hold.
    """

    def count(wanted):
        def tally(batches):
            seen: Counter = Counter()
            for pdf in batches:
                for text in pdf["text"]:
                    found = terms(text)
                    seen.update(found if wanted is None else found & wanted.value)
            yield from counted(seen, "term")

        return tally

    sizes = dict(sample.groupBy("y").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon({}, {})
    total = lambda df, wanted: df.mapInPandas(count(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    often = total(sample.filter("y = 1").select("text"), None).filter(F.col("n") >= least)
    often = dict(often.orderBy(F.desc("n"), "term").limit(10 * entries).collect())
    wanted = sample.sparkSession.sparkContext.broadcast(set(often))
    clean = dict(total(sample.filter("y = 0").select("text"), wanted).collect())
    weights = {}
    for term, n in often.items():
        odds = (n / bad) / ((clean.get(term, 0) + 0.5) / good)
        if odds / (1 + odds) >= sure and n > 20 * clean.get(term, 0) * bad / good:
            weights[term] = min(4.0, 1.0 + math.log(odds) / 4)
    top = sorted(weights, key=lambda t: (-often[t], t))[:entries]
    starts = {t[:-1]: weights[t] for t in top if t[-1] == "*"}
    return Lexicon({t: weights[t] for t in top if t[-1] != "*"}, starts)


class Grammar(NamedTuple):
    lexicon: Lexicon
    weights: tuple[float, ...]


#: Used without labels: a clear insult or threat scores above 0.7.
UNTRAINED = (1.2, 0.5, 0.2, -3.0)


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 1, parts: int = 3, limit: int = SAMPLE) -> Grammar:
    """Lexicon and weights from the labels whose crc32 remainder by ``parts`` is not ``held_out``."""
    sample = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), parts) != held_out, limit)
    lexicon = learn_lexicon(sample)

    def measure(batches):
        symbols = Symbols(lexicon)
        for pdf in batches:
            x = features(pdf["text"], symbols)
            yield pd.DataFrame({"y": pdf["y"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    found = sample.mapInPandas(measure, "y int, a double, b double, c double").toPandas()
    if found["y"].nunique() < 2:
        return Grammar(lexicon, UNTRAINED)
    w = fit_logistic(found[["a", "b", "c"]].to_numpy(), found["y"].to_numpy())
    return Grammar(lexicon, tuple(w.tolist()))


_memo: dict = {}


def rate(texts, grammar: Grammar) -> np.ndarray:
    """Scores of texts; the memo of tokens lives as long as the worker uses the same grammar."""
    if _memo.get("of") is not grammar:
        _memo.update(of=grammar, symbols=Symbols(grammar.lexicon))
    x = features(texts, _memo["symbols"])
    return 1 / (1 + np.exp(-np.clip(x @ np.array(grammar.weights[:-1]) + grammar.weights[-1], -30, 30)))


def score_of(docs: DataFrame, grammar: Grammar):
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(rate(texts, shared.value))

    return scores(text_of(docs))


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """Score 0 to 1 and decision for every whole text: doc_id, score, predicted (score >= ``threshold``).

    Null and empty texts match nothing and get the score of that. Rows repeat as in ``docs``; an empty
    table gives an empty table. Only doc_id and text are read, and doc_id never reaches the score.
    """
    scored = docs.select(docs["doc_id"].alias("doc_id"), score_of(docs, grammar).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    return docs.filter(score_of(docs, grammar) < threshold)
