"""Toxicity scores from a weighted finite-state pattern grammar.

Small transducers read the words of a clause as symbols and emit tags: an insult word matches where
it stands, a threatening verb matches once a target word follows within a few words, a negation
opens a short scope, a reporting verb opens a quotation up to the clause's end, and a target word
marks the clause as addressed to somebody.  Their composition is one deterministic machine.  The
weight of a match is that of its word; negation and reported speech lessen it, and so does a clause
that addresses nobody.  A clause's weight is the sum over its different matches.

A document's score is a logistic function of its matched clauses alone: their total weight, the
weight for the text's length, and the number of strong clauses.  None of the three may count
against toxicity, so a negated or reported form never scores higher than the plain one.

Words are matched whole or by their first letters, since the learned lexicon holds stems.  The
lexicon and the logistic weights are fitted on a bounded sample of labelled rows
(``sample_per_label``); every text is scored whole.

Defined results: a null or empty text has no match and gets the score of a text without matches;
if no labelled row of both kinds exists, the lexicon is empty, only threats match and the weights are
their priors; repeated rows are scored alike; columns of other names are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import row_slices

# Function words of the grammar in English, German, French and Spanish.
NEGATIONS = "not no never without cannot nor isn aren wasn didn doesn nicht kein keine nie ohne pas jamais sans nunca sin".split()
REPORTS = "said says wrote called quoted claimed sagte schrieb nannte dit appelle dijo escribe llama".split()
TARGETS = "you your he she they him her them du dich dein ihr sie tu te vous il elle ils tú usted él ella ellos".split()
THREATS = "kill hurt destroy beat stab shoot töten verletzen tuer frapper matar golpear".split()

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
#: Tags that the grammar emits.
INSULTED, THREATENED, NEGATED, REPORTED, ADDRESSED = (1 << k for k in range(5))
#: How much of a match's weight is left if it is negated, if it is reported, and if its clause addresses nobody.
NEGATED_SHARE, REPORTED_SHARE, BARE_SHARE = 0.1, 0.25, 0.8
#: The weight of a threat.
THREAT_WEIGHT = 5.0
STEM_LENGTHS = range(4, 9)

#: ASCII punctuation that ends a clause becomes a line break, other ASCII marks a blank.
_CLAUSES = bytes(
    10 if chr(i) in ".!?;\n\r" else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)
)


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: reading a symbol in a state gives the next state and emits tags; a clause ends with its last state's tags."""

    step: tuple[tuple[int, ...], ...]
    emit: tuple[tuple[int, ...], ...]
    last: tuple[int, ...]


def _machine(states: int, step, emit, last=lambda state: 0) -> Transducer:
    cells = lambda f: tuple(tuple(f(state, symbol) for symbol in SYMBOLS) for state in range(states))
    return Transducer(cells(step), cells(emit), tuple(last(state) for state in range(states)))


#: An insult word matches where it stands.
INSULTS = _machine(1, lambda state, symbol: 0, lambda state, symbol: INSULTED * (symbol == INSULT))
#: A threatening verb matches with a target among the next three words; the state counts how many are left.
THREATENING = _machine(
    4,
    lambda state, symbol: 3 if symbol == THREAT else 0 if symbol == TARGET else max(0, state - 1),
    lambda state, symbol: THREATENED * (state > 0 and symbol == TARGET),
)
#: A negation holds for the next four words.
NEGATION_SCOPE = _machine(5, lambda state, symbol: 4 if symbol == NEGATION else max(0, state - 1), lambda state, symbol: NEGATED * (state > 0))
#: What follows a reporting verb is reported.
REPORTED_SPEECH = _machine(2, lambda state, symbol: int(state or symbol == REPORT), lambda state, symbol: REPORTED * state)
#: A clause with a target word is addressed to somebody.
ADDRESS = _machine(2, lambda state, symbol: int(state or symbol == TARGET), lambda state, symbol: 0, lambda state: ADDRESSED * state)


def compose(*machines: Transducer) -> Transducer:
    """The machine that runs all of them side by side and emits the union of their tags; state 0 is their joint start."""
    states: list[tuple[int, ...]] = [(0,) * len(machines)]
    number = {states[0]: 0}
    step, emit = [], []
    for state in states:
        row, tags = [], []
        for symbol in SYMBOLS:
            following = tuple(m.step[s][symbol] for m, s in zip(machines, state, strict=True))
            if following not in number:
                number[following] = len(states)
                states.append(following)
            row.append(number[following])
            tags.append(sum(m.emit[s][symbol] for m, s in zip(machines, state, strict=True)))
        step.append(tuple(row))
        emit.append(tuple(tags))
    last = tuple(sum(m.last[s] for m, s in zip(machines, state, strict=True)) for state in states)
    return Transducer(tuple(step), tuple(emit), last)


GRAMMAR = compose(INSULTS, THREATENING, NEGATION_SCOPE, REPORTED_SPEECH, ADDRESS)
#: A clause of at least this weight is strong.
STRONG = 3.0
#: What a document's clauses come to: total weight, words, strong clauses.
FEATURES = 3


def _clauses(text: str | None) -> list[list[bytes]]:
    folded = (text or "").lower().encode("utf-8", "replace").translate(_CLAUSES)
    return [line.split() for line in folded.split(b"\n")]


@dataclass(frozen=True)
class ToxicityGrammar:
    """A fitted grammar: the matching words and stems with their weights, and the logistic weights."""

    stems: dict[bytes, float]
    weights: np.ndarray

    def __post_init__(self) -> None:
        words = {w.encode(): kind for kind, group in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)) for w in group}
        object.__setattr__(self, "_symbols", words)
        object.__setattr__(self, "_openings", {s.rstrip(b" ")[:4] for s in self.stems})

    def _unit(self, word: bytes) -> tuple[bytes, float]:
        """The heaviest unit of the lexicon that matches a word, and its weight."""
        best = (b"", 0.0)
        if word[:4] in self._openings:
            # Stems are cut by letters, as they were learned; a whole word ends with a blank.
            letters = word.decode("utf-8", "replace")
            for unit in (word + b" ", *(letters[:n].encode() for n in STEM_LENGTHS if n <= len(letters))):
                best = max(best, (unit, self.stems.get(unit, 0.0)), key=lambda pair: pair[1])
        return best

    def clause_weight(self, clause: list[bytes], insults: dict[bytes, tuple[bytes, float]]) -> float:
        """The sum over a clause's different matching units of the weight that negation and reporting leave them."""
        found: dict[bytes, float] = {}
        state, threat = 0, b""
        for word in clause:
            symbol = self._symbols.get(word, INSULT if word in insults else WORD)
            if symbol == THREAT:
                threat = word
            tags = GRAMMAR.emit[state][symbol]
            for tag, match, weight in ((INSULTED, *insults.get(word, (b"", 0.0))), (THREATENED, threat, THREAT_WEIGHT)):
                if tags & tag:
                    left = weight * (NEGATED_SHARE if tags & NEGATED else 1) * (REPORTED_SHARE if tags & REPORTED else 1)
                    found[match] = max(found.get(match, 0.0), left)
            state = GRAMMAR.step[state][symbol]
        return sum(found.values()) * (1 if GRAMMAR.last[state] & ADDRESSED else BARE_SHARE)

    def features(self, text: str | None) -> np.ndarray:
        """Total weight of the whole text's matched clauses, its words, and its strong clauses."""
        clauses = _clauses(text)
        words = set().union(*clauses)
        insults = {word: unit for word in words if word not in self._symbols and (unit := self._unit(word))[1]}
        starts = insults.keys() | (words & {w.encode() for w in THREATS})
        weights = [self.clause_weight(clause, insults) for clause in clauses if not starts.isdisjoint(clause)] if starts else []
        return np.array([sum(weights), sum(map(len, clauses)), sum(w >= STRONG for w in weights)], float)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        rows = np.array([self.features(text) for text in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(design(rows) @ self.weights, -30, 30)))

    def transform(self, docs: DataFrame, *, text: str = "text", score: str = "score") -> DataFrame:
        """All columns of ``docs`` and the score; a column of the result's name is replaced."""
        docs = docs.drop(score)
        place = docs.columns.index(text)
        schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in row_slices(whole)):
                value = self.score(batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=schema.names)

        return docs.mapInArrow(label, schema)


def design(features: np.ndarray) -> np.ndarray:
    """Logistic inputs: a constant, the clauses' weight, their weight for the text's length, and the strong clauses."""
    total, words, strong = features.T
    return np.column_stack((np.ones(len(features)), np.log1p(total), np.log1p(100 * total / (words + 100)), np.log1p(strong)))


#: Weights before any label is seen.
PRIOR = np.array([-5.0, 1.5, 1.5, 6.5])


def fit_weights(features: np.ndarray, labels: np.ndarray, strength: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton steps for the logistic weights with a Gaussian prior around ``PRIOR``; no input may lower the score."""
    x, w = design(features), PRIOR.copy()
    penalty = np.array([0.01, 20 * strength, strength, 400 * strength])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + penalty * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.clip(np.linalg.solve(curve, slope), -4, 4)
        w -= step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _units(text: str | None) -> set[bytes]:
    out: set[bytes] = set()
    for clause in _clauses(text):
        out.update(clause)
    stems = {letters[:n].encode() for word in out for letters in [word.decode("utf-8", "replace")] for n in STEM_LENGTHS if n <= len(letters)}
    return {w + b" " for w in out} | stems


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_label: int = 4000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityGrammar:
    """Fit lexicon and weights on at most ``sample_per_label`` rows of either label.

    ``docs`` holds the texts that may be learned from, ``labels`` the ids with their 0/1 label.
    The sample is the rows of smallest id hash, so it does not depend on the partitioning.
    Equal texts count once.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("__label"))
    known = known.join(docs.select(doc_id), doc_id, "left_semi")
    parts = [known.where(F.col("__label") == kind).orderBy(F.xxhash64(doc_id), doc_id).limit(sample_per_label) for kind in (0, 1)]
    # At most 2 * sample_per_label ids: their size is bounded by the parameter.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(doc_id, F.col(text).cast("string").alias("__text")).join(chosen, doc_id).select("__label", "__text")
    rows = rows.dropDuplicates(["__label", "__text"]).persist()
    sizes = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    stems: dict[bytes, float] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
        for batch in batches:
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[kind].update(_units(value))
        for kind, total in enumerate(totals):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(total), pa.int32()), pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["kind", "unit", "n"])

    if sizes.get(0) and sizes.get(1):
        least = max(4, sizes[1] // 500)
        pos = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("pos")
        neg = F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("neg")
        units = rows.mapInArrow(count, "kind int, unit binary, n long").groupBy("unit").agg(pos, neg)
        odds = F.log((F.col("pos") + 0.5) / (sizes[1] + 1)) - F.log((F.col("neg") + 0.5) / (sizes[0] + 1))
        sure = (odds - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))).alias("sure")
        best = units.where(F.col("pos") >= least).select("unit", "pos", odds.alias("odds"), sure).where(F.col("sure") > 0.7)
        # Bounded by the sample: a unit is in at least ``least`` of its rows.
        found = {bytes(r.unit): (r.sure, r.pos) for r in best.collect()}
        for unit, (sure_of, _) in found.items():
            letters = unit.rstrip(b" ").decode()
            shorter = [found[p][0] for n in STEM_LENGTHS if n < len(letters) and (p := letters[:n].encode()) in found]
            if all(x < sure_of for x in shorter):
                stems[unit] = sure_of
    grammar = ToxicityGrammar(stems, PRIOR)
    if sizes.get(0) and sizes.get(1):
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [grammar.features(text).tolist() for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["label", "features"])

        sample = rows.mapInArrow(measure, "label int, features array<double>").collect()
        features = np.array([r.features for r in sample]).reshape(-1, FEATURES)
        grammar = ToxicityGrammar(stems, fit_weights(features, np.array([r.label for r in sample], float)))
    rows.unpersist()
    return grammar


def scores(docs: DataFrame, labels: DataFrame, *, learn: DataFrame, **names: str) -> DataFrame:
    """``docs`` with a toxicity score fitted on the labelled rows of ``learn``."""
    return fit(learn, labels, **names).transform(docs)
