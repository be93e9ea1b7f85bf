"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, modal, target, negation, report, other).
Five small transducers each rewrite a clause's symbols and change its scores: negation,
insult, threat, target and reported speech. An arc's weight is a map x -> times * x +
plus of what a word scores so far, so composing two machines composes their weights,
and all five become one machine that gives the score of every word in one pass. What
counts is the clause: an insult scores in full only beside a target or other insults
(of the plain list, not enough alone), a threat only with a target soon after it. Insult lexemes are whole words or word
beginnings; their weights are learned from labelled documents, beside a short list of
plain insults.

The model is small whatever the corpus: at most `most_lexemes` lexemes and three
numbers, learned from at most `fit_rows` labelled documents of each class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, written

#: Symbols of input words.
OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT, MODAL = "O", "N", "R", "Y", "I", "V", "W"
#: Symbols that transducers write: a negated insult, an insult as said, one with a target, and a threat to a target.
NEGATED, ABUSE, TARGETED, MENACE = "i", "A", "T", "X"
ALPHABET = [OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT, MODAL, NEGATED, ABUSE, TARGETED, MENACE]

FUNCTION_WORDS = {
    NEGATION: "not never no nor isn aren wasn don doesn didn pas jamais ni nicht kein keine niemals nunca jamás",
    REPORT: "said says say told wrote reported quoted claimed called dit disait écrit sagte schrieb berichtete dijo escribió",
    TARGET: "you your you're youre u he she they them him her tu vous toi du dich dir ihr sie usted ustedes ti",
    MODAL: "will gonna shall must should would going i'll we'll werde wirst voy vamos vais allons",
}
THREATS = "kill murder hurt destroy shoot stab strangle smash tuer töten umbringen matar destruir"
INSULTS = "idiot idiots moron morons scum loser losers trash pathetic worthless disgusting stupid clown bitch bastard asshole connard salope abruti imbécile arschloch dummkopf hurensohn gilipollas pendejo cabrón estúpido"

PLAIN_WEIGHT = 5.0

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass(frozen=True)
class Arc:
    """What a symbol becomes, the next state, and the weight: a score x becomes times * x + plus."""

    out: str
    to: int
    times: float = 1.0
    plus: float = 0.0


@dataclass
class Transducer:
    """Deterministic and total: what arcs doesn't name is copied, scores as before, and leads to rest[state]."""

    start: int
    arcs: dict[tuple[int, str], Arc]
    rest: dict[int, int]

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs.get((state, symbol)) or Arc(symbol, self.rest[state])


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that rewrites by first, then by second, over pairs of their states; weights are composed as maps."""
    pairs = {p: i for i, p in enumerate(product(first.rest, second.rest))}
    arcs = {}
    for (p, q), i in pairs.items():
        for symbol in ALPHABET:
            x = first.step(p, symbol)
            y = second.step(q, x.out)
            arcs[i, symbol] = Arc(y.out, pairs[x.to, y.to], x.times * y.times, x.plus * y.times + y.plus)
    return Transducer(pairs[first.start, second.start], arcs, {i: i for i in pairs.values()})


def transducers() -> list[Transducer]:
    """Negation, insult, threat, target and reported speech, in the order in which they are composed."""
    # A negation reaches two words on.
    near = {(s, INSULT): Arc(NEGATED, 0, 0.4) for s in (1, 2)} | {(s, THREAT): Arc(OTHER, 0, 0.0) for s in (1, 2)}
    negation = Transducer(0, {(s, NEGATION): Arc(NEGATION, 1) for s in (0, 1, 2)} | near, {0: 0, 1: 2, 2: 0})
    # The first insult of a clause says less by itself than those after it.
    insult = Transducer(0, {(0, INSULT): Arc(ABUSE, 1, 0.8), (1, INSULT): Arc(ABUSE, 1)}, {0: 0, 1: 1})
    # States: nothing; a modal one or two words ago; a threat with a modal, or without one, none to two words ago.
    modal = {(s, MODAL): Arc(MODAL, 1) for s in range(9)}
    verb = {(s, THREAT): Arc(THREAT, 3 if s in (1, 2) else 6) for s in range(9)}
    aimed = {(s, TARGET): Arc(MENACE, 0, 1.0, 6.0 if s < 6 else 5.0) for s in range(3, 9)}
    threat = Transducer(0, modal | verb | aimed, {0: 0, 1: 2, 2: 0, 3: 4, 4: 5, 5: 0, 6: 7, 7: 8, 8: 0})
    # A target before an insult, or after it.
    target = Transducer(0, {(0, TARGET): Arc(TARGET, 1), (1, ABUSE): Arc(TARGETED, 1, 1.25), (0, ABUSE): Arc(ABUSE, 2), (2, TARGET): Arc(TARGETED, 1, 1.0, 1.0)}, {0: 0, 1: 1, 2: 2})
    report = Transducer(0, {(0, REPORT): Arc(REPORT, 1), (1, ABUSE): Arc(ABUSE, 1, 0.6), (1, TARGETED): Arc(TARGETED, 1, 0.6), (1, MENACE): Arc(MENACE, 1, 0.3)}, {0: 0, 1: 1})
    return [negation, insult, threat, target, report]


def grammar() -> Transducer:
    return reduce(composed, transducers())


@dataclass
class Model:
    """Lexemes (a word, or a beginning with a trailing '-') with weights, and the logistic end of the score."""

    lexemes: dict[str, float] = field(default_factory=dict)
    bias: float = -3.5
    most: float = 1.0
    total: float = 0.0

    def score(self, most: float, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.most * most + self.total * math.log1p(total)))))


#: Lengths of word beginnings that can be lexemes.
STEMS = (3, 4, 5, 6, 7)


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if n < len(word))]


class Reader(dict):
    """Word -> (symbol, weight); the memory of words is emptied when it grows too large."""

    MOST = 400_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.lexemes = model.lexemes
        self.fixed = {w: (s, 0.0) for s, words in FUNCTION_WORDS.items() for w in words.split()}
        self.fixed |= {w: (THREAT, 0.0) for w in THREATS.split()}
        self.plain = set(INSULTS.split())
        self.machine = grammar()

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) >= self.MOST:
            self.clear()
        weight = max([PLAIN_WEIGHT if word in self.plain else 0.0, *(self.lexemes.get(f, 0.0) for f in features_of(word))])
        out = self[word] = self.fixed.get(word) or ((INSULT, weight) if weight > 0 else (OTHER, 0.0))
        return out

    def clauses(self, text: str | None) -> tuple[float, float, int]:
        """The largest clause score, the sum of clause scores, and the number of clauses that score."""
        most = total = 0.0
        n, arcs = 0, self.machine.arcs
        read = [("", 0.0) if len(t) == 1 and t in ".!?;:\n" else self[t] for t in TOKEN.findall((text or "").lower())]
        i, end = 0, len(read)
        while i < end:
            j = i
            marked = False
            while j < end and read[j][0]:
                marked |= read[j][0] in (INSULT, THREAT)
                j += 1
            if marked:
                state, clause = self.machine.start, 0.0
                for symbol, weight in read[i:j]:
                    arc = arcs[state, symbol]
                    state = arc.to
                    clause += weight * arc.times + arc.plus
                most, total, n = max(most, clause), total + clause, n + (clause > 0)
            i = j + 1
        return most, total, n


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learned(documents: DataFrame, labels: DataFrame, *, fit_rows: int = 3000, most_lexemes: int = 2000, toxic_share: float = 0.3) -> Model:
    """A model from at most fit_rows toxic and fit_rows other labelled documents that aren't held out.

    They are the first by md5 of their id, so the sample is the same on every run. A
    lexeme must be far likelier in toxic documents than chance over all candidates
    would explain, so few labels teach few lexemes; none leave the plain list. The
    logistic end is fitted as if toxic_share of the documents were toxic."""
    spark = documents.sparkSession
    marked = labels.select(F.col("doc_id").cast("string").alias("id"), (F.col("toxic") == 1).alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    first = marked.where("toxic").orderBy(F.md5("id"), "id").limit(fit_rows).unionAll(marked.where("not toxic").orderBy(F.md5("id"), "id").limit(fit_rows))
    texts = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    sample = written(texts.join(F.broadcast(first), "id").select("toxic", "text").distinct().repartition(24), "toxic-sample")
    size = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    model = Model()
    if not pos or not neg:
        return model

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                found = {f for w in set(TOKEN.findall((text.as_py() or "").lower())) if len(w) > 1 for f in features_of(w)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([int(toxic.as_py())] * len(found), pa.int32())], ["feature", "toxic"])

    counts = sample.mapInArrow(seen, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    counts = written(counts, "toxic-features")
    candidates = max(1, counts.count())
    rate, p, n = pos / (pos + neg), float(pos), float(neg)
    gain = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    both = F.col("t") + F.col("c")
    ratio = F.log((F.col("t") + 0.5) / (p + 1)) - F.log((F.col("c") + 0.5) / (n + 1))
    kept = counts.withColumn("gain", 2 * (gain(F.col("t"), both * rate) + gain(F.col("c"), both * (1 - rate))))
    kept = kept.withColumn("weight", ratio - F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) * 0.5)
    kept = kept.where((F.col("t") >= 3) & (F.col("gain") >= 2 * math.log(10 * candidates)) & (ratio > math.log(10)) & (F.col("weight") > 1))
    kept = kept.orderBy(F.col("gain").desc(), "feature").limit(most_lexemes).select("feature", "weight", "t").collect()
    seen_in = {r["feature"]: r["t"] for r in kept}
    # A beginning says no more than the one longer feature that explains nearly all of it, and meets more other words.
    implied = {f[:n] + "-" for f in seen_in for n in STEMS if n < len(f.rstrip("-")) and seen_in[f] >= 0.8 * seen_in.get(f[:n] + "-", math.inf)}
    model.lexemes = {r["feature"]: r["weight"] for r in kept if r["feature"] not in implied}

    def clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            found = [reader.clauses(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], ["toxic", "most", "total"])

    rows = sample.mapInArrow(clauses, "toxic boolean, most double, total double").collect()
    x = np.array([[1.0, r["most"], math.log1p(r["total"])] for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    # The sample has its own share of toxic documents; rows are weighted to the share that a missed one is worth.
    share = np.where(y > 0, toxic_share / max(y.sum(), 1), (1 - toxic_share) / max(len(y) - y.sum(), 1)) * len(y)
    at = np.array([-3.0, 1.0, 0.0])
    ridge = np.diag([1e-3, 0.05, 0.05]) * len(y)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (share * (q - y)) + ridge @ (at - np.array([0.0, 0.0, 0.0]))
        curve = (x * (share * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        at = at - np.clip(move, -2, 2)
        if abs(move).max() < 1e-9:
            break
    model.bias, model.most, model.total = map(float, at)
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses), one row for each row of documents (doc_id, text).

    Whole texts are read. Null and empty texts score as texts without any scoring
    clause. A null doc_id counts as the empty id for held_out. Repeated rows score
    alike; other columns are not read; an empty table gives no rows."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            found = [reader.clauses(t.as_py()) for t in batch.column(2)]
            score = pa.array([model.score(f[0], f[1]) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score, pa.array([f[2] for f in found], pa.int64())], ["doc_id", "held_out", "score", "n_clauses"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_clauses long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """documents that score below 0.7, with all their columns; one pass, nothing is joined."""
    small_batches(documents.sparkSession)
    schema = documents.schema
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            keep = [model.score(*reader.clauses(t.as_py())[:2]) < 0.7 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, schema)
