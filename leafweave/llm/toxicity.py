"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are composed. The lexicon, a letter trie, turns each word into a class: insult, threat, target,
negation, reported speech, or another word. The negation machine marks insults and threats within reach of a negation,
the report machine those after a reporting word, the target machine the ends of clauses that name a target, and the clause machine
reads what these leave and puts the clause into patterns: bare, aimed, negated or reported insult, and the same for
threats. Their composition is one deterministic machine, built once, whose clause-end arcs bear the matched patterns and
their weights. A document is scored by the arcs that its clauses take, through a logistic function: the weight of a pattern
counts log(1 + n) times for n clauses. Words outside a matched pattern weigh nothing.

Insult entries beside the seeds are learnt from labelled rows: words and word beginnings whose contexts are, beyond
chance, those of toxic documents. A context is the word before, so copies of one document count once. Pattern weights
are a ridge logistic fit drawn to the seed weights. Labels come only from rows that are not held out, and from a bounded
sample: the `sample` rows with the smallest hash of each label (ties by doc_id). What is learnt is bounded by that sample.

Defined cases: null and empty texts have no clause and the score of the intercept; very long texts are read whole, a slice
of rows at a time; a score of exactly 0.5 is toxic; without labelled rows of both kinds the seeds and seed weights score alone; rows
repeated in labels count once (toxic if any says so); rows repeated in documents are each scored; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import MADE, drop, held_out, materialise, slices, table

INSULT, THREAT, TARGET, NEGATION, REPORT = "I", "T", "Y", "N", "R"
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown idiota imbécil estúpido basura idiote imbécile stupide ordure idiotisch dumm abschaum".split(),
    THREAT: "kill murder destroy hurt beat shoot stab matar morir tuer frapper töten schlagen".split(),
    TARGET: "you your yours he she him her they them tú vosotros ellos vous toi tu ils du ihr euch dich".split(),
    NEGATION: "not no never nobody don't isn't nunca jamás ne pas jamais nicht kein keine nie".split(),
    REPORT: "said says say told claimed wrote called quoted dijo dicen dit disent sagte schrieb".split(),
}
PATTERNS = ["bare_insult", "aimed_insult", "negated_insult", "reported_insult", "bare_threat", "aimed_threat", "negated_threat", "reported_threat"]
#: Logistic weights of a clause of each pattern before any label is seen, and the intercept.
PRIOR = np.array([3.2, 4.2, 0.5, 0.5, 0.3, 3.2, 0.1, 0.3])
PRIOR_BIAS = -2.0
STEMS = (4, 5, 6)
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
REACH = 3
SAMPLE, CONTEXTS = 4000, 50_000


def lexicon(learnt: list[tuple[str, bool]]) -> tuple[dict[str, str], dict[str, str]]:
    """Word and stem transducers: input to class. learnt: (form, whether it is a stem)."""
    words = {w: k for k in (REPORT, NEGATION, TARGET, THREAT, INSULT) for w in SEEDS[k]}
    stems = {}
    for form, stem in learnt:
        (stems if stem else words).setdefault(form, INSULT)
    return words, stems


class Transducer:
    """A deterministic letter transducer: arcs[state][symbol] is (next state, output). State 0 is the start."""

    def __init__(self, arcs: list[dict]):
        self.arcs = arcs


def machine(start, symbols: str, step) -> Transducer:
    """The transducer of a step function (state, symbol) -> (state, output), its states numbered as they are found."""
    number, arcs, open_ = {start: 0}, [], [start]
    while open_:
        state = open_.pop(0)
        row = {}
        for x in symbols:
            after, y = step(state, x)
            if after not in number:
                number[after] = len(number)
                open_.append(after)
            row[x] = (number[after], y)
        arcs.append(row)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """a's outputs read by b: the product of both, as far as it is reached."""
    symbols = "".join(a.arcs[0])

    def step(state, x):
        p, y = a.arcs[state[0]][x]
        q, z = b.arcs[state[1]][y]
        return (p, q), z

    return machine((0, 0), symbols, step)


#: Another word, the end of a clause, the end of a clause with a target; a negated and a reported insult and threat.
OTHER, END, AIMED = "-", ".", "!"
NEGATED, REPORTED = {INSULT: "i", THREAT: "t"}, {INSULT: "J", THREAT: "U"}
CLASSES = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER + END


def _negation(left: int, x: str):
    if x in NEGATED:
        return max(0, left - 1), NEGATED[x] if left else x
    return (REACH if x == NEGATION else 0 if x == END else max(0, left - 1)), x


def _report(told: bool, x: str):
    return (x != END and (told or x == REPORT)), REPORTED[x] if told and x in REPORTED else x


def _target(aimed: bool, x: str):
    return (x != END and (aimed or x == TARGET)), AIMED if aimed and x == END else x


#: The gravest mention counts: a plain one before a reported before a negated one.
GRAVITY = {"i": (0, 1), "J": (0, 2), INSULT: (0, 3), "t": (1, 1), "U": (1, 2), THREAT: (1, 3)}


def _clause(best: tuple[int, int], x: str):
    if x in GRAVITY:
        k, g = GRAVITY[x]
        return tuple(max(g, v) if i == k else v for i, v in enumerate(best)), ()
    if x not in (END, AIMED):
        return best, ()
    # Patterns stand in fours: bare, aimed, negated, reported.
    return (0, 0), tuple(4 * i + ((1 if x == AIMED else 0) if v == 3 else 3 if v == 2 else 2) for i, v in enumerate(best) if v)


def clause_machine() -> Transducer:
    """Classes of words in, the patterns of each clause out, at its end."""
    negation = machine(0, CLASSES, _negation)
    read = CLASSES + "".join(NEGATED.values())
    report = machine(False, read, _report)
    read += "".join(REPORTED.values())
    target = machine(False, read, _target)
    return compose(compose(compose(negation, report), target), machine((0, 0), read + AIMED, _clause))


class Lexicon:
    """A trie of letters: a word's class stands at its end, a stem's at the letter that completes it; whole words come first, then the shortest stem."""

    def __init__(self, words: dict[str, str], stems: dict[str, str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.whole: dict[int, str] = {}
        self.begun: dict[int, str] = {}
        for forms, at in ((words, self.whole), (stems, self.begun)):
            for form, k in forms.items():
                state = 0
                for c in form:
                    if c not in self.arcs[state]:
                        self.arcs[state][c] = len(self.arcs)
                        self.arcs.append({})
                    state = self.arcs[state][c]
                at[state] = k

    def __call__(self, word: str) -> str:
        state, stem = 0, None
        for c in word:
            state = self.arcs[state].get(c, -1)
            if state < 0:
                return stem or OTHER
            stem = stem or self.begun.get(state)
        return self.whole.get(state) or stem or OTHER


class Grammar:
    """The composed machine over a lexicon; weights of the patterns stand on its clause-end arcs."""

    MEMO = 100_000

    def __init__(self, words: dict[str, str], stems: dict[str, str], weights: np.ndarray | None = None):
        self.words, self.stems = words, stems
        self.lexicon, self.machine, self.memo = Lexicon(words, stems), clause_machine(), {}
        self.weigh(np.zeros(len(PATTERNS) + 1) if weights is None else weights)

    def weigh(self, weights: np.ndarray) -> Grammar:
        """Puts weights on the arcs: each clause end bears (pattern, weight) for what it matched."""
        self.bias = float(weights[-1])
        self.ends = [tuple((p, float(weights[p])) for p in row[END][1]) for row in self.machine.arcs]
        self.next = [{x: q for x, (q, _) in row.items()} for row in self.machine.arcs]
        return self

    def tape(self, text: str) -> str:
        """The lexicon's output over a whole text."""
        memo, out = self.memo, []
        for w in TOKEN.findall(text.lower()):
            k = memo.get(w)
            if k is None:
                if len(memo) >= self.MEMO:
                    memo.clear()
                k = memo[w] = END if len(w) == 1 and w in ".!?;:\n" else self.lexicon(w)
            out.append(k)
        return "".join(out)

    def arcs(self, text: str | None):
        """The clause-end arcs that a text takes, as far as they match a pattern."""
        for clause in self.tape(text or "").split(END):
            if INSULT in clause or THREAT in clause:
                state, follow = 0, self.next
                for x in clause:
                    state = follow[state][x]
                yield self.ends[state]

    def clauses(self, text: str | None) -> np.ndarray:
        """How many clauses match each pattern."""
        out = np.zeros(len(PATTERNS))
        for arc in self.arcs(text):
            for p, _ in arc:
                out[p] += 1
        return out

    def weight(self, text: str | None) -> tuple[float, int]:
        """What a text's arcs weigh together, the n-th of a pattern as log(1 + n) - log(n), and how many match."""
        total, seen = self.bias, [0] * len(PATTERNS)
        for arc in self.arcs(text):
            for p, w in arc:
                seen[p] += 1
                total += w * math.log((1 + seen[p]) / seen[p])
        return total, sum(seen)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of matches."""
        got = [self.weight(t) for t in texts]
        return _logistic(np.array([g[0] for g in got], float)), np.array([g[1] for g in got], np.int64)

    def __getstate__(self):
        return self.words, self.stems, np.array([*self._weights(), self.bias])

    def __setstate__(self, state):
        self.__init__(*state)

    def _weights(self) -> list[float]:
        by = dict(x for end in self.ends for x in end)
        return [by[p] for p in range(len(PATTERNS))]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights of the patterns and the intercept, by Newton steps on the loss (each row at its weight) with a pull to the prior."""
    rows = np.ones(len(x)) if weights is None else weights
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(30):
        p = _logistic(x @ w)
        g = x.T @ (rows * (p - y)) + ridge * (w - prior)
        h = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)  # whole steps from afar can overshoot for good
        if np.abs(step).max() < 1e-6:
            break
    return w


def _forms(words: list[str]):
    before = "^"
    for w in words:
        if len(w) == 1 and w in ".!?;:\n":
            continue
        yield w, False, before
        for n in STEMS:
            if len(w) > n:
                yield w[:n], True, before
        before = w


def _contexts(batches):
    """Distinct (form, stem, word before) of a task's documents, as far as they fit `CONTEXTS` at a time, and whether toxic ones hold it."""
    seen: dict = {}
    for b in slices(batches, column=0):
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k in _forms(TOKEN.findall((t or "").lower())):
                seen[k] = seen.get(k, 0) | (2 if y else 1)
                if len(seen) >= CONTEXTS:
                    yield _context_batch(seen)
                    seen = {}
    if seen:
        yield _context_batch(seen)


def _context_batch(seen):
    f, s, w = zip(*seen, strict=True)
    v = list(seen.values())
    return pa.RecordBatch.from_arrays([pa.array(f), pa.array(s), pa.array(w), pa.array([bool(x & 2) for x in v]), pa.array([bool(x & 1) for x in v])], names=["form", "stem", "before", "toxic", "clean"])


def learn_insults(rows: DataFrame) -> list[tuple[str, bool]]:
    """Forms whose contexts are toxic documents' beyond chance (a G test at a level that allows for all forms tried), as many as the labelled rows bear out."""
    c = rows.select("text", "y").mapInArrow(_contexts, "form string, stem boolean, before string, toxic boolean, clean boolean")
    c = c.groupBy("form", "stem", "before").agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
    c = c.groupBy("form", "stem").agg(F.sum((F.col("toxic") & ~F.col("clean")).cast("long")).alias("p"), F.sum(F.col("clean").cast("long")).alias("n"))
    c = materialise(c, "forms")
    base = c.where("not stem").agg(F.sum("p"), F.sum("n"), F.count("*")).first()
    if not base[0] or not base[1]:
        return []
    share = base[0] / (base[0] + base[1])
    need = 2 * np.log(base[2] + 1) + 2
    p, n = F.col("p"), F.col("n")
    m = p + n
    g = 2 * (p * F.log(p / (m * share)) + F.when(n > 0, n * F.log(n / (m * (1 - share)))).otherwise(0.0))
    found = c.where(p > 0).withColumn("g", g).where((F.col("g") > float(need)) & (p >= 0.9 * m)).orderBy(F.desc("g"), "form").collect()
    # A longer form that holds nearly all of a stem's contexts says the same more exactly.
    exact = {r["form"] for r in found if r["stem"] and any(o is not r and o["form"].startswith(r["form"]) and o["p"] >= 0.9 * r["p"] for o in found)}
    found = [r for r in found if not (r["stem"] and r["form"] in exact)]
    kept = []
    for r in sorted(found, key=lambda r: (not r["stem"], len(r["form"]), r["form"])):
        if not any(s and r["form"].startswith(f) for f, s in kept):
            kept.append((r["form"], r["stem"]))
    return kept


def _features(grammar: Grammar):
    def rows(batches):
        for b in slices(batches, column=0):
            x = [grammar.clauses(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    return rows


def _learnt_from(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col(label).isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col(label) == 1).alias("y"))


def label_weights(docs: DataFrame, labels: DataFrame, label: str, y: np.ndarray) -> np.ndarray:
    """Weights of sampled rows with labels y, their mean 1: each label weighs as it does among all rows that are not held out."""
    n = docs.select("doc_id").join(_learnt_from(labels, label), "doc_id").groupBy("y").agg(F.count("*").alias("n"))
    n = {r["y"]: r["n"] for r in n.collect()}
    w = np.where(y == 1, n.get(True, 0) / max(1, (y == 1).sum()), n.get(False, 0) / max(1, (y != 1).sum()))
    return w / w.mean() if len(w) else w


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and y (boolean) of at most `most` documents of each label, those with the smallest hash; never held-out rows. The label side is that small, so it is broadcast."""
    ids = _learnt_from(labels, label)
    order = F.xxhash64(F.col("doc_id").cast("long"))
    few = [ids.where(F.col("y") == v).orderBy(order, "doc_id").limit(most) for v in (True, False)]
    few = few[0].unionByName(few[1])
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar with its weights."""
    before = len(MADE)
    rows = materialise(sample_labels(docs, labels, "toxic", sample), "sample")
    grammar = Grammar(*lexicon(learn_insults(rows)))
    got = rows.mapInArrow(_features(grammar), "x array<double>, y boolean").collect()
    drop(docs.sparkSession, MADE[before:])
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return grammar.weigh(np.append(PRIOR, PRIOR_BIAS))
    return grammar.weigh(fit_weights(np.array([r["x"] for r in got]), y, weights=label_weights(docs, labels, "toxic", y)))


def _score(grammar: Grammar):
    def rows(batches):
        for b in slices(batches):
            s, n = grammar.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "clauses"])

    return rows


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, clauses (matched) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(grammar), "doc_id long, score double, clauses long")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    at = docs.columns.index("text")

    def rows(batches):
        for b in slices(batches, column=at):
            yield b.filter(pa.array(grammar.score(b.column(at).to_pylist())[0] < threshold))

    return docs.mapInArrow(rows, docs.schema)


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
