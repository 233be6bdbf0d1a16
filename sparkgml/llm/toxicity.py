"""Toxicity by a weighted finite-state grammar over the clauses of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices
from .labelled import fit_dense, sample_labelled, sigmoid

#: Words that each transducer knows before anything is learned.
INSULTS = frozenset("idiot idiots moron morons stupid pathetic scum trash worthless loser losers clown clowns disgusting imbecile imbeciles vermin filth idiota imbécil estúpido basura escoria dummkopf abschaum widerlich wertlos imbécile stupide ordure pathétique".split())
THREATS = frozenset("kill hurt destroy beat punish strangle shoot stab matar mataré töten umbringen tuer tuerai".split())
TARGETS = frozenset("you your yours u she he they them him her those these people everyone du ihr sie dich euch tú usted ustedes vosotros tu vous ils elles".split())
NEGATIONS = frozenset("not never no nobody isn't aren't wasn't don't doesn't ain't nicht kein keine nie nunca jamás pas jamais".split())
REPORTS = frozenset("said says say called calls wrote writes quoted quotes claimed claims reported reports accused alleges sagte nannte schrieb dijo llamó escribió dit appelé écrit".split())

#: A word with inner apostrophes, marks that end a clause or a line, or a quotation mark; one after a digit is an inch.
TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:]+|\n|(?<!\d)[\"“”«»„]")
#: Prefixes of words that may be learned, in letters, and how often one must stand in a text to count.
STEMS, NEEDS = (8, 7, 6, 5, 4), (1, 2, 3)

# Tape symbols after the lexicon: insult, threat, target, negation, report, clause end, quotation mark, other word, line end.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP, QUOTE, LINE = range(9)
#: How a matched clause counts: aimed insult, bare insult, threat, and each of these negated or reported.
AIMED, BARE, MENACE, DENIED, QUOTED = range(5)
#: Words that negation and target reach over.
REACH = 4
#: What a path pays for an insult or threat that no target is found for.
UNAIMED = 1.0
#: Weights of the outcomes and the intercept that fitting starts from and is drawn to; one bare insult is below one half, two are above.
PRIOR = np.array([8.0, 4.5, 8.0, 1.5, 1.5, -4.0])

# Weighted transducers: a state and a symbol give arcs (next state, mark, cost). The mark says what a machine thinks of
# an insult or threat; a path is only good if every machine ends in a final state.


def negation_arcs(left: int, symbol: int) -> list[tuple[int, bool, float]]:
    """State: the words that a negation still reaches over. Mark: negated."""
    after = REACH if symbol == NEGATION else 0 if symbol == STOP else max(0, left - 1)
    return [(after, left > 0, 0.0)]


def report_arcs(state: int, symbol: int) -> list[tuple[int, bool, float]]:
    """States: 0 plain, 1 after a reporting verb to the end of its clause, 2 within a quotation. Mark: reported."""
    if symbol == QUOTE:
        after = 0 if state == 2 else 2
    elif state == 2:
        after = 2
    else:
        after = 0 if symbol == STOP else 1 if symbol == REPORT else state
    return [(after, state > 0, 0.0)]


def target_arcs(state: tuple[int, int], symbol: int) -> list[tuple[tuple[int, int], bool, float]]:
    """State: words that a target still reaches over, and words within which a promised one must come. Mark: aimed.

    At an insult or threat without a target before it, one path pays, another
    promises a target; a promise that isn't kept within its clause is a dead end.
    """
    left, due = state
    if symbol == TARGET:
        return [((REACH, 0), True, 0.0)]
    if symbol == STOP:
        return [((0, 0), False, 0.0)] if not due else []
    later = due - 1
    if due and not later:
        return []
    after = max(0, left - 1)
    if symbol not in (INSULT, THREAT) or left:
        return [((after, later if due else 0), left > 0, 0.0)]
    return [((after, later if due else 0), False, UNAIMED), ((after, min(later, REACH) if due else REACH), True, 0.0)]


MACHINES = ((negation_arcs, 0), (report_arcs, 0), (target_arcs, (0, 0)))


@cache
def composed(state: tuple, symbol: int) -> list[tuple[tuple, tuple[bool, ...], float]]:
    """Arcs of the composition: one of each machine, costs added."""
    out = []
    for arcs in product(*(machine(s, symbol) for (machine, _), s in zip(MACHINES, state, strict=True))):
        out.append((tuple(a[0] for a in arcs), tuple(a[1] for a in arcs), sum(a[2] for a in arcs)))
    return out


def outcome_of(symbol: int, marks: tuple[bool, ...]) -> int | None:
    denied, speech, aimed = marks
    if symbol not in (INSULT, THREAT) or symbol == THREAT and not aimed:
        return None  # a threat needs a target
    return QUOTED if speech else DENIED if denied else MENACE if symbol == THREAT else AIMED if aimed else BARE


def paired(symbols: list[int]) -> list[int]:
    """Quotation marks without a partner in their line are ordinary symbols."""
    out, open_ = list(symbols), None
    for i, s in enumerate(symbols):
        if s == LINE and open_ is not None:
            out[open_], open_ = OTHER, None
        elif s == QUOTE:
            open_ = i if open_ is None else None
    if open_ is not None:
        out[open_] = OTHER
    return out


def outcomes(symbols: list[int]) -> list[tuple[int, int]]:
    """(position, outcome) of each insult or threat on the cheapest path through the composed machines, line by line."""
    out, start = [], 0
    symbols = paired(symbols)
    ends = [i for i, s in enumerate(symbols) if s == LINE]
    for stop in [*ends, len(symbols)]:
        line = symbols[start:stop]
        if INSULT in line or THREAT in line:
            out += [(start + i, k) for i, k in cheapest(line)]
        start = stop + 1
    return out


def cheapest(line: list[int]) -> list[tuple[int, int]]:
    """Best path: for each reachable state of the composition the least cost, and what it has met; ties go to the path found first."""
    front: dict[tuple, tuple[float, tuple | None]] = {tuple(s for _, s in MACHINES): (0.0, None)}
    for i, symbol in enumerate([*line, STOP]):
        after: dict[tuple, tuple[float, tuple | None]] = {}
        for state, (cost, met) in front.items():
            for new, marks, more in composed(state, symbol):
                if new not in after or cost + more < after[new][0]:
                    k = outcome_of(symbol, marks)
                    after[new] = (cost + more, met if k is None else (met, i, k))
        front = after
    _, met = min(front.values(), key=lambda x: x[0])
    out = []
    while met is not None:
        met, i, k = met
        out.append((i, k))
    return out[::-1]


@dataclass
class ToxicityGrammar:
    """The lexicon with learned insults and stems, and the weight of each outcome and of the intercept."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    stems: dict[str, tuple[float, int]] = field(default_factory=dict)  # weight, and how often a text must have it
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self):
        self.memo: dict[str, tuple[int, float, str | None]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def symbol(self, token: str) -> tuple[int, float, str | None]:
        """The lexicon transducer: tape symbol and weight of a lower-cased token, and the stem by which it is known."""
        if token in self.words:
            return INSULT, self.words[token], None
        for n in STEMS:
            if len(token) >= n and token[:n] in self.stems:
                return INSULT, self.stems[token[:n]][0], token[:n]
        for known, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if token in known:
                return s, 1.0, None
        if token == "\n":
            return LINE, 0.0, None
        if token[0] in ".!?;:":
            return STOP, 0.0, None
        return QUOTE if token in "\"“”«»„" else OTHER, 0.0, None

    def features(self, text: str) -> np.ndarray:
        """For each outcome log(1 + weight of its matches)."""
        tokens, memo = TOKENS.findall(text.lower()), self.memo
        if len(memo) > 400_000:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = self.symbol(t)
        tape = [memo[t] for t in tokens]
        out = np.zeros(len(PRIOR) - 1)
        symbols = [x[0] for x in tape]
        if INSULT in symbols or THREAT in symbols:
            often = Counter(stem for _, _, stem in tape if stem)
            symbols = [OTHER if stem and often[stem] < self.stems[stem][1] else s for s, _, stem in tape]
            for i, what in outcomes(symbols):
                out[what] += tape[i][1]
        return np.log1p(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(PRIOR) - 1)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def atoms(text: str) -> set[str]:
    """What may be learned from a text: =word, and n^stem for stems that stand in it n times or more."""
    words = [w for w in TOKENS.findall(text.lower()) if w[0].isalpha()]
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) >= n)
    return {f"={w}" for w in words} | {f"{k}^{stem}" for stem, n in stems.items() for k in NEEDS if n >= k}


def learn_insults(toxic: list[str], clean: list[str], known: frozenset[str] = INSULTS, *, least: int = 3, odds: float = 80.0) -> list[tuple[str, float]]:
    """Words and stems that tell toxic texts apart, chosen greedily by the toxic texts that no earlier choice covers.

    Copies of a text count once; `known` words cover their texts before any
    choice, and a chosen word covers its own afterwards, so that what only
    happens to stand in the same texts as an insult isn't learned. A
    candidate is in `least` toxic texts and has `odds` to 1 against clean
    ones; each clean text that has it weighs as two toxic ones less.
    """
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    if not toxic or not clean:
        return []
    # a table of fixed size says which of the many candidates can be frequent; only those are kept as strings
    sketch = np.zeros(1 << 22, np.int32)
    for t in toxic:
        sketch[np.unique([hash(a) & len(sketch) - 1 for a in atoms(t)]).astype(np.int64)] += 1
    where: dict[str, list[int]] = {}
    for i, t in enumerate(toxic):
        for a in atoms(t):
            if sketch[hash(a) & len(sketch) - 1] >= least:
                where.setdefault(a, []).append(i)
    where = {a: w for a, w in where.items() if len(w) >= least}
    seen = Counter(a for t in clean for a in atoms(t) if a in where)
    ratio = {a: len(w) / len(toxic) / ((seen[a] + 0.5) / len(clean)) for a, w in where.items()}
    where = {a: w for a, w in where.items() if ratio[a] >= odds or (seen[a] == 0 and len(w) >= 4 * least)}
    covered, chosen = np.zeros(len(toxic), bool), []
    for word in known:
        covered[where.get(f"={word}", [])] = True
    gain = {a: len(w) - 2 * seen[a] for a, w in where.items()}
    while gain:
        a = max(gain, key=lambda k: (gain[k], len(k), k[0] == "=", k))
        fresh = int((~covered[where[a]]).sum()) - 2 * seen[a]
        if fresh < gain[a]:  # counted before other choices
            gain[a] = fresh
            if fresh < least:
                del gain[a]
            continue
        if fresh < least:
            break
        covered[where[a]] = True
        chosen.append((a, min(2.0, max(0.5, float(np.log(ratio[a])) / 4))))
        del gain[a]
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, max_bytes: int = 32 << 20) -> ToxicityGrammar:
    """Learn insults and weights from about `per_class` labelled rows at most of each class, of about `max_bytes` together; rows without label, doc_id or text aren't used, and without rows of both classes the known words alone count."""
    rows = sample_labelled(docs, labels, "toxic", per_class, max_bytes)
    toxic, clean = ([t for _, t, y in rows if y == k] for k in (1, 0))
    grammar = ToxicityGrammar()
    for atom, weight in learn_insults(toxic, clean):
        if atom[0] == "=":
            grammar.words[atom[1:]] = weight
        else:
            grammar.stems.setdefault(atom[2:], (weight, int(atom[0])))
    if toxic and clean:
        x = np.array([grammar.features(t) for t in toxic + clean])
        y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
        grammar.weights = w = fit_dense(x, y, PRIOR, 3.0)
        # a single insult word that nothing in its clause supports stays below one half
        w[BARE] = min(w[BARE], (-w[-1] - 0.2) / np.log1p(1.0))
    return grammar


def toxicity(docs: DataFrame, grammar: ToxicityGrammar, *, threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, score, predicted.

    Tokens become symbols of insult, threat, target, negation, reported
    speech, clause end and line end. Weighted transducers for target, negation
    and report are composed; on the cheapest path through a line they say at
    each insult or threat whether it is aimed, negated or reported, which
    decides how its weight counts. A logistic function of the sums gives the
    score: an insult word by itself stays below one half, with a target in its
    clause, or with others, it doesn't. Quotation marks count in pairs within
    a line. A null or empty text matches nothing. Other columns are ignored,
    repeated rows have equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def work(batches: Iterator[pa.RecordBatch]):
        grammar = shared.value
        for batch in slices(batches, "text"):
            score = grammar.scores([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    frugal(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double, predicted int")
