"""Toxicity: a learnt lexicon as a trie, intersected with Levenshtein automata, and context windows around what it matches.

Learning, from at most SAMPLE labelled rows: words and word stems that stand in many different surroundings in toxic
documents and in hardly any of the others become terms. Surroundings are counted, not occurrences, so that copies of a
document don't make terms of its other words. Whole words of some length may be misspelled by one edit, unless what is one edit
away from them stands in documents that aren't toxic; stems are met exactly.

Matching: the automaton of all terms at once, its states sets of (trie node, edits so far), made deterministic as words need
it and kept for all further words; a word costs one step for each character until its state is dead.

Context: a match inside quotation marks or close to a word of reporting counts as quoted, any other as abuse. A logistic
regression on counts of exact, misspelled and quoted matches gives the score.

Defined cases: null texts count as empty; empty texts are scored like any text without a match; repeated rows are scored each;
rows without an id are scored, neither learnt from nor held out; without labels of both kinds the score is the base rate; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import FOLDS, Model, fit, labelled_sample, sigmoid
from .shared import cut

SAMPLE, LEAST_SURROUNDINGS, LEAST_SHARE = 12_000, 8, 0.9
FUZZY_LENGTH = 5  # letters from which on a term may be misspelled
STEMS = range(4, 9)
NEAR = 6  # words to either side that are a match's context
WORD = re.compile(r"[^\W\d_]+")
# Quotation marks and words of reporting.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says quote quoted quotes wrote called reported sagte sagt schrieb zitat nannte dit disait cité écrit dijo dice citó escribió llamó".split())


class Automaton:
    """Words to the best term they match: (term, edits), or None. terms: text to (most edits, whether it is a stem)."""

    def __init__(self, terms: dict[str, tuple[int, bool]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int, bool] | None] = [None]
        self.reach = [0]  # most edits of any term below
        for term, (edits, stem) in terms.items():
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node] = (term, edits, stem)
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.index: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, str] | None] = []  # best end of a word here
        self.open: list[tuple[int, str] | None] = []  # best stem met here
        self.start = self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """The state's number; missing characters are closed over. Dead: -1."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if e > reached.get(node, 99):
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, *self.ends[n][:1]) for n, e in key if self.ends[n] and not self.ends[n][2] and e <= self.ends[n][1]]
            stems = [(e, *self.ends[n][:1]) for n, e in key if self.ends[n] and self.ends[n][2] and e <= self.ends[n][1]]
            self.whole.append(min(ends, default=None))
            self.open.append(min(stems, default=None))
        return self.index[key]

    def step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.reach[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.states[state]:
            if c in self.children[node]:
                reach(self.children[node][c], e)
            reach(node, e + 1)  # c is one character too many
            for child in self.children[node].values():
                reach(child, e + 1)  # c stands for another
        return self.state(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        state, best = self.start, None
        for c in word:
            known = self.steps[state]
            if c not in known:
                known[c] = self.step(state, c)
            state = known[c]
            if state < 0:
                break
            if self.open[state] and (best is None or self.open[state] < best):
                best = self.open[state]
        else:
            if self.whole[state] and (best is None or self.whole[state] < best):
                best = self.whole[state]
        return (best[1], best[0]) if best else None


def surroundings(text: str, wanted: dict | None = None) -> set[tuple[str, int]]:
    """(term, surroundings) for the words of a text and their stems ("stem*"): a checksum of the words before and after."""
    words = WORD.findall(text.lower())
    out = set()
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        names = [w, *[w[:k] + "*" for k in STEMS if k < len(w)]]
        if wanted is not None:
            names = [x for x in names if x in wanted]
        if names:
            around = zlib.crc32(f"{before} {after}".encode())
            out.update((x, around) for x in names)
    return out


def learn_terms(texts: DataFrame) -> dict[str, tuple[int, bool]]:
    """Terms from a bounded sample (text, label)."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set = set()
            for t in batch.column(0):
                found |= surroundings(t.as_py())
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.int64())], names=["term", "around"])

    toxic = texts.where("label = 1").select("text").mapInArrow(all_of, "term string, around long").distinct().groupBy("term").count()
    toxic = toxic.where(F.col("count") >= LEAST_SURROUNDINGS)
    support = {r["term"]: r["count"] for r in toxic.collect()}  # bounded by the sample

    def some_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0):
                counts.update(x for x, _ in surroundings(t.as_py(), support))
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    clean = texts.where("label = 0").select("text").mapInArrow(some_of, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    against = {r["term"]: r["n"] for r in clean.collect()}
    good = {t: n for t, n in support.items() if n / (n + against.get(t, 0)) >= LEAST_SHARE}
    stems: set[str] = set()
    for t in sorted((t[:-1] for t in good if t.endswith("*")), key=len):  # the shortest stem that will do
        if not any(t[:k] in stems for k in STEMS):
            stems.add(t)
    terms = {t: (0, True) for t in stems}
    terms |= {t: (1 if len(t) >= FUZZY_LENGTH else 0, False) for t in good if not t.endswith("*")}

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(terms), {}
        for batch in batches:
            counts: Counter = Counter()
            for t, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in set(WORD.findall(t.as_py().lower())):
                    if w not in seen:
                        seen[w] = automaton.match(w)
                    if seen[w] and seen[w][1]:
                        counts[seen[w][0], label] += 1
            yield pa.record_batch([pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "label", "n"])

    near = texts.mapInArrow(misspelled, "term string, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n")).collect()  # two rows a term
    n = {(r["term"], r["label"]): r["n"] for r in near}
    for t in {t for t, label in n if not label}:
        if n.get((t, 1), 0) < LEAST_SHARE * (n.get((t, 1), 0) + n[t, 0]):
            terms[t] = (0, False)
    return terms


def quoted_places(text: str) -> list[bool] | None:
    """For each character whether it stands between quotation marks, or None where there are no marks."""
    if not any(q in text for q in QUOTES):
        return None
    inside, out = False, []
    for c in text:
        if c in "“„«‹":
            inside = True
        elif c in "”»›":
            inside = False
        elif c == '"' or c == "\n":
            inside = not inside and c == '"'
        out.append(inside)
    return out


def measure(text: str | None, automaton: Automaton, seen: dict[str, tuple[str, int] | None]) -> list[float]:
    """Counts of exact, misspelled and quoted matches, the matches' share of the words, and different terms. seen: matches of words so far."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = []
    for i, w in enumerate(words):
        if w not in seen:
            if len(seen) > 2_000_000:
                seen.clear()
            seen[w] = automaton.match(w)
        if seen[w]:
            hits.append((i, seen[w]))
    if not hits:
        return [0.0, 0.0, 0.0, 0.0, 0.0]
    inside = quoted_places(low)
    starts = [m.start() for m in WORD.finditer(low)] if inside else None
    exact = fuzzy = quoted = 0
    for i, (_, edits) in hits:
        reported = inside is not None and inside[starts[i]] or not REPORTING.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])
        quoted, exact, fuzzy = quoted + reported, exact + (not reported and not edits), fuzzy + (not reported and edits > 0)
    return [exact, fuzzy, quoted, len(hits) / len(words), len({t for _, (t, _) in hits})]


def over(texts: Iterable[str | None], automaton: Automaton, seen: dict) -> np.ndarray:
    """measure() of each text, on a scale where a count's first steps weigh most."""
    return np.log1p(np.array([measure(t, automaton, seen) for t in texts], dtype=np.float64).reshape(-1, 5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, tuple[int, bool]], Model]:
    rows, _ = cut(labelled_sample(docs, labels, label, sample, id_col, text_col), "labelled")
    terms = learn_terms(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(terms), {}
        for batch in batches:
            x = over((t.as_py() for t in batch.column(0)), automaton, seen)
            yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").collect()
    return terms, fit(np.array([r["x"] for r in got]).reshape(-1, 5), np.array([r["y"] for r in got], dtype=np.float64))


def score(docs: DataFrame, terms: dict[str, tuple[int, bool]], model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(terms), {}
        for batch in batches:
            p = sigmoid(model.logits(over((t.as_py() for t in batch.column(1)), automaton, seen)))
            held = pa.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in batch.column(0).to_pylist()], pa.bool_())
            yield pa.record_batch([batch.column(0), held, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    terms, model = train(docs, labels, id_col, text_col)
    return score(docs, terms, model, id_col, text_col)
