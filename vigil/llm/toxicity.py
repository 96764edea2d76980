"""Toxicity by a subsequence string kernel and Nystroem landmarks.

Words are strings over a small alphabet (the sample's commonest characters, one
symbol for all others, word ends marked). The kernel of two words counts their
common subsequences of three symbols within :data:`SPAN` places, each weighted
DECAY to the power of the stretch it covers, normalised by the words' lengths in
that space; so an insult with letters between its own still meets the plain
one. A support vector machine is fitted on at most :data:`LANDMARKS` Nystroem
coordinates. It is trained on labelled sentences: those of clean documents are
clean, a sentence of a toxic document is toxic if its best word is; which word
that is and the machine are found in turn (multiple instances), clean words
that score highest join the next round. As every landmark is a weighted set of
subsequences, the fitted machine is one weight per subsequence, and a word's
decision is a sum of table entries: no landmark is compared at scoring time.

A sentence scores as its best word, a document by its best sentence and the
share and number of clearly toxic sentences, through a logistic curve fitted on
labelled documents that the machine has not seen.

Training reads a bounded sample of the labelled rows: the :data:`SAMPLE`
documents of each label with the least hashes of their ids, and of their
sentences :data:`SENTENCES` on average per label. It is fitted in the driver
(some ten MB). Everything else is one pass over all whole texts; the table sent
to the tasks has at most 128^3 floats.

Words are cut at white space and stripped of marks at both ends; words beyond
:data:`LONGEST` characters are scored in overlapping windows, a word with marks
inside also without them, three or more single characters in a row also joined.

Defined cases: null and empty texts, and texts without words, score as the
worst sentence possible; rows without an id are never held out and never
trained on, nor are ids whose labels contradict each other; repeated rows are
scored alike; without labelled rows of both kinds every score is the smoothed
share of toxic ones; an empty table gives an empty result; clashing names of
helper columns get underscores, carried columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, small_batches

#: Documents of each label, and sentences of each label on average, that train.
SAMPLE = 3000
SENTENCES = 25_000
#: The kernel: most places from first to last symbol, weight of a place, symbols.
SPAN = 7
DECAY = 0.7
SYMBOLS = 128
#: Characters of a word or window, and steps between windows.
LONGEST = 24
STEP = 12
#: Landmarks, clean words of a round (as many hard ones as others), rounds, weight of errors.
LANDMARKS = 320
CLEAN_WORDS = 6000
ROUNDS = 4
COST = 4.0
#: Words of a sentence at most.
SENTENCE_WORDS = 64
CUT = 0.7
#: Rows of a batch and words scored at a time, which bound a worker's memory.
ROWS_AT_ONCE = 250
WORDS_AT_ONCE = 16_384
#: Decision from which a sentence counts as toxic in a document's features.
SURE = 0.5

MARKS = ".,;:!?\"'`()[]{}<>|*#$%&~_-+=/\\"
#: Decision of a text without words.
WORST = -2.0


# Words ---------------------------------------------------------------------

class Words:
    """Words of texts: distinct strings, and per occurrence its string, its
    text and whether it ends a sentence."""

    def __init__(self, texts: pa.Array):
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        made = pc.list_flatten(cut).dictionary_encode()
        raw = made.dictionary
        ends = pc.match_substring_regex(raw, "[.!?]$").to_numpy(zero_copy_only=False)
        bare = pc.utf8_trim(raw, MARKS).dictionary_encode()
        inner = bare.indices.to_numpy(zero_copy_only=False)
        use = made.indices.to_numpy(zero_copy_only=False)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.word = inner[use].astype(np.int64) if len(use) else np.zeros(0, np.int64)
        self.strings = bare.dictionary.to_pylist()
        self.end = ends[use].astype(bool) if len(use) else np.zeros(0, bool)
        self._letters()

    def _letters(self) -> None:
        """Runs of three or more single characters count once more as a word,
        in the place of their last character."""
        single = np.array([len(s) == 1 for s in self.strings], bool)
        on = single[self.word] if len(self.word) else np.zeros(0, bool)
        same = np.zeros(len(on), bool)
        same[1:] = on[1:] & on[:-1] & (self.text[1:] == self.text[:-1])
        starts = np.flatnonzero(on & ~same)
        stops = np.flatnonzero(on & ~np.append(same[1:], False)) if len(on) else starts
        known = {}
        for a, b in zip(starts[stops - starts >= 2], stops[stops - starts >= 2]):
            joined = "".join(self.strings[w] for w in self.word[a:b + 1])
            if joined not in known:
                known[joined] = len(self.strings)
                self.strings.append(joined)
            self.word[b] = known[joined]

    def sentences(self) -> np.ndarray:
        """A running number per occurrence: a new one behind every end, at the
        next text, and after SENTENCE_WORDS words."""
        n = len(self.word)
        new = np.zeros(n, bool)
        if n:
            new[0] = True
            new[1:] = self.end[:-1] | (self.text[1:] != self.text[:-1])
            at = np.arange(n)
            since = at - np.maximum.accumulate(np.where(new, at, 0))
            new |= since % SENTENCE_WORDS == 0
        return np.cumsum(new) - 1


def _strips(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, lengths, string number) of the windows of all strings."""
    owner, parts = list(range(len(strings))), [s[:LONGEST] for s in strings]
    for i, s in enumerate(strings):
        for at in range(STEP, len(s) - LONGEST + STEP, STEP) if len(s) > LONGEST else ():
            owner.append(i)
            parts.append(s[at:at + LONGEST])
        if not s.isalpha():
            bare = "".join(c for c in s if c.isalpha())
            for at in range(0, max(1, len(bare) - LONGEST + STEP), STEP) if 2 < len(bare) < len(s) else ():
                owner.append(i)
                parts.append(bare[at:at + LONGEST])
    text = "".join(p.ljust(LONGEST, "\0") for p in parts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, LONGEST)
    return codes, np.array([len(p) for p in parts], np.int64), np.array(owner, np.int64)


# The kernel ----------------------------------------------------------------

_GAPS = [(a, a + b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_WEIGHTS = np.array([DECAY ** (last + 1) for _, last in _GAPS], np.float32)


class Alphabet:
    """Symbol 0 for any other character, 1 for both word ends, then known ones."""

    def __init__(self, known: np.ndarray):
        self.known, self.size = known, len(known) + 2

    @classmethod
    def of(cls, strings: list[str]) -> Alphabet:
        common = Counter(c for s in strings for c in s).most_common(SYMBOLS - 2)
        return cls(np.array(sorted(ord(c) for c, _ in common), np.uint32))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(codes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at + 2, 0).astype(np.int32)


def _by_length(codes: np.ndarray, lengths: np.ndarray, alphabet: Alphabet, rows: int = 4096
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, subsequence keys, their weights, kernel of each word with
    itself) for blocks of words of one length."""
    size = alphabet.size
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        if n == 0:
            continue
        ends = [(i, i + a, i + b, w) for (a, b), w in zip(_GAPS, _WEIGHTS) for i in range(n + 2 - b)]
        i, j, k = (np.array(x) for x in list(zip(*ends))[:3])
        weights = np.array([w for *_, w in ends], np.float32)
        plain = float((weights.astype(np.float64) ** 2).sum())
        for at in range(0, len(which), rows):
            part = which[at:at + rows]
            s = np.ones((len(part), n + 2), np.int32)
            s[:, 1:-1] = alphabet.symbols(codes[part, :n])
            keys = (s[:, i] * size + s[:, j]) * size + s[:, k]
            norm = np.full(len(part), plain)
            order = np.sort(keys, axis=1)
            again = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(axis=1))
            if len(again):  # equal subsequences of a word add up before they are squared
                turn = np.argsort(keys[again], axis=1, kind="stable")
                k2, w2 = np.take_along_axis(keys[again], turn, 1), weights[turn].astype(np.float64)
                start = np.ones(k2.shape, bool)
                start[:, 1:] = k2[:, 1:] != k2[:, :-1]
                sums = np.add.reduceat(w2.ravel(), np.flatnonzero(start.ravel()))
                rows_of = np.repeat(np.arange(len(again)), start.sum(axis=1))
                norm[again] = np.bincount(rows_of, sums ** 2, len(again))
            yield part, keys, weights, norm


class Landmarks:
    """Words by their subsequences: kernels of any words with each of them."""

    def __init__(self, strings: list[str], alphabet: Alphabet):
        self.alphabet, self.count = alphabet, len(strings)
        codes, lengths, owner = _strips(strings)
        first = np.unique(owner, return_index=True)[1]  # a landmark is its first window
        cells = []
        for part, keys, weights, norm in _by_length(codes[first], lengths[first], alphabet):
            cells.append((keys.ravel(), np.repeat(part, keys.shape[1]),
                          (weights[None, :] / np.sqrt(norm)[:, None]).ravel()))
        keys, marks, values = (np.concatenate(x) for x in zip(*cells))
        self.keys, rows = np.unique(keys, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, self.count), np.float32)
        np.add.at(self.table, (rows, marks), values)
        self.row = np.full(alphabet.size ** 3, len(self.keys), np.int32)
        self.row[self.keys] = np.arange(len(self.keys))

    def kernels(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lengths), self.count), np.float32)
        for part, keys, weights, norm in _by_length(codes, lengths, self.alphabet, 1024):
            total = np.zeros((len(part), self.count), np.float32)
            for at, w in enumerate(weights):
                total += w * self.table[self.row[keys[:, at]]]
            out[part] = total / np.sqrt(norm)[:, None]
        return out


class Machine:
    """A fitted machine: one weight per subsequence."""

    def __init__(self, alphabet: Alphabet, weights: np.ndarray, bias: float):
        self.alphabet, self.weights, self.bias = alphabet, weights, bias

    def decisions(self, strings: list[str]) -> np.ndarray:
        """One per string, that of its best window; WORST for empty ones."""
        out = np.full(len(strings), WORST)
        for at in range(0, len(strings), WORDS_AT_ONCE):
            codes, lengths, owner = _strips(strings[at:at + WORDS_AT_ONCE])
            each = np.full(len(lengths), WORST)
            for part, keys, weights, norm in _by_length(codes, lengths, self.alphabet, 512):
                each[part] = np.maximum((self.weights[keys] * weights).sum(axis=1) / np.sqrt(norm) + self.bias, WORST)
            np.maximum.at(out[at:at + WORDS_AT_ONCE], owner, each)
        return out


# Training ------------------------------------------------------------------

def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; last weight is the bias."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)

    def loss(w):
        return 0.5 * (ridge * w * w).sum() + COST * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(60):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = ridge * w - 2 * COST * x[on].T @ (weight[on] * y[on] * gap[on])
        if np.abs(grad).max() < 1e-6 * max(1.0, COST * weight.sum()):
            break
        step = np.linalg.solve(np.diag(ridge) + 2 * COST * (x[on].T * weight[on]) @ x[on], grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w


def _spread(kernel: np.ndarray, most: int) -> list[int]:
    """Landmarks by pivoted Cholesky: each the word the others explain least."""
    left, chosen = np.diag(kernel).astype(np.float64).copy(), []
    factor = np.zeros((len(kernel), min(most, len(kernel))))
    for r in range(factor.shape[1]):
        p = int(np.argmax(left))
        if left[p] < 1e-3:
            break
        factor[:, r] = (kernel[:, p] - factor[:, :r] @ factor[p, :r]) / np.sqrt(left[p])
        left = np.maximum(left - factor[:, r] ** 2, 0)
        left[p] = 0
        chosen.append(p)
    return chosen


def _first_guess(strings: list[str], hits: np.ndarray, misses: np.ndarray, share: float) -> np.ndarray:
    """Log odds of a word's most telling run of five symbols, by documents."""
    up, down = Counter(), Counter()
    runs = []
    for s, a, b in zip(strings, hits.tolist(), misses.tolist()):
        s = f"^{s}$"
        mine = {s[i:i + 5] for i in range(max(1, len(s) - 4))}
        runs.append(mine)
        for g in mine:
            up[g] += a
            down[g] += b
    prior = 10.0
    odds = np.log(share / (1 - share))
    return np.array([max(np.log((up[g] + prior * share) / (down[g] + prior * (1 - share))) - odds for g in mine)
                     for mine in runs])


def _window(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and lengths of each word's first window."""
    codes, lengths, owner = _strips(strings)
    first = np.unique(owner, return_index=True)[1]
    return codes[first], lengths[first]


def _fit(alphabet: Alphabet, toxic: list[str], hits: np.ndarray, clean: list[str], misses: np.ndarray) -> Machine:
    """A machine between toxic words, most frequent first, and clean ones, hardest
    first, with the numbers of documents that have them."""
    some = toxic[:LANDMARKS] + clean[:LANDMARKS // 2] + clean[-LANDMARKS // 2:]
    chosen = _spread(Landmarks(some, alphabet).kernels(*_window(some)), LANDMARKS)
    names = [some[i] for i in chosen]
    marks = Landmarks(names, alphabet)
    values, vectors = np.linalg.eigh(marks.kernels(*_window(names)).astype(np.float64))
    half = vectors / np.sqrt(np.maximum(values, 1e-3))
    y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
    weight = np.append(hits * (0.3 * len(clean) / hits.sum()), misses)
    w = _machine(marks.kernels(*_window(toxic + clean)) @ half, y, weight)
    per_key = np.zeros(alphabet.size ** 3, np.float32)
    per_key[marks.keys] = marks.table[:-1] @ (half @ w[:-1]).astype(np.float32)
    return Machine(alphabet, per_key, float(w[-1]))


def train(sentences: pa.Table) -> Machine | None:
    """Fits the machine on labelled sentences (doc, toxic, words: a list).

    Two halves of the documents choose each other's witnesses, so that no word
    is taken for toxic because its own machine was fitted on it."""
    sentences = sentences.filter(pc.greater(pc.list_value_length(sentences["words"]), 0)).combine_chunks()
    doc = pd.factorize(sentences["doc"].to_numpy())[0]
    toxic = sentences["toxic"].to_numpy().astype(bool)
    kinds = np.zeros(doc.max(initial=-1) + 1, bool)
    kinds[doc] = toxic
    if not kinds.any() or kinds.all():
        return None
    share = float(kinds.mean())
    coded = pc.list_flatten(sentences["words"]).combine_chunks().dictionary_encode()
    strings = coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(doc)), pc.list_value_length(sentences["words"]).to_numpy())
    rows = pd.DataFrame({"w": coded.indices.to_numpy(), "s": of.astype(np.int32), "d": doc[of].astype(np.int32),
                         "toxic": toxic[of]}).drop_duplicates(["w", "s"])
    seen = rows.drop_duplicates(["w", "d"])
    alphabet = Alphabet.of(strings)
    rng = np.random.default_rng(7)
    whole = np.array([len(s) > 0 for s in strings])

    def counted(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = seen[half[seen["d"]]]
        return (np.bincount(part["w"], part["toxic"], len(strings)),
                np.bincount(part["w"], ~part["toxic"], len(strings)))

    def machine(half: np.ndarray, score: np.ndarray, first: bool) -> Machine | None:
        """From a half's witnesses under the other half's scores."""
        hits, misses = counted(half)
        best = rows[rows["toxic"] & half[rows["d"]]].assign(f=lambda r: score[r["w"]])
        best = best.sort_values(["f", "w"], ascending=[False, True]).drop_duplicates("s")
        taken = pd.concat([best[best["f"] >= (1.0 if first else 0.0)], best.drop_duplicates("d")[:len(best) * first]])
        found = taken.drop_duplicates(["d", "w"])["w"].value_counts()
        found = found[whole[found.index] & (hits[found.index] > 4 * misses[found.index] * share / (1 - share))]
        clean = np.setdiff1d(np.flatnonzero((misses > 0) & whole), found.index)
        if not len(found) or not len(clean):
            return None
        hard = clean[np.argsort(-score[clean], kind="stable")[:CLEAN_WORDS]]
        rest = np.setdiff1d(clean, hard)
        clean = np.append(hard, rng.choice(rest, min(len(rest), CLEAN_WORDS), replace=False))
        return _fit(alphabet, [strings[i] for i in found.index], found.to_numpy().astype(np.float64),
                    [strings[i] for i in clean], misses[clean])

    everyone = np.ones(len(kinds), bool)
    halves = [np.arange(len(kinds)) % 2 == 0, np.arange(len(kinds)) % 2 == 1]
    scores = [_first_guess(strings, *counted(h), share) for h in halves]
    for turn in range(ROUNDS):
        made = [machine(h, scores[1 - i], turn == 0) for i, h in enumerate(halves)]
        if None in made:
            break
        scores = [m.decisions(strings) for m in made]
    return machine(everyone, (scores[0] + scores[1]) / 2, turn == 0)


# Documents -----------------------------------------------------------------

def features(texts: pa.Array, machine: Machine) -> np.ndarray:
    """Per text: decision of its best sentence, share of sentences above SURE,
    logarithm of one more than their number."""
    words = Words(texts)
    n = len(texts)
    out = np.column_stack([np.full(n, WORST), np.zeros(n), np.zeros(n)])
    if len(words.word):
        of = words.sentences()
        score = np.full(of[-1] + 1, WORST)
        np.maximum.at(score, of, machine.decisions(words.strings)[words.word])
        text = np.zeros(len(score), np.int64)
        text[of] = words.text
        np.maximum.at(out[:, 0], text, score)
        above = np.bincount(text, score > SURE, n)
        out[:, 1] = above / np.maximum(1, np.bincount(text, minlength=n))
        out[:, 2] = np.log1p(above)
    return out


class Scorer:
    """A machine with the logistic curve over a document's features, or the
    share of toxic rows where nothing could be learnt."""

    def __init__(self, machine: Machine | None, curve: np.ndarray, share: float):
        self.machine, self.curve, self.share = machine, curve, share

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.machine is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(features(texts, self.machine) @ self.curve[:-1] + self.curve[-1], -50, 50)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a light ridge, by Newton steps; the bias last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 0.05), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(ridge),
                               x.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Scorer:
    """A scorer from the labelled rows that are not held out. A quarter of the
    sampled documents, by hash of the id, sets the curve, the others train the
    machine. Of rows that repeat an id the least text counts."""
    spark = docs.sparkSession
    small_batches(spark, ROWS_AT_ONCE)
    known = (labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
             .groupBy(id).agg(F.min(label).alias("low"), F.max(label).alias("high"))
             .where("low = high").select(F.col(id).alias("doc"), (F.col("low") == 1).alias("toxic"),
                                         F.xxhash64(F.col(id).cast("string")).alias("h")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(True, 0) + 1) / (sum(counts.values()) + 2)
    ids = [r for kind in (True, False) for r in known.where(F.col("toxic") == kind).orderBy("h", "doc")
           .limit(SAMPLE).collect()]
    if not all(counts.get(k) for k in (True, False)):
        return Scorer(None, np.zeros(4), share)
    sample = spark.createDataFrame(ids, known.schema)
    texts = (docs.select(F.col(id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(sample), "doc")
             .groupBy("doc", "toxic", "h").agg(F.min("text").alias("text")))
    texts = materialise(texts.select("doc", "toxic", (F.pmod("h", F.lit(4)) == 0).alias("judge"), "text"), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            of = words.sentences()
            first = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).astype(np.int32)
            rows = pa.array(words.text[first[:-1]])
            spoken = pa.array(words.strings, pa.string()).take(pa.array(words.word))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(first), spoken)],
                ["doc", "toxic", "words"])

    kind = known.schema["doc"].dataType.simpleString()
    told = materialise(texts.where("NOT judge").select("doc", "toxic", "text").mapInArrow(
        cut, f"doc {kind}, toxic boolean, words array<string>"), "sentences")
    number = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc", "words"), F.lit(1 << 20)) / float(1 << 20)
    keep = [(F.col("toxic") == k) & (part < SENTENCES / n) for k, n in number.items()]
    machine = train(told.where(keep[0] if len(keep) == 1 else keep[0] | keep[1]).orderBy("doc", "words").toArrow()) \
        if keep else None
    if machine is None:
        return Scorer(None, np.zeros(4), share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = sent.value  # plain arrays: tasks need no copy of this module
        fitted = Machine(Alphabet(known), weights, bias)
        for batch in batches:
            x = features(batch.column(2), fitted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(3))],
                ["judge", "toxic", "best", "share", "many"])

    sent = spark.sparkContext.broadcast((machine.alphabet.known, machine.weights, machine.bias))
    seen = texts.select("judge", "toxic", "text").mapInArrow(
        measure, "judge boolean, toxic boolean, best double, share double, many double").toPandas()
    judged = seen[seen["judge"]]
    judged = judged if judged["toxic"].nunique() == 2 else seen
    # the labels weigh as in all labelled rows, not as in the sample
    y = judged["toxic"].to_numpy(bool)
    weight = np.where(y, counts[True] / y.sum(), counts[False] / (~y).sum()) * len(y) / sum(counts.values())
    x = judged[["best", "share", "many"]].to_numpy(np.float64)
    return Scorer(machine, _curve(x, y.astype(np.float64), weight), share)


def score_texts(docs: DataFrame, scorer: Scorer, id: str = "doc_id", text: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with held_out, score, predicted."""
    small_batches(docs.sparkSession, ROWS_AT_ONCE)
    carry = docs.columns if carry is None else carry
    names = [free_name(carry, n) for n in ("held_out", "score", "predicted")]
    ready = docs.select(*carry, held_out(F.col(id)).alias(names[0]), F.col(text).alias(free_name(carry, "x_text")))
    fitted = scorer.machine
    sent = docs.sparkSession.sparkContext.broadcast(
        (fitted and (fitted.alphabet.known, fitted.weights, fitted.bias), scorer.curve, scorer.share))
    kept = len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, curve, share = sent.value
        mine = Scorer(parts and Machine(Alphabet(parts[0]), *parts[1:]), curve, share)
        for batch in batches:
            score = mine.scores(batch.column(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                [*batch.schema.names[:kept], *names[1:]])

    schema = ready.select(*ready.columns[:kept]).schema.add(names[1], "double").add(names[2], "integer")
    return ready.mapInArrow(run, schema)
