"""Toxicity of texts: a support vector machine over a subsequence kernel with Nyström landmarks.

Two sentences are alike in the subsequences of four characters they share. A subsequence may skip
characters: an occurrence that spans s characters counts DECAY^(s - 4), up to spans of SPAN. Letters lose case and
accents, white space is a character of its own, digits and marks only widen the span. So ``i.d.i-o.t``
or ``idXiot`` still share most subsequences with ``idiot``.

Landmarks are words of a bounded sample of labelled rows. Stretches of sentences are mapped to the Nyström features
K(x, landmarks) K(landmarks, landmarks)^(-1/2), a linear SVM is trained there, and since the kernel is an inner product
of subsequence counts, the trained function is a sum of one weight per subsequence. Scoring looks these weights up,
so a text costs the same however many landmarks there are. A sentence counts by its highest stretch of WINDOW
characters, so long sentences add up no more noise than short ones. Labels belong to rows: a row is toxic if one of its sentences
is, so training alternates between the SVM and the choice of the toxic sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

LENGTH, SPAN, DECAY = 4, 7, 0.6
#: A character has five bits: 0 only widens spans, 1 is white space, the others are letters.
BITS, SPACE, FIRST_LETTER = 5, 1, 2
LETTERS = (1 << BITS) - FIRST_LETTER
TABLE = 1 << BITS * LENGTH
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
#: A word said several times in a row counts once.
REPEATED = re.compile(r"(?<!\S)(\S+)(?:\s+\1(?!\S))+")
#: A sentence counts by its highest window: subsequences that start within WINDOW characters, every STEP ones.
WINDOW, STEP = 32, 8
#: Long sentences are read in pieces of this many characters, which overlap by more than a window.
PIECE, OVERLAP = 4096, WINDOW + STEP + SPAN
PAD = "\0" * (SPAN - 1)
#: Sentences are scored together up to about this many characters.
BLOCK = 1 << 16

#: Training takes at most this many rows a label, of at most ROW_CHARS characters each and CLASS_CHARS together.
TOXIC_ROWS, CLEAN_ROWS, ROW_CHARS, CLASS_CHARS = 600, 1200, 200_000, 4_000_000
#: Landmarks, rounds of choosing sentences and training, and the cost of errors against the margin.
LANDMARKS, ROUNDS, PENALTY = 192, 6, 100.0
#: Windows of clean rows in training: a first draw, then the highest-scoring ones of each round.
CLEAN_WINDOWS, HARD_WINDOWS = 6000, 2000


def folded(code: int) -> int:
    return ord(unicodedata.normalize("NFD", chr(code))[0].lower()[0])


class Alphabet:
    """Codes of characters: frequent letters have one each, all others share them."""

    def __init__(self, letters: str):
        table = np.zeros(0x110000, dtype=np.uint8)
        own = {ord(c): FIRST_LETTER + i for i, c in enumerate(letters[:LETTERS])}
        for code in range(0x110000):
            char = chr(code)
            if char.isspace():
                table[code] = SPACE
            elif char.isalpha():
                base = folded(code) if code < 0x3000 else code
                table[code] = own.get(base, FIRST_LETTER + base % LETTERS)
        self.table = table

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        return self.table[points].astype(np.uint32)


def sentences(text: str | None) -> Iterator[str]:
    """Sentences of a text in order; very long ones in overlapping pieces."""
    for sentence in SENTENCE_END.split(text or ""):
        if sentence:
            sentence = f" {REPEATED.sub(r'\1', sentence)} "
            for at in range(0, max(len(sentence) - OVERLAP, 1), PIECE):
                yield sentence[at : at + PIECE + OVERLAP]


def blocks(pieces: Iterable[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for piece in pieces:
        block.append(piece)
        size += len(piece)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def subsequences(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For every choice of offsets: weight, and number of the subsequence that starts at each position.

    A subsequence with a character that only widens spans has a number with a zero digit.
    """
    n = len(codes) - SPAN + 1
    if n <= 0:
        return
    first = {a: (codes[:n] << 15) | (codes[a : a + n] << 10) for a in range(1, SPAN - 2)}
    for b in range(2, SPAN - 1):
        for d in range(b + 1, SPAN):
            second = (codes[b : b + n] << 5) | codes[d : d + n]
            for a in range(1, b):
                yield DECAY ** (d + 1 - LENGTH), first[a] | second


def joined(pieces: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Codes of pieces, parted so that no subsequence spans two, and where each one starts."""
    lengths = np.fromiter((len(p) + len(PAD) for p in pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(lengths) - lengths
    return alphabet.codes(PAD.join(pieces) + PAD), starts


def real(numbers: np.ndarray) -> np.ndarray:
    """Which numbers have no zero digit."""
    mask = (1 << BITS) - 1
    return ((numbers & mask) > 0) & ((numbers >> 5 & mask) > 0) & ((numbers >> 10 & mask) > 0) & ((numbers >> 15) > 0)


@dataclass
class Model:
    """A weight per subsequence, a constant, and a logistic curve over the highest-scoring sentence."""

    letters: str
    numbers: np.ndarray
    weights: np.ndarray
    constant: float
    slope: float
    shift: float

    def prepare(self) -> None:
        self.alphabet = Alphabet(self.letters)
        self.table = np.zeros(TABLE, dtype=np.float32)
        self.table[self.numbers] = self.weights

    def margins(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin, piece and start within it of every window."""
        codes, starts = joined(pieces, self.alphabet)
        total = np.zeros(len(codes) - SPAN + 1, dtype=np.float32)
        for weight, numbers in subsequences(codes):
            part = self.table[numbers]
            part *= np.float32(weight)
            total += part
        sums = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
        lengths = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        count = np.maximum(-(-(lengths - WINDOW) // STEP), 0) + 1
        owner = np.repeat(np.arange(len(pieces)), count)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STEP
        begin = starts[owner] + at
        end = np.minimum(begin + WINDOW, starts[owner] + lengths[owner])
        return sums[end] - sums[begin] + self.constant, owner, at

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probability by text; a text without sentences has the margin of an empty sentence."""
        texts = list(texts)
        best = np.full(len(texts), self.constant)
        owners: list[int] = []

        def pieces():
            for i, text in enumerate(texts):
                for piece in sentences(text):
                    owners.append(i)
                    yield piece

        at = 0
        for block in blocks(pieces()):
            margin, piece, _ = self.margins(block)
            np.maximum.at(best, np.array(owners[at : at + len(block)])[piece], margin)
            at += len(block)
        return logistic(self.slope * best + self.shift)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def words_of(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]{3,30}", text.lower())}


def choose_landmarks(texts: list[str], toxic: np.ndarray, count: int) -> list[str]:
    """Words that tell toxic rows from clean ones, each chosen for rows that earlier ones leave uncovered.

    Near copies of a row therefore don't fill the list with their other words. The last quarter are words
    drawn by their hash, so that ordinary sentences are represented as well.
    """
    sets = [words_of(t) for t in texts]
    vocabulary = sorted(set().union(*sets)) if sets else []
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cols = np.fromiter((number[w] for s in sets for w in sorted(s)), dtype=np.int64, count=len(rows))
    bad = toxic[rows]
    clean = np.bincount(cols[~bad], minlength=len(vocabulary))
    rarity = (clean + 0.5) / (np.count_nonzero(~toxic) + 1)
    weight = toxic.astype(float)
    chosen: list[int] = []
    for _ in range(min(count - count // 4, len(vocabulary))):
        found = np.bincount(cols[bad], weight[rows[bad]], len(vocabulary))
        gain = found * np.log((found + 0.5) / (np.count_nonzero(toxic) + 1) / rarity)
        gain[chosen] = -1
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        chosen.append(best)
        weight[rows[bad & (cols == best)]] *= 0.5
    drawn = pd.util.hash_array(np.array(vocabulary, dtype=object)) if vocabulary else np.zeros(0)
    taken = set(chosen)
    others = [int(i) for i in np.argsort(drawn, kind="stable") if int(i) not in taken]
    return [vocabulary[i] for i in (chosen + others)[:count]]


class Landmarks:
    """Subsequence counts of landmarks, scaled to length one, and kernels with them."""

    def __init__(self, strings: list[str], alphabet: Alphabet):
        self.alphabet = alphabet
        codes, starts = joined([f" {s} " for s in strings], alphabet)
        owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
        keys, values = [], []
        for weight, numbers in subsequences(codes):
            held = np.flatnonzero(real(numbers))
            keys.append(owner[held] * TABLE + numbers[held])
            values.append(np.full(len(held), weight))
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(where, np.concatenate(values))
        self.numbers, column = np.unique(keys % TABLE, return_inverse=True)
        self.matrix = np.zeros((len(self.numbers), len(strings)), dtype=np.float32)
        self.matrix[column, keys // TABLE] = counts
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=0), 1e-9)
        self.row = np.full(TABLE, -1, dtype=np.int32)
        self.row[self.numbers] = np.arange(len(self.numbers))

    def kernel(self, pieces: list[str]) -> np.ndarray:
        """K(windows, landmarks) of windows with the SPAN - 1 characters behind them, block by block."""
        result = [np.zeros((0, self.matrix.shape[1]), dtype=np.float32)]
        for block in blocks(pieces):
            codes, starts = joined(block, self.alphabet)
            owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
            inside = (np.arange(len(codes)) - starts[owner] < WINDOW)[: len(codes) - SPAN + 1]
            keys, values = [], []
            for weight, numbers in subsequences(codes):
                row = self.row[numbers]
                held = np.flatnonzero((row >= 0) & inside)
                keys.append(owner[held] * len(self.numbers) + row[held])
                values.append(np.full(len(held), weight, dtype=np.float32))
            keys, values = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            part = np.zeros((len(block), self.matrix.shape[1]), dtype=np.float32)
            ends = np.searchsorted(keys, np.arange(1, len(block) + 1) * len(self.numbers))
            begin = 0
            for i, end in enumerate(ends):
                part[i] = values[begin:end] @ self.matrix[keys[begin:end] % len(self.numbers)]
                begin = end
            result.append(part)
        return np.concatenate(result)


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), dtype=bool)
    for _ in range(30):
        part, scale = x[active], cost[active]
        w = np.linalg.solve(ridge + (part * scale[:, None]).T @ part, part.T @ (scale * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in from 0 and 1 by the class sizes."""
    bad, good = np.count_nonzero(toxic), np.count_nonzero(~toxic)
    target = np.where(toxic, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    # Both labels weigh alike: 0.5 lies between them, not where the rarer one gets lost.
    cost = np.where(toxic, 0.5 / bad, 0.5 / good)
    w = np.zeros(2)
    for _ in range(50):
        p = logistic(x @ w)
        gradient = x.T @ (cost * (p - target)) + 1e-6 * w
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    """Train on labelled rows. Without rows of both labels the score is the share of toxic ones."""
    if toxic.all() or not toxic.any():
        shift = float(np.log((toxic.mean() + 1e-6) / (1 - toxic.mean() + 1e-6))) if len(toxic) else -20.0
        return Model("", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0, 1.0, shift)
    counts = np.zeros(0x3000, dtype=np.int64)
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        counts += np.bincount(points[points < 0x3000], minlength=0x3000)
    totals: dict[int, int] = {}
    for code in np.flatnonzero(counts):
        if chr(code).isalpha():
            totals[folded(int(code))] = totals.get(folded(int(code)), 0) + int(counts[code])
    letters = "".join(chr(c) for c in sorted(totals, key=lambda c: (-totals[c], c))[:LETTERS])
    alphabet = Alphabet(letters)
    strings = choose_landmarks(texts, toxic, landmarks)
    if not strings:
        strings = ["none"]
    marks = Landmarks(strings, alphabet)
    gram = marks.matrix.T.astype(float) @ marks.matrix
    values, vectors = np.linalg.eigh(gram)
    held = values > 1e-6 * values[-1]
    root = vectors[:, held] / np.sqrt(values[held])

    owned = [(i, p) for i, t in enumerate(texts) for p in sentences(t)]
    row, pieces = np.array([i for i, _ in owned], dtype=np.int64), [p for _, p in owned]
    model = Model(letters, marks.numbers, np.zeros(len(marks.numbers), dtype=np.float32), 0.0, 1.0, 0.0)
    model.prepare()

    def windows() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin, piece and start of all windows."""
        found, first = [], 0
        for block in blocks(pieces):
            margin, piece, at = model.margins(block)
            found.append((margin, piece + first, at))
            first += len(block)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def features(chosen: np.ndarray) -> np.ndarray:
        return marks.kernel([pieces[p][a : a + WINDOW + SPAN - 1] for p, a in zip(piece[chosen], at[chosen], strict=True)]) @ root

    # Windows begin with a plain sum: how much of the landmarks of toxic rows they hold.
    model.weights = np.max(marks.matrix[:, : min(len(strings), landmarks - landmarks // 4)], axis=1)
    model.table[model.numbers] = model.weights
    margin, piece, at = windows()
    toxic_window = toxic[row[piece]]
    clean = np.flatnonzero(~toxic_window)
    drawn = np.random.default_rng(0).permutation(clean)[:CLEAN_WINDOWS]
    used = set(drawn.tolist())
    x_clean = features(drawn)
    for _ in range(ROUNDS):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row[piece], margin)
        # The highest windows of clean rows join the negative ones; of every toxic row its highest
        # window is positive, and so are those above zero, as far as they are the highest of their sentence.
        top = np.full(len(pieces), -np.inf)
        np.maximum.at(top, piece, margin)
        hard = clean[np.argsort(-margin[clean], kind="stable")[:HARD_WINDOWS]]
        hard = np.array([i for i in hard.tolist() if i not in used], dtype=np.int64)
        used.update(hard.tolist())
        if len(hard):
            x_clean = np.vstack([x_clean, features(hard)])
        bad = np.flatnonzero(toxic_window & (margin == top[piece]) & ((margin == best[row[piece]]) | (margin > 0) & (model.slope > 1)))
        x = np.vstack([features(bad), x_clean])
        y = np.concatenate([np.ones(len(bad)), np.full(len(x_clean), -1.0)])
        w, model.constant = train_svm(x, y, PENALTY * np.where(y > 0, 0.5 / len(bad), 0.5 / max(len(x_clean), 1)))
        model.weights = (marks.matrix @ (root @ w)).astype(np.float32)
        model.table[model.numbers] = model.weights
        model.slope = 2.0
        margin, piece, at = windows()
    best = np.full(len(texts), model.constant)
    np.maximum.at(best, row[piece], margin)
    model.slope, model.shift = fit_logistic(best, toxic)
    return model


def remainder(doc_id: Column) -> Column:
    """CRC-32 of the decimal doc_id modulo 5; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows that are not held out.

    Rows of each label are drawn in the order of a hash of their doc_id, up to TOXIC_ROWS or CLEAN_ROWS of them
    and CLASS_CHARS characters. Rows above ROW_CHARS characters or without text teach nothing; they are scored like all others.
    Only ids and lengths are compared over the whole table.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("toxic"))
    lengths = docs.select("doc_id", F.char_length("text").alias("n")).filter(F.col("n").between(1, ROW_CHARS))
    found = scratch.store(lengths.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.sum("n").alias("n")), "labelled")
    chosen = []
    for toxic, most in ((True, TOXIC_ROWS), (False, CLEAN_ROWS)):
        rows = found.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        total = np.cumsum([r.n for r in rows])
        chosen += [(r.doc_id, toxic) for r, t in zip(rows, total, strict=True) if t <= CLASS_CHARS]
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic boolean")
    return docs.select("doc_id", "text").filter(F.char_length("text").between(1, ROW_CHARS)).join(F.broadcast(ids), "doc_id")


MODEL = "letters string, numbers binary, weights binary, constant double, slope double, shift double"


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows that are not held out, fitted in one task on the bounded sample."""
    scratch = Scratch(docs.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable")
        model = fit(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=bool))
        return pd.DataFrame([(
            model.letters, model.numbers.astype("<u4").tobytes(), model.weights.astype("<f4").tobytes(),
            model.constant, model.slope, model.shift)], columns=[c.split()[0] for c in MODEL.split(", ")])

    rows = sample(docs, labels, scratch).select("doc_id", "text", "toxic", F.lit(0).alias("one"))
    found = rows.groupBy("one").applyInPandas(run, MODEL).collect()
    scratch.drop()
    if not found:
        return fit([], np.zeros(0, dtype=bool))
    r = found[0]
    return Model(r.letters, np.frombuffer(r.numbers, dtype="<u4").astype(np.int64), np.frombuffer(r.weights, dtype="<f4"),
                 r.constant, r.slope, r.shift)


def scorer(model: Model):
    """Column function that scores texts; a worker builds its tables once."""
    ready: list[Model] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not ready:
            model.prepare()
            ready.append(model)
        return pd.Series(ready[0].scores(texts))

    return score


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts score as an empty sentence.

    A doc_id with several labels is toxic if one of them says so. Without labels of both kinds all rows get
    the share of toxic ones. An empty table has no scores.
    """
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
