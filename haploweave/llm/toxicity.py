"""Toxicity by a linear-chain conditional random field.

Labels are given for documents. Words and word beginnings that are significantly
commoner in toxic documents label the tokens of a bounded sample of documents,
whole texts; a two-state chain (clean, toxic) is trained on all their tokens. Its
features, of every token, are the word, its beginnings, its shape, and the words
before and after. A document is then tagged whole: forward-backward gives each
token's probability of being toxic and the probability that any is. A logistic
model, fitted on the sample's documents, turns those into a score; tokens over one
half are the offending spans.

Training runs where the sample is: in each round every task takes gradient steps
over its texts, and the weights are averaged. Weights are drawn towards zero and
never below it: a token is clean unless something speaks for the other state. So
only features that tokens labelled toxic have can get one, and most tokens have
none. Those share one potential, so a run of them
is one matrix power, and only the other tokens are visited.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import as_bytes, chunks, materialize, pieces, table

#: Labelled documents that are learned from at most, by hash of the identifier.
SAMPLE = 10_000
#: Word beginnings that are features, beside the word.
BEGINNINGS = (3, 4, 5, 6)
#: Features of fewer toxic documents are not tried.
LEAST_DOCUMENTS = 4
#: A feature labels tokens if at least such a share of its documents is toxic, adjusted to equal classes.
PRECISION = 0.7
#: Tokens of a training window; windows follow each other through a text. Windows of a gradient step.
WINDOW, STEP = 32, 64
#: Rounds of training, and parts of the sample that are trained on apart in each.
ROUNDS, PARTS = 6, 8
#: Features that fewer tokens labelled toxic have are not used.
LEAST_TOKENS = 2
#: Smaller weights are dropped.
LEAST_WEIGHT = 1.0
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def words_of(text: bytes):
    """(character offset, word in lower case) of a text, part by part."""
    at = 0
    for _, part in chunks(text):
        part = part.decode("utf-8", "replace")
        for m in WORD.finditer(part):
            yield at + m.start(), m[0].lower()
        at += len(part)


def _counter(only: set[str] | None):
    """In how many documents each feature occurs; of ``only`` these, where given."""

    def count(batches):
        counts = Counter()
        for batch in pieces(batches):
            for text in as_bytes(batch.column("text")):
                seen = {f for w in {w for _, w in words_of(text)} for f in features(w)}
                counts.update(seen if only is None else seen & only)
        rows = list(counts.items())
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 100_000], strict=True)], names=["feature", "n"])

    return count


def _tail(k: int, n: int, p: float) -> float:
    """Log of an upper bound of the chance of k or more hits in n tries (Chernoff)."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))


def lexicon(sample: DataFrame) -> set[str]:
    """Features that mark toxic tokens: precise, and significant given how many were tried."""
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return set()
    counted = sample.where("toxic = 1").select("text").mapInArrow(_counter(None), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    toxic = {r["feature"]: r["n"] for r in counted.collect()}  # of a bounded sample
    counted = sample.where("toxic = 0").select("text").mapInArrow(_counter(set(toxic)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    clean = {r["feature"]: r["n"] for r in counted.collect()}
    share, level = bad / (bad + good), math.log(0.05 / max(len(toxic), 1))
    return {f for f, k in toxic.items() if k / bad >= PRECISION * (k / bad + clean.get(f, 0) / good) and _tail(k, k + clean.get(f, 0), share) <= level}


def shape(word: str) -> str:
    """What a word is made of, and whether it is short; nothing for one of letters only, as nearly all are."""
    if word.isalpha():
        return ""
    return ("d" if word.isdigit() else "m") + ("-" if len(word) <= 3 else "+")


def names_of(word: str) -> list[str]:
    """The names of a word's features for its own token; then those for the token after it and before it."""
    return [*(f"o{f}" for f in features(word)), f"s{shape(word)}", f"p{word}", f"n{word}"]


#: Features of a token: the word, its beginnings, its shape, the words before and after.
FEATURES = 1 + len(BEGINNINGS) + 1 + 2


class Vocabulary:
    """Numbers, from 1, of the features that can have a weight; 0 is any other."""

    def __init__(self, names: list[str]):
        self.size = len(names) + 1
        own = {name[1:]: i + 1 for i, name in enumerate(names) if name[0] == "o"}
        self.words = {f: i for f, i in own.items() if f[-1:] != "*"}
        self.starts = [(n, {f[:-1]: i for f, i in own.items() if f[-1:] == "*" and len(f) == n + 1}) for n in BEGINNINGS]
        self.shapes, self.before, self.after = ({name[1:]: i + 1 for i, name in enumerate(names) if name[0] == kind and len(name) > 1} for kind in "spn")

    def numbers(self, word: str) -> list[int]:
        """FEATURES numbers; the last two are for the token after, which has this word before it, and for the token before."""
        return [self.words.get(word, 0), *(starts.get(word[:n], 0) if len(word) >= n else 0 for n, starts in self.starts), self.shapes.get(shape(word), 0), self.before.get(word, 0), self.after.get(word, 0)]


def _namer(marks: set[str]):
    """How many toxic tokens have each feature."""

    def count(batches):
        counts = Counter()
        for batch in pieces(batches):
            for text in as_bytes(batch.column("text")):
                words = [w for _, w in words_of(text)]
                for i, w in enumerate(words):
                    if not marks.isdisjoint(features(w)):
                        counts.update(names_of(w)[:-2])
                        counts.update(f"p{x}" for x in words[max(i - 1, 0) : i])
                        counts.update(f"n{x}" for x in words[i + 1 : i + 2])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*counts.items(), strict=True)], names=["feature", "n"])

    return count


def vocabulary(sample: DataFrame, marks: set[str]) -> Vocabulary:
    counted = sample.where("toxic = 1").select("text").mapInArrow(_namer(marks), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return Vocabulary(sorted(r["feature"] for r in counted.where(F.col("n") >= LEAST_TOKENS).collect()))  # of a bounded sample


class Encoder:
    """Texts as rows of feature numbers and labels."""

    def __init__(self, names: Vocabulary, marks: set[str]):
        self.names, self.marks, self.known = names, marks, {}

    def word(self, word: str) -> tuple[list[int], bool]:
        if (got := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known = {}
            got = self.known[word] = (self.names.numbers(word), not self.marks.isdisjoint(features(word)))
        return got

    def __call__(self, toxic: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = [self.word(w) for _, w in words_of(text)]
        x = np.array([f for f, _ in found], np.int32).reshape(-1, FEATURES)
        before, after = x[:, -2].copy(), x[:, -1].copy()
        x[:, -2], x[:, -1] = np.concatenate(([0], before[:-1])) if len(x) else before, np.concatenate((after[1:], [0])) if len(x) else after
        return x, np.array([m and bool(toxic) for _, m in found], bool)


@dataclass
class Model:
    """Weights of the toxic state against the clean one: of features by number, a bias, and the moves clean-toxic, toxic-clean, toxic-toxic; and the sums of squared gradients."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    sums: tuple[np.ndarray, float, np.ndarray]

    @classmethod
    def fresh(cls, size: int) -> Model:
        return cls(np.zeros(size, np.float32), -5.0, np.zeros(3), (np.full(size, 1e-2, np.float32), 1e-2, np.full(3, 1e-2)))

    def learn(self, f: np.ndarray, y: np.ndarray, m: np.ndarray, rate: float = 0.3, shrink: float = 0.3) -> None:
        """One adaptive step on the exact log likelihood of windows: features (windows, WINDOW, FEATURES), labels, and which tokens there are."""
        weights, bias, moves = self.weights, self.bias, self.moves
        unary = np.where(m, bias + weights[f].sum(2), 0.0)
        step = np.array([[0.0, moves[0]], [moves[1], moves[2]]])
        size = len(f)
        alpha, beta = np.zeros((WINDOW, size, 2)), np.zeros((WINDOW, size, 2))
        alpha[0, :, 1] = unary[:, 0]
        for t in range(1, WINDOW):
            new = np.logaddexp(alpha[t - 1, :, :1] + step[0], alpha[t - 1, :, 1:] + step[1])
            new[:, 1] += unary[:, t]
            alpha[t] = np.where(m[:, t, None], new, alpha[t - 1])
        for t in range(WINDOW - 2, -1, -1):
            ahead = beta[t + 1].copy()
            ahead[:, 1] += unary[:, t + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            beta[t] = np.where(m[:, t + 1, None], new, beta[t + 1])
        log_z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        chance = np.exp((alpha + beta)[:, :, 1].T - log_z[:, None]) * m
        slope = np.where(m, y - chance, 0)
        turn = np.zeros(3)
        for t in range(1, WINDOW):
            on = m[:, t]
            pair = alpha[t - 1][:, :, None] + step[None] + beta[t][:, None, :]
            pair[:, :, 1] += unary[:, t, None]
            pair = np.exp(pair - log_z[:, None, None])[on]
            a, b = y[on, t - 1], y[on, t]
            turn += [((1 - a) * b).sum() - pair[:, 0, 1].sum(), (a * (1 - b)).sum() - pair[:, 1, 0].sum(), (a * b).sum() - pair[:, 1, 1].sum()]
        # only the buckets at hand move
        at, place = np.unique(f, return_inverse=True)
        grad = np.bincount(place.ravel(), np.repeat(slope.ravel(), FEATURES), len(at))
        self.sums[0][at] += grad**2
        moved = weights[at] + rate * grad / np.sqrt(self.sums[0][at])
        weights[at] = np.maximum(moved - shrink * rate / np.sqrt(self.sums[0][at]), 0)
        weights[0] = 0
        b, t = self.sums[1] + slope.sum() ** 2, self.sums[2] + turn**2
        self.bias, self.moves, self.sums = bias + rate * slope.sum() / math.sqrt(b), moves + rate * turn / np.sqrt(t), (self.sums[0], b, t)

    def packed(self) -> bytes:
        return np.concatenate([self.weights, [self.bias], self.moves, self.sums[0], [self.sums[1]], self.sums[2]]).astype("<f4").tobytes()

    @classmethod
    def mean(cls, parts: list[tuple[int, bytes]]) -> Model:
        """The average of packed models, by how much each has seen."""
        n = np.array([k for k, _ in parts], float)
        x = sum(k * np.frombuffer(p, "<f4").astype(float) for k, p in parts) / n.sum()
        size = len(x) // 2 - 4
        w, rest = x[: size + 4], x[size + 4 :]
        return cls(w[:size].astype(np.float32), float(w[size]), w[size + 1 :], (rest[:size].astype(np.float32), float(rest[size]), rest[size + 1 :]))

    def chain(self, names: Vocabulary) -> Chain:
        return Chain(self.bias, np.where(self.weights >= LEAST_WEIGHT, self.weights, 0).astype(np.float32), tuple(float(x) for x in self.moves), names)


def windows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's tokens as windows that follow each other, the last one filled up: features, labels, which tokens there are."""
    n = -(-len(x) // WINDOW)
    f, g, m = np.zeros((n * WINDOW, FEATURES), np.int32), np.zeros(n * WINDOW), np.zeros(n * WINDOW, bool)
    f[: len(x)], g[: len(x)], m[: len(x)] = x, y, True
    return f.reshape(n, WINDOW, FEATURES), g.reshape(n, WINDOW), m.reshape(n, WINDOW)


#: Tokens of a stored row of training data.
ROW = 1 << 16


def _encoder(names: Vocabulary, marks: set[str]):
    """Whole texts as rows of features and labels, ROW tokens each."""

    def encode(batches):
        texts = Encoder(names, marks)
        for batch in pieces(batches):
            for place, toxic, text in zip(batch.column("place").to_pylist(), batch.column("toxic").to_pylist(), as_bytes(batch.column("text")), strict=True):
                x, y = texts(toxic, text)
                starts = range(0, len(x), ROW)
                if len(x):
                    columns = [[place] * len(starts), list(starts), [x[i : i + ROW].tobytes() for i in starts], [y[i : i + ROW].tobytes() for i in starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["place", "start", "x", "y"])

    return encode


def _learner(model: bytes):
    """One pass over a task's texts from where ``model`` is."""

    def learn(batches):
        now, held, seen = Model.mean([(1, model)]), [], 0
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                held.append(windows(np.frombuffer(x, np.int32).reshape(-1, FEATURES), np.frombuffer(y, bool)))
                if sum(len(f) for f, _, _ in held) >= STEP:
                    f, y, m = (np.concatenate(c) for c in zip(*held, strict=True))
                    for i in range(0, len(f) - STEP + 1, STEP):
                        now.learn(f[i : i + STEP], y[i : i + STEP], m[i : i + STEP])
                    rest = len(f) // STEP * STEP
                    seen, held = seen + rest, [(f[rest:], y[rest:], m[rest:])]
        if held and sum(len(f) for f, _, _ in held):
            f, y, m = (np.concatenate(c) for c in zip(*held, strict=True))
            now.learn(f, y, m)
            seen += len(f)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([now.packed()], pa.binary())], names=["seen", "model"])

    return learn


def train(sample: DataFrame, marks: set[str], rounds: int = ROUNDS) -> Chain:
    """A chain trained on the whole texts of ``sample(text, toxic, doc_id)``; the driver gets PARTS models a round."""
    names = vocabulary(sample, marks)
    coded = sample.select(F.xxhash64("doc_id").alias("place"), F.col("toxic").cast("long"), "text").mapInArrow(_encoder(names, marks), "place long, start long, x binary, y binary")
    dealt = materialize(coded.repartition(PARTS, "place").sortWithinPartitions("place", "start", "x"), "toxicity-dealt")
    model = Model.fresh(names.size).packed()
    for _ in range(rounds):
        parts = dealt.select("x", "y").mapInArrow(_learner(model), "seen long, model binary").collect()
        if parts:
            model = Model.mean(sorted((r["seen"], bytes(r["model"])) for r in parts)).packed()
    return Model.mean([(1, model)]).chain(names)


@dataclass
class Chain:
    """Weights of the toxic state against the clean one, by a feature's number: a bias, the features, and the transitions clean-toxic, toxic-clean, toxic-toxic."""

    bias: float
    weights: np.ndarray
    moves: tuple[float, float, float]
    names: Vocabulary

    def __post_init__(self):
        a, b, c = (math.exp(x) for x in self.moves)
        # from row to column: clean, toxic; and a step onto a token without features
        self.step = np.array([[1, a], [b, c]])
        values, left = np.linalg.eig(self.step * [1, math.exp(self.bias)])
        self.values, self.left, self.right = values.real, left.real, np.linalg.inv(left.real)
        self.seen: dict[str, tuple[float, float, float] | None] = {}

    def evidence(self, word: str) -> tuple[float, float, float] | None:
        """What a word adds to its own token, to the one after and to the one before; None if nothing."""
        if word not in self.seen:
            if len(self.seen) > 200_000:
                self.seen = {}
            w = [float(self.weights[i]) if i else 0.0 for i in self.names.numbers(word)]
            got = (sum(w[:-2]), w[-2], w[-1])
            if len(word) > 64:
                return got if any(got) else None
            self.seen[word] = got if any(got) else None
        return self.seen[word]

    def run(self, n: int) -> tuple[np.ndarray, float]:
        """``n`` steps over plain tokens, scaled, and the log of the scale."""
        top = max(abs(self.values))
        return (self.left * (self.values / top) ** n) @ self.right, n * math.log(top)

    def look(self, text: bytes) -> tuple[int, list[tuple[int, int, int, float]]]:
        """(how many tokens, [(index, start, length, evidence) of tokens with features])."""
        n, at, sums, places, ends = 0, 0, {}, {}, {}
        for _, part in chunks(text):
            part = part.decode("utf-8", "replace")
            words = WORD.findall(part)
            hits = {w: u for w in set(words) if (u := self.evidence(w.lower()))}
            for i, w in enumerate(words) if hits else ():
                if (u := hits.get(w)) is not None:
                    for j, x in ((n + i, u[0]), (n + i + 1, u[1]), (n + i - 1, u[2])):
                        if x and j >= 0:
                            sums[j] = sums.get(j, 0.0) + x
            if hits or (words and n in sums):
                places |= {n + i: (at + m.start(), len(m[0])) for i, m in enumerate(WORD.finditer(part)) if n + i in sums}
            n, at = n + len(words), at + len(part)
            if words:  # the word that the next part begins with may have evidence for this part's last
                ends[n - 1] = (at - len(part) + part.rindex(words[-1]), len(words[-1]))
        return n, [(j, *(places.get(j) or ends[j]), u) for j, u in sorted(sums.items()) if j < n and u]

    def tag(self, text: bytes) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(log of the chance that no token is toxic, how many tokens, [(start, end, chance) of tokens with features])."""
        n, found = self.look(text)
        if not n:
            return 0.0, 0, []
        if not found:
            alpha = np.array([1.0, math.exp(self.bias)])
            power, scale = self.run(n - 1)
            return -(math.log((alpha @ power).sum()) + scale), n, []
        # forward: before each token with features; the chain starts as if after a clean token without cost
        ahead, scale, at, alpha = [], 0.0, -1, None
        for i, _, _, u in found:
            if alpha is None:
                before = np.array([1.0, 1.0]) if i == 0 else None
                if before is None:
                    power, s = self.run(i - 1)
                    before, scale = (np.array([1.0, math.exp(self.bias)]) @ power) @ self.step, scale + s
            else:
                power, s = self.run(i - at - 1)
                before, scale = (alpha @ power) @ self.step, scale + s
            alpha = before * [1, math.exp(min(self.bias + u, 50))]
            total = alpha.sum()
            alpha, scale, at = alpha / total, scale + math.log(total), i
            ahead.append(alpha)
        power, s = self.run(n - 1 - at)
        beta = power.sum(1)
        log_z = scale + s + math.log(alpha @ beta)
        chances = [0.0] * len(found)
        for j in range(len(found) - 1, -1, -1):
            both = ahead[j] * beta
            chances[j] = float(both[1] / both.sum())
            if j:
                i, _, _, u = found[j]
                power, _ = self.run(i - found[j - 1][0] - 1)
                beta = power @ (self.step @ (np.array([1, math.exp(min(self.bias + u, 50))]) * beta))
                beta = beta / beta.sum()
        return -log_z, n, [(start, start + size, p) for (_, start, size, _), p in zip(found, chances, strict=True)]


#: Numbers that a score is made of.
EVIDENCE = 4


def evidence(chain: Chain, text: bytes) -> tuple[list[float], list[tuple[int, int, float]]]:
    """What the score is made of (log odds of any toxic token, expected toxic tokens, largest chance, length) and the tagged tokens."""
    clean, n, tagged = chain.tag(text)
    any_toxic = -math.expm1(min(clean, 0.0))
    odds = math.log(max(any_toxic, 1e-9)) - min(clean, 0.0)
    return [min(odds, 20.0) / 10, math.log1p(sum(p for *_, p in tagged)), max((p for *_, p in tagged), default=0.0), math.log1p(n) / 5], tagged


def logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (shrink + 1e-6) * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w = w + np.clip(move, -5, 5)
    return w


def _scorer(chain: Chain, weights: np.ndarray | None):
    """With weights: id, score, spans; without: what the weights are fitted on."""

    def score(batches):
        for batch in pieces(batches):
            found = [evidence(chain, x) for x in as_bytes(batch.column("text"))]
            x = np.array([f for f, _ in found]).reshape(-1, EVIDENCE)
            if weights is None:
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x))], names=["toxic", "x"])
                continue
            z = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            spans = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in t if p >= 0.5] for _, t in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z), spans], names=["doc_id", "score", "spans"])

    return score


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labels of 0 or 1. Of a doc_id's texts, the one with the smallest hash is learned from."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    some = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most ``limit`` rows of two numbers
    # one text for each label, so that repeated identifiers don't grow the sample
    return docs.join(some, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[Chain, np.ndarray]:
    """The chain and the score's weights from ``labels(doc_id, toxic)``, of at most ``limit`` documents."""
    sample = materialize(sampled(docs, labels, limit), "toxicity-sample")
    marks = lexicon(sample)
    chain = train(sample, marks) if marks else Chain(-12.0, np.zeros(1, np.float32), (0.0, 0.0, 0.0), Vocabulary([]))
    rows = sample.mapInArrow(_scorer(chain, None), "toxic long, x array<double>").toArrow()
    y = rows.column(0).to_numpy().astype(float)
    x = np.array(rows.column(1).to_pylist()).reshape(-1, EVIDENCE)
    return chain, logistic(x, y) if len(y) else np.array([0.0] * EVIDENCE + [-3.0])


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), spans (start, end, p; in characters) for each row of ``docs``.

    Null and empty texts have no token and get the score of no evidence. Repeated
    rows are scored each. Labels that are null or for unknown documents are left
    out; of a document labelled twice the larger label counts. Without labels of
    both kinds no token is toxic. Other columns are not read, and the score
    depends on the text only. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chain, weights = fit(docs, labels, limit)
    return docs.mapInArrow(_scorer(chain, weights), "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def op6_toxicity(spark, sf_dir):
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), "toxic").where(part != 2)
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
