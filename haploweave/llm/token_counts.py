"""Token counts of a unigram model, by dynamic programming that shares prefixes.

Scores are those of a unigram model made of a public vocabulary: the file gives an
order of pieces, not probabilities, so a piece's probability is taken to fall with
its rank after Zipf.

The distinct pre-tokens of a batch are inserted in a trie. Forward scores (the best
score of a segmentation, and its tokens) belong to the trie's nodes, so a prefix
that pre-tokens share is scored once; the pieces that end at a node are found by
walking its ancestors and a trie of reversed pieces at once. All nodes of a depth
are scored together. A terminal node's token count and score are kept by
pre-token for the batches that follow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import as_bytes, chunks, pieces, release, table

#: Marks the start of a pre-token in the vocabulary.
START = "▁"
#: Terminals that a worker keeps at most, and the longest it keeps.
KEPT, KEPT_CHARS = 400_000, 48
#: Added to a piece's rank; its probability falls with the sum, after Zipf.
SHIFT = 2.7
#: Pre-tokens that are inserted in one trie, and the longest: others are scored by themselves.
TRIE_WORDS, TRIE_CHARS = 1 << 14, 96


class Unigram:
    """Piece scores, and a trie of reversed pieces."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        steps: dict[tuple[int, int], int] = {}
        ends = [-np.inf]
        for piece, score in scores.items():
            state = 0
            for c in reversed(piece):
                if (to := steps.get((state, ord(c)))) is None:
                    to = steps[state, ord(c)] = len(ends)
                    ends.append(-np.inf)
                state = to
            ends[state] = score
        order = sorted(steps)
        self.keys = np.array([s << 21 | c for s, c in order], np.int64)
        self.to = np.array([steps[k] for k in order], np.int64)
        self.ends = np.array(ends)

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """Of a sentencepiece vocabulary, pieces by rank. A character that no piece holds is one token for each byte."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces_ = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = sum(1 / (i + SHIFT) for i in range(len(pieces_)))
        return cls({p: -math.log((i + SHIFT) * total) for i, p in enumerate(pieces_)}, -math.log((len(pieces_) + SHIFT) * total) - 5)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states of the reversed pieces' trie after one character more; -1 where no piece goes on so."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def count(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each of the sorted, distinct ``words``, by the best segmentation; of equal scores the one of fewer tokens."""
        trie = Trie(words)
        trie.score(self)
        return [(int(trie.tokens[t]), float(trie.best[t])) for t in trie.terminals]

    def count_long(self, word: str) -> tuple[int, float]:
        """The same for one word of any length, whose trie is a path."""
        longest = max(map(len, self.scores), default=1)
        ways = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode("utf-8", "surrogateescape"))
            best = (ways[max(0, len(ways) - 1)][0] + self.byte_score * n, -(-ways[-1][1] + n))
            for size in range(1, min(i, longest) + 1):
                if (s := self.scores.get(word[i - size : i])) is not None:
                    best = max(best, (s + ways[-size][0], ways[-size][1] - 1))
            ways = [*ways[-longest:], best]
        return -ways[-1][1], ways[-1][0]


class Trie:
    """Nodes of the prefixes of sorted words, by depth: parent and character, and after scoring the best score and its tokens."""

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        depth = int(lengths.max(initial=0))
        chars = np.zeros((len(words), max(depth, 1)), np.int64)
        for i, w in enumerate(words):
            chars[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
        same = chars[1:] == chars[:-1]
        shared = np.concatenate(([0], np.where(same.all(1), chars.shape[1], same.argmin(1)))) if len(words) > 1 else np.zeros(len(words), np.int64)
        shared = np.minimum(shared, np.minimum(lengths, np.concatenate(([0], lengths[:-1])))) if len(words) else shared
        self.terminals = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)  # of each word, at the depth so far
        parents, letters, self.levels, size = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 1
        for d in range(1, depth + 1):
            here = np.flatnonzero(lengths >= d)
            new = shared[here] < d  # the first word that has the prefix brings the node
            parents.append(node[here[new]])
            letters.append(chars[here[new], d - 1])
            node[here] = size + np.cumsum(new) - 1
            self.levels.append((size, size + int(new.sum())))
            size += int(new.sum())
            ended = here[lengths[here] == d]
            self.terminals[ended] = node[ended]
        self.parent, self.char = np.concatenate(parents), np.concatenate(letters)
        self.best, self.tokens = np.zeros(size), np.zeros(size, np.int64)

    def score(self, model: Unigram) -> None:
        for low, high in self.levels:
            before, char = self.parent[low:high], self.char[low:high]
            # a byte that isn't UTF-8 is one byte
            n = 1 + (char >= 0x80) * ~((char >= 0xDC80) & (char <= 0xDCFF)) + ((char >= 0x800) & ~((char >= 0xDC80) & (char <= 0xDCFF))) + (char >= 0x10000)
            best, tokens = self.best[before] + model.byte_score * n, self.tokens[before] + n
            at, state = np.arange(high - low), np.zeros(high - low, np.int64)
            while len(at):
                state = model.step(state, char)
                on = state >= 0
                at, state, before = at[on], state[on], before[on]
                score, count = model.ends[state] + self.best[before], self.tokens[before] + 1
                better = (score > best[at]) | ((score == best[at]) & (count < tokens[at]))
                best[at[better]], tokens[at[better]] = score[better], count[better]
                on = before > 0  # on to the next ancestor, short of the root
                at, state, char, before = at[on], state[on], self.char[before[on]], self.parent[before[on]]
            self.best[low:high], self.tokens[low:high] = best, tokens


class Counter:
    """A model and the terminals known so far."""

    def __init__(self, path: str):
        self.model = Unigram.from_file(path)
        self.known: dict[bytes, tuple[int, float]] = {}

    def learn(self, words: set[bytes]) -> None:
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > KEPT:
            self.known, fresh = {}, words
        names = sorted((START + w.decode("utf-8", "surrogateescape"), w) for w in fresh)  # one name for each, invalid bytes too
        short = [x for x in names if len(x[0]) <= TRIE_CHARS]
        for i in range(0, len(short), TRIE_WORDS):
            part = short[i : i + TRIE_WORDS]
            self.known.update(zip([w for _, w in part], self.model.count([name for name, _ in part]), strict=True))
        self.known.update((w, self.model.count_long(name)) for name, w in names if len(name) > TRIE_CHARS)

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each text."""
        split = [[part.split() for _, part in chunks(text)] for text in texts]
        words = set().union(*(ws for parts in split for ws in parts))
        self.learn(words)
        known, rows = self.known, []
        for parts in split:
            own = [[known[w] for w in ws] for ws in parts]
            rows.append((sum(map(len, own)), sum(n for ws in own for n, _ in ws), math.fsum(s for ws in own for _, s in ws)))
        for w in [w for w in words if len(w) > KEPT_CHARS]:
            del known[w]
        return rows


#: Vocabularies that a worker has loaded, for the tasks that follow.
_loaded: dict[str, Counter] = {}


def counter(path: str | None) -> Counter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_score for each row of ``docs``.

    Pre-tokens are the words of a text after the mark of a start. ``vocabulary``:
    the path of a sentencepiece file on the executors; None: piece_bpe_32k.model of
    the public tokenizers. Null and empty texts and white space have 0 of each. A
    byte that isn't UTF-8 is a character, and one token. Repeated rows are counted
    each, null identifiers too. Other columns are not read. An empty table gives an
    empty result.
    """

    def count(batches):
        count_texts = counter(vocabulary)
        for batch in pieces(batches):
            columns = zip(*count_texts(as_bytes(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])
        count_texts.known = {}  # an idle worker holds no more than the vocabulary
        release()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long, log_score double")


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
