"""Language ID by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier over the
character n-grams (1 to 4) of the text's words, written in lower case with a border on both
sides. A bit's classifier weighs an n-gram by the log ratio of its mean shares in the
languages whose bit is 1 and in those whose bit is 0, and a text by the mean over its
n-grams. Loss-weighted decoding adds up, for every language, the logistic loss of the bits
it expects; the smallest loss wins. The score is the softmax of the negative losses; a text
is ambiguous where the runner-up's score is close.

Training counts n-grams of a bounded sample (``rows`` texts of each language) in Spark; the
model is languages x bits plus one weight a bit for each n-gram bucket, so its size is
bounded. Prediction is a map over whole texts.

NULL text, or text without letters: ``und``, score 0, not ambiguous. No labelled text at all:
``und`` for every text. Rows with a NULL language are not learned from. Ties between losses
go to the alphabetically first language. Repeated rows each give their row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm import chars
from textscore.llm.common import SLICE, broadcast, sample_per_class, slices, worker_cache

UNKNOWN = "und"
#: Places for hashed n-grams.
BUCKETS = 1 << 16
#: Longest n-gram.
LONGEST = 4
#: Distinct words a worker remembers.
MEMO = 400_000
RESULT = "struct<lang_pred: string, score: double, ambiguous: boolean>"


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per class; any two rows differ in many bits.

    Up to seven classes: every way to split them in two, once. More: the random code of
    about ten bits per doubling whose closest rows are furthest apart, of fifty tried.
    """
    if n <= 7:
        splits = range(1, 1 << max(0, n - 1))
        return np.array([[1 if (s >> c & 1) else -1 for s in splits] for c in range(n)]).reshape(n, len(splits))
    rng = np.random.default_rng(n)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], size=(n, int(np.ceil(10 * np.log2(n)))))
        agree = code @ code.T
        np.fill_diagonal(agree, -code.shape[1])
        usable = (np.abs(code.sum(axis=0)) < n).all()
        if usable and (code.shape[1] - agree.max()) > apart:
            best, apart = code, code.shape[1] - agree.max()
    return best


def grams(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of words given as code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    line = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(line), bool)
    inner[ends - 1] = inner[ends - lengths] = False
    if len(words):
        line[inner] = np.concatenate(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    rolled = np.zeros(len(line), np.uint64)
    for n in range(1, LONGEST + 1):
        # the n-gram that begins here, where it stays inside the word
        rolled = rolled[: len(line) - n + 1] * np.uint64(0x100000001B3) + line[n - 1 :] + np.uint64(n)
        same = owner[: len(line) - n + 1] == owner[n - 1 :]
        if n == 1:
            same &= inner
        buckets.append((chars.mix(rolled[same]) >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(line) - n + 1][same])
    return np.concatenate(buckets), np.concatenate(owners)


class Words:
    """Numbers the words of texts; ``learn`` is called with the code points of each new word."""

    def __init__(self, learn, limit: int = MEMO) -> None:
        self.alphabet, self.learn, self.limit = chars.Alphabet(), learn, limit
        self.memo = chars.Memo(limit)

    def read(self, texts: Iterable[str | None], restart) -> Iterator[tuple[int, np.ndarray]]:
        """(row, numbers of its words in order); a very long text gives several in a row.

        ``restart`` is called when the memo starts afresh.
        """
        for rows, parts in chars.chunks(texts):
            if self.memo.full():
                self.memo = chars.Memo(self.limit)
                restart()
            points, kinds, ends = self.alphabet.read(parts)
            points = self.alphabet.lower[points]
            starts, stops = chars.runs(kinds, (chars.LETTER,))
            numbers, new = self.memo.numbers(self.alphabet.hashes(points, starts, stops))
            if len(new):
                self.learn([points[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            borders = np.cumsum(chars.counts_per_part(starts, ends))
            yield from zip(rows, np.split(numbers, borders[:-1]), strict=True)


@dataclass
class LanguageModel:
    """What ``fit`` learned; small and bounded, shipped to the tasks by broadcast."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    sharpness: float = 8.0
    close: float = 0.1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Predictor:
    """Applies a model to texts; remembers each distinct word's sums."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._restart()
        self.words = Words(self._learn)

    def _restart(self) -> None:
        self.sums = np.zeros((1024, self.model.code.shape[1] + 1), np.float32)
        self.known = 0

    def _learn(self, words: list[np.ndarray]) -> None:
        buckets, owners = grams(words)
        rows = np.column_stack([self.model.weights[buckets], np.ones(len(buckets), np.float32)])
        first = np.zeros(len(words), np.int64)
        order = np.argsort(owners, kind="stable")
        first[1:] = np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]
        while self.known + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[self.known : self.known + len(words)] = np.add.reduceat(rows[order], first)
        self.known += len(words)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, langs = len(texts), self.model.langs
        totals = np.zeros((n, self.sums.shape[1]))
        for row, numbers in self.words.read(texts, self._restart):
            if len(numbers):
                totals[row] += self.sums[numbers].sum(axis=0, dtype=np.float64)
        read = totals[:, -1] > 0
        if not langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        margins = totals[:, :-1] / np.maximum(totals[:, -1:], 1)
        losses = np.logaddexp(0, -self.model.sharpness * margins[:, None, :] * self.model.code[None]).sum(axis=2)
        odds = np.exp(losses.min(axis=1, keepdims=True) - losses)
        odds /= odds.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        score = odds[np.arange(n), best]
        runner_up = np.sort(odds, axis=1)[:, -2] if len(langs) > 1 else np.zeros(n)
        return [langs[b] if r else UNKNOWN for b, r in zip(best, read, strict=True)], np.where(read, score, 0.0), read & (score - runner_up < self.model.close)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 2000) -> LanguageModel:
    """A model of the languages of ``labelled``, from about ``rows`` texts of each."""
    source = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = sample_per_class(source, "lang", "key", rows).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []

        def learn(words: list[np.ndarray]) -> None:
            buckets, owners = grams(words)
            known.extend(np.split(buckets[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]))

        words, sums = Words(learn), {}
        for batch in slices(batches):
            labels = batch.column(1).to_pylist()
            for row, numbers in words.read(batch.column(0).to_pylist(), known.clear):
                tally = sums.setdefault(labels[row], np.zeros(BUCKETS, np.int64))
                if len(numbers):
                    tally += np.bincount(np.concatenate([known[i] for i in numbers.tolist()]), minlength=BUCKETS)
        for label, tally in sums.items():
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(tally[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    shares = np.full((len(langs), BUCKETS), 0.5)
    for i, one in enumerate(langs):
        own = counted[counted["lang"] == one]
        shares[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    shares /= shares.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        weights[:, bit] = np.log(shares[code[:, bit] > 0].mean(axis=0)) - np.log(shares[code[:, bit] < 0].mean(axis=0))
    return LanguageModel(langs, code, weights)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", result: str = "language") -> DataFrame:
    """``docs`` with a struct column ``result`` (lang_pred, score, ambiguous); a column of that name is replaced."""
    read, key = broadcast(docs.sparkSession, model), model.key

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = worker_cache("language", key, lambda: Predictor(read()))
        for batch in texts:
            done = [own.predict(batch.slice(at, SLICE).to_pylist()) for at in range(0, len(batch), SLICE)]
            langs = [x for d in done for x in d[0]]
            scores, close = (np.concatenate([np.zeros(0, t), *[d[i] for d in done]]) for i, t in ((1, float), (2, bool)))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(close)], ["lang_pred", "score", "ambiguous"])

    return docs.withColumn(result, run(F.col(text).cast("string")))
