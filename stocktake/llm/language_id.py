"""Language identification by averaged hashed subword embeddings (operator 1).

The letters of a text are lower-cased and everything else counts as a word
boundary.  All character n-grams of words, with their boundaries, are hashed
to rows of an embedding table; a text is the mean of its rows, and a linear
softmax gives the language.  The table and the softmax are trained by
stochastic gradient descent in numpy on the driver, from a sample of labelled
rows whose size is a parameter.  One more class, which is never a prediction,
learns what no language looks like from the same texts with their letters
shuffled.

Scores are calibrated on rows kept apart (whole texts, snippets, single words,
and shuffled ones): first a temperature, then the threshold under which a text
is rejected.  At most ``reject_share`` of the rightly named rows stay under it; below
that it lies half way (of the logarithms) to the scores of the shuffled rows.

What was never learned (other languages and scripts, codes) may fall on any side of the softmax.  So the
n-grams of the learned rows are remembered by a finer hash, and a text is also rejected
if it has more unknown ones than the rows kept apart make plausible: over four
standard deviations, and three, above the share that all but ``reject_share`` of them stay under.

Null texts and texts without a letter get ``und``, score 0, and are rejected.
Rows without a language are predicted but not learned from.  Without any
labelled row, every text is ``und``.  Very long texts are taken whole, in
pieces.  Repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.llm._rows import map_texts, stream

UNKNOWN = "und"
BITS = 15
#: Bits of the finer hash, whose first ones are the bucket's.
FINE = 20
ORDERS = (2, 3, 4)
DIMENSIONS = 16
#: Code points that are hashed at once.
PIECE = 400_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 where it is none."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(chars: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each start; ``1 << BITS`` where it holds no letter or spans words."""
    return fine(chars, n) >> (FINE - BITS)


def fine(chars: np.ndarray, n: int) -> np.ndarray:
    """The same by the finer hash, ``1 << FINE`` instead."""
    count = len(chars) - n + 1
    h = chars[:count] * np.uint32(0x9E3779B1)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[k : k + count]
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    out = (h >> np.uint32(32 - FINE)).astype(np.int32)
    if n == 2:
        wrong = (chars[:count] == 32) & (chars[1:] == 32)
    else:
        wrong = chars[1 : 1 + count] == 32
        for k in range(2, n - 1):
            wrong |= chars[k : k + count] == 32
    out[wrong] = 1 << FINE
    return out


@dataclass(frozen=True)
class Model:
    """``table``: a row of class scores for each bucket, the last one zero; the last class is no language.  ``seen``: whether a finer hash was learned."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray
    rate: float

    def sums(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, int, bool]]:
        """For each text: summed class scores, n-grams, those that weren't learned, whether it has a letter."""
        known, width, none = letters(), max(ORDERS), 1 << FINE
        piece = max(20_000, min(PIECE, 8_000_000 // max(1, len(self.languages))))
        for text in texts:
            chars = known[np.concatenate(([32], code_points(text), [32]))]
            total, grams, new = np.zeros(len(self.bias)), 0, 0
            has = bool((chars != 32).any())
            for a in range(0, len(chars) if has else 0, piece):
                part = chars[a : a + piece + width - 1]
                for n in ORDERS:
                    if len(part) >= n:
                        b = fine(part, n)[:piece]
                        total += self.table[b >> (FINE - BITS)].sum(axis=0, dtype=np.float64)
                        own = int((b != none).sum())
                        grams, new = grams + own, new + own - int(self.seen[b].sum())
            yield total, grams, new, has

    def strange(self, grams: int, new: int) -> bool:
        """Whether a text has more unknown n-grams than texts of the learned languages have."""
        expected = self.rate * grams
        return new > expected + 4 * expected**0.5 + 3

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether the text is rejected."""
        names, scores, rejected = [], [], []
        for total, grams, new, has in self.sums(texts):
            if not has or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            p = softmax((total / max(1, grams) + self.bias) / self.temperature)[: len(self.languages)]
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(p[best]))
            rejected.append(scores[-1] < self.threshold or self.strange(grams, new))
        return names, scores, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    chars = letters()[np.concatenate(([32], code_points(text), [32]))]
    every = np.concatenate([buckets(chars, n) for n in ORDERS if len(chars) >= n] or [np.zeros(0, np.int32)])
    found, counts = np.unique(every[every < 1 << BITS], return_counts=True)
    return found, (counts / max(1, counts.sum())).astype(np.float32)


def grams_of(text: str) -> np.ndarray:
    """The finer hashes of all n-grams of a text."""
    chars = letters()[np.concatenate(([32], code_points(text), [32]))]
    every = np.concatenate([fine(chars, n) for n in ORDERS if len(chars) >= n] or [np.zeros(0, np.int32)])
    return every[every < 1 << FINE]


def shuffled(text: str, draw: np.random.Generator) -> str:
    """The text with its letters in another order; all else stays in its place."""
    chars = np.array(list(text))
    at = np.flatnonzero([c.isalpha() for c in text])
    chars[at] = chars[draw.permutation(at)]
    return "".join(chars)


def examples(text: str, draw: np.random.Generator) -> list[tuple[str, bool]]:
    """What is learned from a text: itself, a snippet, one or two words; and one of them shuffled."""
    at = int(draw.integers(0, max(1, len(text) - 40)))
    words = text.split()
    first = int(draw.integers(0, max(1, len(words))))
    own = [text, text[at : at + int(draw.integers(20, 200))], " ".join(words[first : first + int(draw.integers(1, 3))])]
    return [*((x, True) for x in own), (shuffled(own[int(draw.integers(0, 2))][:2000], draw), False)]


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 1.0, seed: int = 7, reject_share: float = 0.002) -> Model:
    """Fit on four fifths of the rows; calibrate on the others."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros((1 << FINE) + 1, bool), 0.0)
    draw = np.random.default_rng(seed)
    number = {name: k for k, name in enumerate(names)}
    classes = len(names) + 1
    rows, seen, apart = [], np.zeros((1 << FINE) + 1, bool), []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        for x, real in examples(text, draw):
            f = features(x)
            if len(f[0]):
                rows.append((f, number[lang] if real else len(names), i % 5 == 0))
            if i % 5 or len(texts) < 5:
                if real:
                    seen[grams_of(x)] = True
            elif real:
                apart.append(x)
    seen[-1] = False
    counts = [(len(g), int(len(g) - seen[g].sum())) for g in map(grams_of, apart)]
    rates = sorted(new / n for n, new in counts if n >= 100)
    unknown = max(0.005, rates[min(len(rates) - 1, int((1 - reject_share) * len(rates)))] if rates else 1.0)
    embed = ((draw.random((1 << BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    fit = [r for r in rows if not r[2]] or rows
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in draw.permutation(len(fit)):
            (found, share), label, _ = fit[k]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ embed[found]
            error = softmax(mean @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            # Rows of short texts have large shares; steps of theirs are held back.
            embed[found] -= (step * np.minimum(50 * share, 0.5))[:, None] * back
    table = np.vstack([embed @ weights, np.zeros((1, classes))]).astype(np.float32)
    kept = [r for r in rows if r[2]] or rows
    z = np.array([share @ table[found] + bias for (found, share), _, _ in kept])
    y = np.array([label for _, label, _ in kept])
    heats = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = softmax(z / heat)[:, : len(names)]
    top, best = p.max(axis=1), p.argmax(axis=1)
    right, none = np.sort(top[best == y]), top[y == len(names)]
    limit = float(right[int(reject_share * len(right))]) if len(right) else 0.0
    below = float(np.quantile(none, 0.95)) if len(none) else limit
    return Model(names, table, bias.astype(np.float64), heat, float(np.sqrt(limit * below)) if below < limit else limit, seen, unknown)


def sample(docs: DataFrame, usable: Column, total_rows: int, longest: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """About ``total_rows`` labelled rows (20 for each language at least), evenly over the languages, chosen by a hash of the identifier."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull())
    # One row for each language.
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not sizes:
        return [], []
    each = max(20, total_rows // len(sizes))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, size in sorted(sizes.items()) for x in (lang, min(1.0, each / size)))), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    got = labelled.where((draw < share) & (F.length(text_col) <= longest) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).toArrow()
    rows = sorted(zip(got["i"].to_pylist(), got["t"].to_pylist(), got["l"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    return [r[1] for r in rows], [r[2] for r in rows]


def fit(docs: DataFrame, usable: Column | None = None, total_rows: int = 2400, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on about ``total_rows`` (the bound of the sample, or 20 rows for each language if that is more) of the ``usable`` rows of at most ``longest`` characters."""
    return train(*sample(docs, F.lit(True) if usable is None else usable, total_rows, longest, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a number for each language

    def start():
        own = held.value

        def work(rest, texts):
            return [rest[0], *own.predict([t or "" for t in texts])]

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, "doc_id long, lang_pred string, score double, rejected boolean", schema, start)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't reject."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            rejected = own.predict([t or "" for t in batch.column(text_col).to_pylist()])[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return stream(docs, run, docs.schema)
