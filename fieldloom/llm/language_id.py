"""Language ID: a byte convolutional network with filters of several widths, max pooling and softmax, in numpy.

Learning: a bounded sample of labelled texts (``sample`` texts in all, chosen by a hash of the text, equal
shares for each language) is cut into windows of ``window`` bytes; at most WINDOWS_A_TEXT of each text reach the driver,
where the network is trained by Adam.
Prediction: every whole text is cut into windows, batches of windows run through the network, and a text's
probabilities are the mean of its windows', weighted by their letters. No shuffle.

As a filter sees one-hot bytes, its answer at a place is a sum of table entries; for speed, prediction adds
entries of tables for pairs of bytes. Bytes are classed first: letters without case, digits, spaces, punctuation, and every byte
from 0x80 up by itself.

Edge cases: a text that is null or has no letter (of Unicode's category L) is ``und`` with score 0; so is every text if
no labelled row exists; an empty table gives an empty result; repeated rows get equal answers and a text counts once in
learning; of languages with equal chances the first by name is taken; columns named like results are replaced, others stay.
Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import give_back, without

UNKNOWN = "und"
WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
#: Labelled texts to learn from, and the most windows of one text.
SAMPLE, WINDOWS_A_TEXT = 1600, 8
LETTER = regex.compile(r"\p{L}")


def _classes() -> np.ndarray:
    of = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b)
        of[b] = 3 + ord(c.lower()) - 97 if b < 128 and c.isalpha() else 0 if b <= 32 else 1 if b < 128 and c.isdigit() else 2 if b < 128 else b - 128 + 29
    return of


CLASS = _classes()
K = 29 + 128
IS_LETTER = (np.arange(K) >= 3)


def windows(texts: list[str], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of all windows of all texts (n, size), and the number of windows of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(b) // size)) for b in raw], np.int64)
    joined = b"".join(b.ljust(n * size, b" ") for b, n in zip(raw, counts, strict=True))
    return CLASS[np.frombuffer(joined, np.uint8)].reshape(-1, size), counts


class Network:
    """Tables of each width and offset (K, FILTERS), a bias for each width, and a dense layer to the languages."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.1, (w, K, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out = np.zeros(len(languages), np.float32)
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _params(self) -> list[np.ndarray]:
        return [*self.tables.values(), *self.bias.values(), self.dense, self.out]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        params = self._params()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        lanes = np.arange(FILTERS)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                c, n = x[rows], len(rows)
                pooled, where = [], {}
                for w in WIDTHS:
                    s = sum(self.tables[w][o][c[:, o : c.shape[1] - w + 1 + o]] for o in range(w))
                    where[w] = s.argmax(1)
                    pooled.append(np.take_along_axis(s, where[w][:, None], 1)[:, 0] + self.bias[w])
                h = np.concatenate(pooled, 1)
                a = np.maximum(h, 0)
                z = a @ self.dense + self.out
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                grads: list[np.ndarray] = []
                for k, w in enumerate(WIDTHS):
                    g, d = np.zeros_like(self.tables[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(g[o], (np.take_along_axis(c, where[w] + o, 1), lanes[None]), d)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [a.T @ p + 1e-4 * self.dense, p.sum(0)]
                step += 1
                for v, g, m, s2 in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s2 += 0.001 * (g * g - s2)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8)
        return self

    def _pair_tables(self):
        if self._pairs is None:
            t = self.tables
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(K * K, FILTERS)
            self._pairs = pair(t[2][0], t[2][1]), pair(t[3][0], t[3][1]), t[3][2], pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3])
        return self._pairs

    def probabilities(self, c: np.ndarray, lot: int = 64) -> np.ndarray:
        """Softmax of each window, a lot of windows at a time."""
        two, three, third, four, fourth = self._pair_tables()
        out = np.empty((len(c), len(self.languages)), np.float32)
        for at in range(0, len(c), lot):
            x = c[at : at + lot]
            pairs = x[:, :-1] * K + x[:, 1:]
            h = np.concatenate(
                [
                    two.take(pairs, 0).max(1) + self.bias[2],
                    np.add(t := three.take(pairs[:, :-1], 0), third.take(x[:, 2:], 0), out=t).max(1) + self.bias[3],
                    np.add(t := four.take(pairs[:, :-2], 0), fourth.take(pairs[:, 2:], 0), out=t).max(1) + self.bias[4],
                ],
                1,
            )
            z = np.maximum(h, 0) @ self.dense + self.out
            p = np.exp(z - z.max(1, keepdims=True))
            out[at : at + lot] = p / p.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None], bytes_at_once: int = 4_000_000) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows: list[int] = []
        held = 0

        def run() -> None:
            c, counts = windows([texts[i] for i in rows])
            weight = IS_LETTER[c].sum(1) + 1e-3
            starts = np.concatenate([[0], counts.cumsum()[:-1]])
            p = np.add.reduceat(self.probabilities(c).astype(np.float64) * weight[:, None], starts)
            p /= p.sum(1, keepdims=True)
            for i, k, v in zip(rows, p.argmax(1), p.max(1), strict=True):
                langs[i], scores[i] = self.languages[k], min(1.0, v)

        for i, t in enumerate(texts):
            if t and LETTER.search(t) and self.languages:
                rows.append(i)
                held += len(t)
                if held >= bytes_at_once:
                    run()
                    rows, held = [], 0
        if rows:
            run()
        return langs, scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network:
    """Trains on at most ``sample`` different texts, in equal shares for each language.

    The shares are drawn by a hash of the text: only texts below a hash bound leave the executors, and
    copies of one text meet before they do.
    """

    @F.pandas_udf("binary")
    def some_windows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hashes in batches:
            out = []
            for t, h in zip(texts, hashes, strict=True):
                c, _ = windows([t])
                chosen = np.sort(np.random.default_rng(h & 0xFFFFFFFF).permutation(len(c))[:WINDOWS_A_TEXT])
                out.append(c[chosen].astype(np.uint8).tobytes() if LETTER.search(t) else None)
            yield pd.Series(out, dtype=object)

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text, F.lit(3)).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Network([])
    share = max(1, sample // len(counts))
    bound = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, 1.3 * share / max(1, n)))) for k, n in counts.items()], F.lit(0.0))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < bound * (1 << 20)).select("l", "h", some_windows("t", "h").alias("w"))
    kept = drawn.where("w is not null").groupBy("l", "h").agg(F.min("w").alias("w")).collect()
    languages, xs, ys = sorted(counts), [], []
    for k, name in enumerate(languages):
        for r in sorted((r for r in kept if r["l"] == name), key=lambda r: r["h"])[:share]:
            c = np.frombuffer(r["w"], np.uint8).astype(np.int32).reshape(-1, WINDOW)
            xs.append(c)
            ys.append(np.full(len(c), k))
    if not xs:
        return Network([])
    return Network(languages).train(np.concatenate(xs), np.concatenate(ys))


def identify(docs: DataFrame, model: Network, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; columns so named are replaced."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = model.predict([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang": langs, "score": scores})
        give_back()

    out = without(docs, name, score)
    return out.withColumn("_p", run(F.col(text))).select(*[F.col(c) for c in out.columns], F.col("_p.lang").alias(name), F.col("_p.score").alias(score))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
