"""Language ID (operator 7): a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, others

#: Bytes of a window; dimensions of a byte's embedding; widths of the filters, and filters of each width.
WINDOW, DIM, WIDTHS, FILTERS = 256, 4, (3, 4, 5), 8
#: Labelled documents of each language that the network is trained on, at most; windows of each, at most; passes.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS = 600, 6, 6
LEAST_STEPS = 300
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """Embedding (256, DIM), filters (max width * DIM, all filters; narrow ones end in zeros), dense layer, labels."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray
    labels: list[str]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows (n, WINDOW) uint8: each filter's greatest response, its place, and the unfolded inputs."""
        n, wide = len(windows), max(WIDTHS)
        e = self.emb[windows].reshape(n, WINDOW * DIM)
        cols = np.lib.stride_tricks.sliding_window_view(e, wide * DIM, axis=1)[:, ::DIM]
        r = cols.reshape(-1, wide * DIM) @ self.conv
        r = r.reshape(n, WINDOW - wide + 1, -1)
        at = r.argmax(1) if self.training else None
        return np.maximum(r.max(1) + self.bias, 0), at, cols

    training = False

    def log_probs(self, windows: np.ndarray, batch: int = 512) -> np.ndarray:
        out = []
        for i in range(0, len(windows), batch):
            z = self.pooled(windows[i : i + batch])[0] @ self.dense + self.out
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as windows of WINDOW bytes, the last padded with spaces."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def spread(text: bytes) -> np.ndarray:
    """Up to TRAIN_WINDOWS windows, evenly spread over the whole text."""
    w = windows_of(text)
    return w[np.unique(np.linspace(0, len(w) - 1, TRAIN_WINDOWS).astype(int))]


def train(picked: list[np.ndarray], langs: list[str], *, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01) -> ByteCnn | None:
    """A network fitted by Adam on the windows picked from each text; None without labels."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x, y = np.concatenate(picked), np.repeat([labels.index(lang) for lang in langs], [len(w) for w in picked])
    wide, k = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1).repeat(DIM, 0).astype(np.float32)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    m = ByteCnn(f32(256, DIM, scale=1), f32(wide * DIM, k, scale=0.2) * mask, np.zeros(k, np.float32), f32(k, len(labels), scale=0.2), np.zeros(len(labels), np.float32), labels)
    m.training = True
    weights = ["emb", "conv", "bias", "dense", "out"]
    m1, m2, t = {w: np.zeros_like(getattr(m, w)) for w in weights}, {w: np.zeros_like(getattr(m, w)) for w in weights}, 0
    each = 1 / np.bincount(y, minlength=len(labels))  # classes weigh alike
    for _ in range(max(epochs, -(-LEAST_STEPS * 64 // max(1, len(x))))):  # small samples get more passes
        order = rng.permutation(len(x))
        for i in range(0, len(x), 64):
            b, yb = x[order[i : i + 64]], y[order[i : i + 64]]
            h, at, cols = m.pooled(b)
            z = h @ m.dense + m.out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), yb] -= 1
            p *= (each[yb] / each[yb].sum())[:, None]
            p = p.astype(np.float32)
            dh = (p @ m.dense.T) * (h > 0)  # (n, k): reaches the inputs of each filter's greatest response
            seen = np.take_along_axis(cols, at[:, :, None], 1)  # (n, k, wide * DIM)
            grad = {"dense": h.T @ p, "out": p.sum(0), "bias": dh.sum(0), "conv": np.einsum("nkd,nk->dk", seen, dh) * mask}
            back = (dh[:, :, None] * m.conv.T[None]).reshape(len(b), k, wide, DIM)
            where = np.take_along_axis(b[:, None, :].repeat(k, 1), at[:, :, None] + np.arange(wide), 2)
            grad["emb"] = np.zeros_like(m.emb)
            np.add.at(grad["emb"], where.ravel(), back.reshape(-1, DIM))
            t += 1
            for w in weights:
                m1[w] = 0.9 * m1[w] + 0.1 * grad[w]
                m2[w] = 0.999 * m2[w] + 0.001 * grad[w] ** 2
                setattr(m, w, (getattr(m, w) - rate * (m1[w] / (1 - 0.9**t)) / (np.sqrt(m2[w] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    m.training = False
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2: never learnt from. Null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> ByteCnn | None:
    """A network trained on at most `per_lang` labelled documents of each language that are not held out.

    Those with the smallest hash of their id are taken: a ranking over ids and hashes of texts alone picks them, then a
    second scan fetches their texts. Rows that agree in id and text count once. This sample's bound is the number of
    languages times `per_lang`. Rows with a null id, text or language, or without a letter, are not learnt from.
    """
    ids = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.col(lang_col).alias("l"))
    # a language's rows are first thinned by hash to about four times what is wanted, so that no ranking sees many
    n = F.broadcast(ids.groupBy("l").count())  # one row a language, as the network has
    share = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / (1 << 30)
    ids = ids.join(n, "l").where(share * F.col("count") <= 4 * per_lang).select("i", "t", "l").distinct()
    w = Window.partitionBy("l").orderBy(share, "i", "t")
    ids = ids.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_lang).select("i", "t").distinct()
    found = (F.col(id_col) == F.col("i")) & (F.xxhash64(text_col) == F.col("t"))
    taken = docs.join(F.broadcast(ids), found, "left_semi").where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))

    @F.pandas_udf("binary")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spread(t.encode()).tobytes())

    rows = taken.select(F.col(id_col).alias("i"), windows(text_col).alias("w"), F.col(lang_col).alias("l")).distinct().toPandas()
    rows = rows.sort_values(["i", "w", "l"], kind="stable")
    return train([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in rows["w"]], rows["l"].tolist())


def identify(docs: DataFrame, model: ByteCnn | None, *, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score: the language of greatest mean log-probability over all windows of the
    whole text, and its share (softmax of the means).

    `und` with score 0 for a null text, one without a letter, or without a model. Rows are independent;
    repeated rows and extra columns pass through (columns of the same names are replaced).
    """

    def predict(batches):
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if model and t is not None and any(map(str.isalpha, t))]
            for some in _groups(todo, texts):
                parts = [windows_of(texts.iloc[i].encode()) for i in some]
                lp = model.log_probs(np.concatenate(parts))
                firsts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                mean = np.add.reduceat(lp.astype(np.float64), firsts, axis=0) / np.array([len(p) for p in parts])[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for j, i in enumerate(some):
                    langs[i], scores[i] = model.labels[int(p[j].argmax())], min(1.0, float(p[j].max()))
            yield pd.DataFrame({"lang": langs, "score": scores})

    @F.pandas_udf("lang string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return predict(batches)

    (own,) = fresh(docs, "told")
    rest = others(docs, "lang_pred", "score")
    return docs.select(*rest, told(F.col(text_col)).alias(own)).select(*rest, F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score"))


def _groups(rows: list[int], texts: pd.Series, most: int = 1 << 20):
    """Rows in groups of about `most` characters of text."""
    group, n = [], 0
    for i in rows:
        group.append(i)
        n += len(texts.iloc[i])
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group
