"""Language identification by a byte convolutional network.

Texts, in UTF-8 with A-Z lower-cased, are cut into windows of a fixed number of bytes, the last one padded with zeros.
Bytes are embedded, filters of several widths run over each window, the maximum of every filter over the
window goes through a rectifier and a softmax layer. A text's probabilities are the means over all its windows, weighted by their bytes.

The network is trained in numpy on the driver, on a bounded sample of labelled texts: at most ``docs_per_lang`` texts of each
language, chosen by a hash of the key, with one window of each at a hashed place. For prediction the
embedding and the filters are multiplied out into tables over pairs of bytes, so a filter's response is a sum of table rows;
that is the same function, without matrix products for each byte.

Prediction reads text only. Texts aren't shuffled and whole texts are read; memory is that of a slab of windows.

Nulls and edge cases: a text that is null, empty or without a letter is ``und`` with score 0; a null key is neither held out nor
learnt from; a null language is not learnt from; without labelled texts everything is ``und``; repeated rows get the same prediction; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm._common import map_texts, read_table

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    window: int = 512
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 5)
    filters: int = 8
    #: Bound of the training sample: texts of each language.
    docs_per_lang: int = 1500
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


class ByteNet:
    def __init__(self, langs: list[str], cfg: LanguageConfig):
        self.langs, self.cfg, rng = langs, cfg, np.random.default_rng(cfg.seed)
        self.params = {"embed": rng.normal(0, 0.5, (256, cfg.embedding))}
        for w in cfg.widths:
            self.params[f"conv{w}"] = rng.normal(0, (2 / (w * cfg.embedding)) ** 0.5, (w, cfg.embedding, cfg.filters))
            self.params[f"bias{w}"] = np.zeros(cfg.filters)
        n = len(cfg.widths) * cfg.filters
        self.params |= {"out": rng.normal(0, n**-0.5, (n, len(langs))), "out_bias": np.zeros(len(langs))}
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam on the cross-entropy. windows: uint8, one row each."""
        rng, cfg, p = np.random.default_rng(self.cfg.seed), self.cfg, self.params
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(cfg.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), cfg.batch):
                rows = order[at : at + cfg.batch]
                batch = windows[rows].copy()
                # Half of the windows are cut short, as the last ones of texts are.
                for i in np.flatnonzero(rng.random(len(rows)) < 0.5):
                    batch[i, rng.integers(16, cfg.window) :] = 0
                t += 1
                for k, g in self._gradients(batch, labels[rows]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= cfg.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, batch: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, cfg, n, f = self.params, self.cfg, len(batch), self.cfg.filters
        x = p["embed"][batch]
        pooled, places = [], {}
        for w in cfg.widths:
            length = cfg.window - w + 1
            z = sum(x[:, j : j + length] @ p[f"conv{w}"][j] for j in range(w))
            places[w] = z.argmax(1)
            pooled.append(np.take_along_axis(z, places[w][:, None], 1)[:, 0] + p[f"bias{w}"])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        probs = softmax(hidden @ p["out"] + p["out_bias"])
        d = probs.copy()
        d[np.arange(n), labels] -= 1
        d /= n
        g = {"out": hidden.T @ d, "out_bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        down = (d @ p["out"].T) * (raw > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(cfg.widths):
            dz = down[:, i * f : (i + 1) * f]
            g[f"bias{w}"], g[f"conv{w}"] = dz.sum(0), np.empty_like(p[f"conv{w}"])
            for j in range(w):  # only the place of the maximum has a gradient
                there = batch[rows, places[w] + j]
                g[f"conv{w}"][j] = np.einsum("nf,nfe->ef", dz, p["embed"][there])
                np.add.at(g["embed"], there, dz[:, :, None] * p[f"conv{w}"][j].T[None])
        return g

    @functools.cached_property
    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width: offsets, and the responses to each pair of bytes there."""
        out = {}
        for w in self.cfg.widths:
            by_byte = [self.params["embed"] @ self.params[f"conv{w}"][j] for j in range(w)]
            pairs = [(j, by_byte[j][:, None] + by_byte[j + 1][None]) for j in range(0, w - 1, 2)]
            if w % 2:  # the last byte, as the second of its pair
                pairs.append((w - 2, np.broadcast_to(by_byte[-1][None], (256, 256, self.cfg.filters))))
            out[w] = [(j, np.ascontiguousarray(t.reshape(65536, -1), dtype=np.float32)) for j, t in pairs]
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.intp) << 8
        pairs |= windows[:, 1:]
        pooled = []
        for w in self.cfg.widths:
            length = self.cfg.window - w + 1
            z = None
            for j, table in self.tables[w]:
                part = table.take(pairs[:, j : j + length].ravel(), axis=0)
                z = part if z is None else np.add(z, part, out=z)
            pooled.append(z.reshape(len(windows), length, -1).max(1) + self.params[f"bias{w}"])
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        return softmax(hidden @ self.params["out"] + self.params["out_bias"])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, x in enumerate(texts) if self.langs and has_letter(x)]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not known:
            return langs, scores
        size, data = self.cfg.window, [texts[i].encode().lower() for i in known]
        counts = np.array([-(-len(b) // size) for b in data])
        flat = np.zeros((int(counts.sum()), size), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        for b, at in zip(data, starts):
            flat.reshape(-1)[at * size : at * size + len(b)] = np.frombuffer(b, dtype=np.uint8)
        probs = np.concatenate([self.probabilities(flat[i : i + 64]) for i in range(0, len(flat), 64)])
        weights = np.full(len(flat), size, dtype=np.float64)
        weights[starts + counts - 1] = [len(b) - size * (n - 1) for b, n in zip(data, counts)]
        means = np.add.reduceat(probs * weights[:, None], starts) / np.add.reduceat(weights, starts)[:, None]
        for i, row in zip(known, means):
            best = int(row.argmax())
            langs[i], scores[i] = self.langs[best], min(1.0, float(row[best]))
        return langs, scores


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.lru_cache(maxsize=2)
def _load(model: bytes) -> ByteNet:
    return pickle.loads(model)


def train(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteNet:
    """Train on docs; which of them is the caller's choice."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(cfg.seed), F.col(key)).alias("u"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("key").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # A hash threshold gives about the bound, twice over, without a sort; the exact bound is applied to what it leaves.
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2 * cfg.docs_per_lang / n))).otherwise(share)
    rows = rows.where((F.col("u") / F.lit(2.0**64) + 0.5) < share)
    place = F.pmod(F.xxhash64("u"), F.greatest(F.lit(1), F.length("text") - cfg.window)) + 1
    sample = sorted((r["lang"], r["u"], r["key"], r["piece"]) for r in rows.select("lang", "u", "key", F.substr("text", place.cast("int"), F.lit(cfg.window)).alias("piece")).collect())
    langs, pieces, labels, taken = [], [], [], 0
    for name, _, _, piece in sample:
        if not langs or langs[-1] != name:
            langs.append(name)
            taken = 0
        taken += 1
        data = piece.encode().lower()[: cfg.window]
        if taken <= cfg.docs_per_lang:
            pieces.append(np.frombuffer(data.ljust(cfg.window, b"\0"), dtype=np.uint8))
            labels.append(len(langs) - 1)
    net = ByteNet(langs, cfg)
    return net.fit(np.stack(pieces), np.array(labels)) if langs else net


def predict(docs: DataFrame, net: ByteNet, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns in keep, lang_pred and score."""
    model = pickle.dumps(net)
    return map_texts(docs, text, keep, "lang_pred string, score double", lambda texts: _load(model).predict(texts))


def keep_identified(docs: DataFrame, net: ByteNet, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs whose language is determined with a score of least or more."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = predict(docs.withColumnsRenamed(names), net, tuple(names.values()), names[text])
    rows = rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), net, ("doc_id", "held_out"))
