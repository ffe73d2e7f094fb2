"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of one segment in both directions and gives every
position a distribution over the learned languages. Segments are the words of a text
(runs of bytes other than ASCII white space), cut every 24 bytes. A document's probability
of a language is the mean over all its positions; the largest is its label and score.
Within a segment the labels depend on its bytes only, so a task computes each distinct
segment once and keeps a bounded number of them. Whole texts are read.

The network is trained in numpy by backpropagation through time, on the driver, from a
bounded sample: ``TRAIN_DOCS`` documents of each language (chosen by a hash of the id, at
most ``MAX_LANGUAGES`` languages, the most frequent ones) with ``TRAIN_SEGMENTS`` segments
each. Only text and language are learned from, and a prediction sees text only.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no
labelled document exists. Rows without an id are not learned from and not held out. Equal
texts get equal predictions; of equal probabilities the first language by name wins. An
empty table gives an empty table. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import annotate, slices

HIDDEN = 16
SEGMENT = 24             # bytes of a segment at most
TRAIN_DOCS = 300         # expected documents of each language that are learned from
TRAIN_SEGMENTS = 40      # segments of each of them
MAX_LANGUAGES = 64
EPOCHS = 6
BATCH = 256
RATE = 0.01
SEED = 7
CACHED = 400_000         # segments whose result a task keeps
LETTER = re.compile("[A-Za-z]")
ADDED = "lang_pred string, score double"


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def segments(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    if max(map(len, words), default=0) <= SEGMENT:
        return words
    return [w[i:i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (positions, words), 256 beyond the end, and the words' lengths."""
    size = np.array([len(w) for w in words])
    out = np.full((len(words), size.max(initial=1)), 256, np.int64)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = np.frombuffer(b"".join(words), np.uint8)
    return out.T.copy(), size


def backwards(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of every word in reverse order; what lies beyond the end stays."""
    at = np.arange(len(rows))[:, None]
    return np.take_along_axis(rows, np.where(at < size, size - 1 - at, at).reshape(
        at.shape[0], -1, *[1] * (rows.ndim - 2)), axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers, one for each direction, under one softmax."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED,
                 kind: type = np.float32):
        rng, h, n = np.random.default_rng(seed), hidden, len(languages)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(kind)
        self.weights = {
            "in_f": draw(257, 3 * h, scale=0.3), "in_b": draw(257, 3 * h, scale=0.3),
            "re_f": draw(h, 3 * h, scale=h ** -0.5), "re_b": draw(h, 3 * h, scale=h ** -0.5),
            "out": draw(2 * h, n, scale=(2 * h) ** -0.5), "bias": np.zeros(n, kind)}

    def scan(self, rows: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States of one direction, (positions, words, hidden), and what going back needs."""
        h, inner, outer = self.hidden, self.weights["re_" + way], self.weights["in_" + way][rows]
        state = np.zeros((rows.shape[1], h), outer.dtype)
        states, kept = np.empty((*rows.shape, h), outer.dtype), []
        for t, given in enumerate(outer):
            own = state @ inner
            gates = sigmoid(given[:, :2 * h] + own[:, :2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, 2 * h:] + reset * own[:, 2 * h:])
            kept.append((state, update, reset, new, own[:, 2 * h:]))
            state = new + update * (state - new)
            states[t] = state
        return states, kept

    def label(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Probabilities of every position, the joined states, and what going back needs."""
        ahead, kept_f = self.scan(rows, "f")
        behind, kept_b = self.scan(backwards(rows, size), "b")
        joined = np.concatenate((ahead, backwards(behind, size)), axis=2)
        scores = joined @ self.weights["out"] + self.weights["bias"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True), joined, (kept_f, kept_b)

    def ahead(self, rows: np.ndarray, way: str) -> np.ndarray:
        """States of one direction over words of one length, nothing kept for going back."""
        h, inner, outer = self.hidden, self.weights["re_" + way], self.weights["in_" + way]
        state = np.zeros((rows.shape[1], h), inner.dtype)
        states = np.empty((*rows.shape, h), inner.dtype)
        for t, read in enumerate(rows):
            given, own = outer[read], state @ inner
            gates = given[:, :2 * h]
            gates += own[:, :2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = own[:, 2 * h:]
            new *= gates[:, h:]
            new += given[:, 2 * h:]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:, :h]
            state += new
            states[t] = state
        return states

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Sum over each word's positions of their probabilities, (words, languages)."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        size = np.array([len(words[i]) for i in order])
        cuts = [0, *(np.nonzero(np.diff(size))[0] + 1).tolist(), len(order)]
        for low, high in zip(cuts, cuts[1:]):
            for at in range(low, high, 2048):
                chosen = order[at:min(at + 2048, high)]
                rows = np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8).reshape(
                    len(chosen), -1).T
                scores = self.ahead(rows, "f") @ self.weights["out"][:self.hidden]
                scores += self.ahead(rows[::-1], "b")[::-1] @ self.weights["out"][self.hidden:]
                scores += self.weights["bias"]
                scores -= scores.max(axis=2, keepdims=True)
                np.exp(scores, out=scores)
                scores /= scores.sum(axis=2, keepdims=True)
                out[chosen] = scores.sum(axis=0)
        return out

    def gradients(self, words: list[bytes], labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions and its gradients, back through time."""
        rows, size = padded(words)
        found, joined, kept = self.label(rows, size)
        inside = (np.arange(len(rows))[:, None] < size).astype(found.dtype)
        total = inside.sum()
        picked = np.take_along_axis(found, labels[None, :, None], axis=2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-30) * inside).sum() / total)
        error = found * inside[:, :, None] / total
        np.put_along_axis(error, labels[None, :, None],
                          np.take_along_axis(error, labels[None, :, None], axis=2)
                          - (inside / total)[:, :, None], axis=2)
        flat = error.reshape(-1, error.shape[2])
        grads = {"out": joined.reshape(len(flat), -1).T @ flat, "bias": flat.sum(axis=0)}
        down, h = error @ self.weights["out"].T, self.hidden
        for way, mine, read in (("f", down[:, :, :h], rows),
                                ("b", backwards(down[:, :, h:], size), backwards(rows, size))):
            grads["in_" + way], grads["re_" + way] = self.back(
                mine, kept[way == "b"], read, way)
        return loss, grads

    def back(self, down: np.ndarray, kept: list, rows: np.ndarray,
             way: str) -> tuple[np.ndarray, np.ndarray]:
        inner = self.weights["re_" + way]
        given, re_grad = np.zeros((*rows.shape, inner.shape[1]), down.dtype), np.zeros_like(inner)
        carry = np.zeros_like(down[0])
        for t in range(len(rows) - 1, -1, -1):
            state, update, reset, new, own = kept[t]
            carry = carry + down[t]
            d_new = carry * (1 - update) * (1 - new * new)
            d_update = carry * (state - new) * update * (1 - update)
            d_reset = d_new * own * reset * (1 - reset)
            given[t] = np.concatenate((d_update, d_reset, d_new), axis=1)
            inward = np.concatenate((d_update, d_reset, d_new * reset), axis=1)
            re_grad += state.T @ inward
            carry = carry * update + inward @ inner.T
        in_grad = np.zeros_like(self.weights["in_" + way])
        np.add.at(in_grad, rows.reshape(-1), given.reshape(-1, given.shape[2]))
        return in_grad, re_grad

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        """Adam over shuffled batches of words of like length; mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(SEED), [], 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        length = np.array([len(w) for w in words])
        for epoch in range(epochs):
            order = rng.permutation(len(words))
            order = order[np.argsort(length[order], kind="stable")]
            batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
            losses.append(0.0)
            for b in rng.permutation(len(batches)):
                chosen = batches[b]
                loss, grads = self.gradients([words[i] for i in chosen], labels[chosen])
                losses[-1] += loss / len(batches)
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    move = first[k] / (1 - 0.9 ** step) / (
                        np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                    self.weights[k] -= (RATE * (1 - epoch / epochs) * move).astype(move.dtype)
        return losses


def held_out(id_column: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def training_segments(df: DataFrame, text: str, lang: str,
                      id_column: str) -> tuple[list[bytes], list[str]]:
    """Segments and languages of a bounded sample of the documents that may be learned from."""
    open_ = df.where(~held_out(id_column) & F.col(id_column).isNotNull()
                     & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = (open_.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect())
    if not counts:
        return [], []
    share = F.lit(None).cast("double")
    for r in counts:
        share = F.when(F.col(lang) == r["lang"], F.lit(min(1.0, TRAIN_DOCS / r["n"]))).otherwise(
            share)
    drawn = F.pmod(F.xxhash64(id_column, F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, names, rows = [], [], []
            for key, value, name in zip(*(part.column(i).to_pylist() for i in range(3))):
                own = segments(value)
                rng = np.random.default_rng(zlib.crc32(str(key).encode()))
                for i in rng.permutation(len(own))[:TRAIN_SEGMENTS].tolist():
                    words.append(own[i])
                    names.append(name)
                    rows.append(f"{key}:{i}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(names, pa.string()),
                 pa.array(rows, pa.string())], names=["word", "lang", "at"])

    found = (open_.where(drawn < share).select(id_column, text, lang)
             .mapInArrow(run, "word binary, lang string, at string").collect())
    found.sort(key=lambda r: (r["lang"], r["at"], r["word"]))    # tasks end in any order
    return [bytes(r["word"]) for r in found], [r["lang"] for r in found]


def train_language_model(df: DataFrame, text: str = "text", lang: str = "lang",
                         id_column: str = "doc_id") -> Network | None:
    words, names = training_segments(df, text, lang, id_column)
    if not words:
        return None
    languages = sorted(set(names))
    network = Network(languages)
    network.train(words, np.array([languages.index(n) for n in names]))
    return network


def predictor(network: Network | None):
    """Function from texts to (language, score)."""
    known: dict[bytes, int] = {}
    table = [np.zeros((0, 0))]

    def learn(words: list[bytes]) -> None:
        if len(known) + len(words) > CACHED:
            known.clear()
            table[0] = np.zeros((0, len(network.languages)))
        known.update({w: len(known) + i for i, w in enumerate(words)})
        table[0] = np.concatenate((table[0].reshape(-1, len(network.languages)),
                                   network.pooled(words)))

    def label(own: list[bytes]) -> tuple[str, float]:
        total, positions = np.zeros(len(network.languages)), 0
        for at in range(0, len(own), CACHED // 4):     # a text may hold more than the cache
            part = own[at:at + CACHED // 4]
            fresh = [w for w in dict.fromkeys(part) if w not in known]
            if fresh:
                learn(fresh if len(known) + len(fresh) <= CACHED else list(dict.fromkeys(part)))
            rows = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
            total += table[0][rows].sum(axis=0)
            positions += sum(map(len, part))
        best = int(total.argmax())
        score = round(float(total[best]) / positions, 6)   # beyond that, batches differ
        return network.languages[best], min(1.0, max(0.0, score))

    def work(texts: list[str]) -> list[tuple]:
        rows = [segments(t) if network and has_letter(t) else None for t in texts]
        fresh = [w for w in dict.fromkeys(w for own in rows if own for w in own)
                 if w not in known]
        if fresh and len(known) + len(fresh) <= CACHED:
            learn(fresh)
        return [("und", 0.0) if own is None else label(own) for own in rows]

    return work


def predict_language(df: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    return annotate(df, text, ADDED, lambda: predictor(network))
