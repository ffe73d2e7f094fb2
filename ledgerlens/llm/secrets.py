"""Secret scan: base patterns, and strings that a character Markov model calls random.

Two first-order character models are trained from labelled samples, one of random strings
and one of ordinary identifiers. A token is a secret if its log-likelihood ratio between
the two is high enough. Models are 2 x 67 x 67 smoothed counts. Without samples both are
uniform, the ratio is 0 and nothing is found beyond the base patterns.

Null text counts as empty and has no spans; repeated rows are scanned each for itself;
an empty table gives an empty table; input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER_BYTES, annotate, sha256_hex, slices

KINDS = ("assign", "access", "hex", "random")
# The base patterns; fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

# Characters of a token that may be random, and the class of every byte (66: any other).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
TOKEN_CHARS = ALPHABET.replace(".", "")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
STATES = len(ALPHABET) + 1
CLASS_OF = np.full(256, STATES - 1, np.int64)
CLASS_OF[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
TOKEN_BYTES = bytes(b if chr(b) in TOKEN_CHARS else 32 for b in range(256))

MIN_LENGTH = 16        # shortest token that is judged
MIN_RATIO = 12.0       # nats by which the random model must win
MIN_MEAN = 0.5         # and nats a character
SAMPLE_DOCS = 20_000   # documents that give labelled samples, chosen by a hash of the id
ORDINARY_PER_DOC = 40  # ordinary tokens taken from each of them

ADDED = ("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, "
         "spans string, found array<struct<kind:string,start:long,end:long>>")


def base_spans(text: str, long_token: bool) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns.

    ``long_token`` tells whether any token has 16 characters, as access and hex need.
    """
    spans = []
    low = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= 8]
    if long_token:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def has_long_token(text: str) -> bool:
    tokens = text.encode("utf-8", "surrogatepass").translate(TOKEN_BYTES).split()
    return max(map(len, tokens), default=0) >= MIN_LENGTH


def classes(token: str) -> np.ndarray:
    return CLASS_OF[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def transitions(token: str, counts: np.ndarray) -> None:
    """Adds the transitions of a token, its start from the last class included."""
    states = np.concatenate(([STATES - 1], classes(token)))
    np.add.at(counts, (states[:-1], states[1:]), 1)


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every transition.

    Both models shrink towards their own character shares, and those towards equal ones.
    """
    def model(counts):
        share = (counts.sum(axis=0) + 1) / (counts.sum() + STATES)
        return np.log((counts + STATES * share) / (counts.sum(axis=1, keepdims=True) + STATES))
    return model(random) - model(ordinary)


def train(samples: DataFrame) -> np.ndarray:
    """Ratio table from labelled samples (``token`` string, ``is_random`` boolean).

    Counts are added up in the tasks, so 2 x 67 x 67 numbers at most leave each of them
    and reach the driver. Null tokens and labels are left out.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES, STATES))
        for part in slices(batches, 4096):
            for token, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if token and label is not None:
                    transitions(token, counts[int(label)])
        kind, a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(a), pa.array(b), pa.array(counts[kind, a, b])],
            names=["kind", "a", "b", "n"])

    rows = (samples.select("token", "is_random")
            .mapInArrow(count, "kind long, a long, b long, n double")
            .groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros((2, STATES, STATES))
    for r in rows:
        counts[r["kind"], r["a"], r["b"]] = r["n"]
    return log_ratio(counts[1], counts[0])


def corpus_samples(df: DataFrame, text: str = "text", id_column: str = "doc_id",
                   sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples from the corpus itself, on a bounded sample of its documents.

    Values that the base patterns find are the random strings; tokens outside every base
    span are ordinary, at most ``ORDINARY_PER_DOC`` evenly spaced ones a document.
    """
    rows = df.count()
    share = min(1.0, sample_docs / rows) if rows else 1.0
    chosen = df.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tokens, labels = [], []
            for value in part.column(0).to_pylist():
                value = value or ""
                spans = sorted(base_spans(value, has_long_token(value)))
                for start, kind, end in spans:
                    found = value[start:end]
                    tokens.append(ASSIGN.fullmatch(found).group(2) if kind == 0 else found)
                    labels.append(True)
                plain, at = [], 0
                for start, _, end in spans:
                    plain.append(value[at:start])
                    at = max(at, end)
                plain.append(value[at:])
                ordinary = TOKEN.findall(" ".join(plain))
                step = max(1, -(-len(ordinary) // ORDINARY_PER_DOC))
                ordinary = ordinary[::step]
                tokens += ordinary
                labels += [False] * len(ordinary)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.string()), pa.array(labels, pa.bool_())],
                names=["token", "is_random"])

    return chosen.select(text).mapInArrow(run, "token string, is_random boolean")


def scanner(ratio: np.ndarray):
    """Function from texts to the tuples of ``ADDED``."""
    def scan(text: str) -> tuple:
        long_token = has_long_token(text)
        base = sorted(base_spans(text, long_token))
        spans = list(base)
        if long_token:
            for m in TOKEN.finditer(text):
                start, end = m.span()
                if end - start < MIN_LENGTH or any(s <= start and end <= e for s, _, e in base):
                    continue
                states = np.concatenate(([STATES - 1], classes(m.group())))
                score = float(ratio[states[:-1], states[1:]].sum())
                if score >= MIN_RATIO and score >= MIN_MEAN * (end - start):
                    spans.append((start, 3, end))
            spans.sort()
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
        of_base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        return (*counts, sha256_hex(of_base), ",".join(said),
                [(KINDS[k], s, e) for s, k, e in spans])

    return lambda texts: [scan(t) for t in texts]


def scan_secrets(df: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with counts by kind, the spans, and a digest of the base spans."""
    return annotate(df, text, ADDED, lambda: scanner(ratio))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """``text`` with every union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with secrets in ``text`` replaced; null text stays null; columns stay as they are."""
    def make():
        scan = scanner(ratio)
        return lambda texts: [(redact(t, [(s, e) for _, s, e in row[-1]]) if row[-1] else None,)
                              for t, row in zip(texts, scan(texts))]

    # positions instead of names, so that any column of the input keeps its own
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text)]
    found = annotate(df.toDF(*names), at, "redacted string", make)
    return found.select(*[(F.coalesce("redacted", at) if n == at else F.col(n)).alias(c)
                          for n, c in zip(names, df.columns)])
