"""Toxicity by weak supervision.

Features that lean to toxic rows are mined from labelled rows and make up lexicons by kind (words, beginnings of four
and of five letters) and by strength. Each lexicon is a voter, and so are the number of a kind's features in a text,
their absence, and patterns of shouting and the like. A generative label model takes the label as hidden: expectation
maximisation over the voters' answers estimates what each voter says given either label, and from what the label leaves
unexplained how voters hang together; voters that repeat each other share their weight. Labels given by hand calibrate
the voters' tables, as counts beside the model's own; they are no voter, and a row's posterior label comes from its
votes alone. A linear classifier learns from the posterior labels and scores whole texts.

Labels come only from rows whose crc32(doc_id) modulo 5 is not 0, and at most
``SAMPLE`` of them, the smallest by a hash of their id: that is the one bound.
Label, language, source and id are no inputs of a score.

Defined results: a null or empty text is scored like any text without words;
repeated rows get equal scores; without any labelled row every score is the
prior 0; texts of any length are read whole; further columns are not touched.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.common import bounded_sample, cut, map_rows, table, text_or_empty

SAMPLE = 6000
FOLDS = 5
#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (4, 5)
#: A mined feature occurs in so many toxic rows at least, and its likelihood-ratio statistic exceeds what the best of that many
#: unrelated features would reach by MARGIN.
MIN_ROWS, MARGIN = 4, 6.0
FEATURES = 400
#: Strengths that a kind's lexicon is parted into, and how many of its features in a text make further voters.
BANDS, COUNTS = 4, (2, 4)

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (
    ("shout", re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{4,}\b(?:\W+[^\W\d_a-zß-öø-ÿ]{4,}\b){2}")),
    ("exclaim", re.compile(r"!{2,}")),
    ("masked", re.compile(r"[^\W\d_][*@$#]{1,3}[^\W\d_]")),
    ("stretched", re.compile(r"([^\W\d_])\1{3,}")),
    ("repeated", re.compile(r"\b([^\W\d_]{3,})(?:\W+\1\b){3,}", re.IGNORECASE)),
)


def features(text: str | None) -> set[str]:
    """Words as ``=word`` and beginnings of longer words."""
    words = set(_WORD.findall((text or "").lower()))
    out = {f"={w}" for w in words}
    for n in STEMS:
        out.update({w[:n] for w in words if len(w) > n})
    return out


def patterns(text: str | None) -> list[int]:
    return [int(p.search(text or "") is not None) for _, p in _PATTERNS]


def _signature(text: str) -> int:
    """The least hash of a five-word window, which near copies mostly share."""
    words = text.encode().lower().split()
    return min((zlib.crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))), default=0)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    pattern_weights: list[float] = field(default_factory=lambda: [0.0] * len(_PATTERNS))
    bias: float = -50.0
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: list[tuple[str, str, float]] = field(default_factory=list)
    #: Posterior labels of the rows that it was trained on, in the order they were given.
    posterior: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        self._words = frozenset(k[1:] for k in self.weights if k[0] == "=")
        self._stems = {n: frozenset(k for k in self.weights if k[0] != "=" and len(k) == n) for n in STEMS}

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall((text or "").lower()))
        total = self.bias + sum(self.weights["=" + w] for w in self._words & words)
        for n, stems in self._stems.items():
            if stems:
                total += sum(self.weights[s] for s in stems & {w[:n] for w in words if len(w) > n})
        if any(self.pattern_weights):
            total += sum(w * p for w, p in zip(self.pattern_weights, patterns(text), strict=True))
        return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def label_model(votes: np.ndarray, prior: float, said: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 from votes in {-1, 0, 1} (0 abstains).

    Returns the posterior, P(vote | label) as (voter, label, vote + 1), the voters' conditional correlations, and the
    weight that each voter keeps. ``said`` are labels given by hand for the same rows: they are counted into the tables
    beside the posterior, and are no evidence on a row.
    """
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)

    def counted(q):
        return np.stack([np.einsum("n,nmv->mv", w, hot) + 0.5 for w in (1 - q, q)], axis=1)

    known = 0.0 if said is None else counted(said.astype(float))

    def tables(q):
        out = counted(q) + known
        return out / out.sum(axis=2, keepdims=True)

    def shared(q, table_):
        """What the label leaves unexplained, and the weight that a group of like voters shares."""
        mean = q[:, None] * (table_[:, 1] @ [-1, 0, 1]) + (1 - q[:, None]) * (table_[:, 0] @ [-1, 0, 1])
        rest = votes - mean
        norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        corr = (rest.T @ rest) / np.outer(norm, norm)
        np.fill_diagonal(corr, 1.0)
        return corr, 1 / np.where(np.abs(corr) > 0.2, np.clip(corr, 0, None), 0).sum(axis=1)

    base = math.log(prior / (1 - prior))
    if said is None:  # the first posterior is a plain count of votes, in which like voters already share their weight
        _, keep = shared(np.full(n, prior), np.repeat((hot.mean(axis=0) + 1e-3)[:, None], 2, axis=1))
        q = 1 / (1 + np.exp(-(2 * votes @ keep + base)))
    else:
        q = said.astype(float)
    table_ = tables(q)
    for step in range(rounds):
        if step % 5 == 0:
            corr, keep = shared(q, table_)
        odds = np.log(table_[:, 1]) - np.log(table_[:, 0])
        if said is None:  # a voter is no worse than chance
            odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        new = 1 / (1 + np.exp(-np.clip(np.einsum("nmv,mv->nm", hot, odds) @ keep + base, -50, 50)))
        done = step > 20 and np.abs(new - q).max() < 1e-6
        q = new
        table_ = tables(q)
        if done:
            break
    return q, table_, corr, keep


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Weights, bias last, of a ridge logistic regression on soft labels, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the labelled training rows, ``most`` at most."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # ``most`` ids and flags are broadcast, however many labels there are
    chosen = F.broadcast(bounded_sample(chosen, "doc_id", most))
    return docs.select("doc_id", text_or_empty()).join(chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows = cut(labelled(docs, labels, most))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, _signature(x), np.array(sorted({zlib.crc32(f.encode()) for f in features(x)}), "<u4").tobytes()) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["toxic", "signature", "features"]) if out else pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["toxic", "signature", "features"])

    seen: dict[tuple[int, int], bytes] = {}
    for r in sorted(rows.select("text", "toxic").mapInArrow(hashed, "toxic int, signature long, features binary").collect()):
        seen.setdefault((r.toxic, r.signature), bytes(r.features))  # a group of near copies counts once
    totals = [sum(t == y for t, _ in seen) for y in (0, 1)]
    if not totals[1] or not totals[0]:
        return Model()
    ids, inverse = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in seen.values()]), return_inverse=True)
    owner = np.repeat([t for t, _ in seen], [len(x) // 4 for x in seen.values()])
    pos = np.bincount(inverse[owner == 1], minlength=len(ids))
    neg = np.bincount(inverse[owner == 0], minlength=len(ids))
    # G² of each feature against the label, for features that lean to it
    share = totals[1] / sum(totals)
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        z = 2 * (np.where(pos, pos * np.log(pos / (n * share)), 0) + np.where(neg, neg * np.log(neg / (n * (1 - share))), 0))
    tested = max(1, int((n >= MIN_ROWS).sum()))
    good = np.flatnonzero((pos >= MIN_ROWS) & (pos >= 2 * neg) & (pos > n * share) & (z >= 2 * math.log(tested) + MARGIN))
    good = good[np.lexsort((ids[good], -z[good]))][:FEATURES]
    wanted = {int(i) for i in ids[good]}
    if not wanted:
        return Model()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[f for f in features(x) if zlib.crc32(f.encode()) in wanted] for x in batch.column(0).to_pylist()]
            marks = [patterns(x) for x in batch.column(0).to_pylist()]
            signs = [_signature(x) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(signs, pa.int64()), pa.array(out, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))], names=["toxic", "signature", "hits", "marks"])

    found = rows.select("text", "toxic").mapInArrow(named, "toxic int, signature long, hits array<string>, marks array<int>").collect()
    once = {(r.toxic, r.signature, tuple(sorted(r.hits))): (set(r.hits), list(r.marks)) for r in found}
    keys = sorted(once)
    examples = [once[k] for k in keys]
    prior = totals[1] / sum(totals)
    return _train(examples, np.array([k[0] for k in keys]), prior, {f: float(z[np.searchsorted(ids, zlib.crc32(f.encode()))]) for h, _ in examples for f in h})


def voters(x: np.ndarray, names: list[str], marks: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(votes, titles): what lexicons, their counts and absences, and patterns say of each row; ``names`` are the columns of x, strongest first."""
    votes, titles = [], []
    for kind, has in [("word", lambda f: f[0] == "=")] + [(f"stem {k}", lambda f, k=k: f[0] != "=" and len(f) == k) for k in STEMS]:
        columns = [i for i, f in enumerate(names) if has(f)]
        if not columns:
            continue
        for band, part in enumerate(np.array_split(columns, min(BANDS, len(columns)))):
            votes.append(x[:, part].any(axis=1))
            titles.append(f"{kind} lexicon {band}")
        many = x[:, columns].sum(axis=1)
        for least in COUNTS:
            votes.append(many >= least)
            titles.append(f"{kind} {least} times")
        votes.append(-(many == 0).astype(int))
        titles.append(f"{kind} none")
    for j, (title, _) in enumerate(_PATTERNS):
        votes.append(marks[:, j] > 0)
        titles.append(title)
    return np.column_stack(votes).astype(int), titles


def _train(examples: list[tuple[set[str], list[int]]], said: np.ndarray, prior: float, strength: dict[str, float]) -> Model:
    names = sorted(strength, key=lambda f: (-strength[f], f))
    column = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(examples), len(names)))
    for i, (hits, _) in enumerate(examples):
        x[i, [column[f] for f in hits]] = 1
    marks = np.array([m for _, m in examples], float)
    votes, titles = voters(x, names, marks)
    q, likely, corr, _ = label_model(votes, prior, said)
    w = logistic(np.column_stack([x, marks]), q)
    # how often a voter that speaks is right
    share = np.array([1 - prior, prior])
    spoken = [(likely[i, 0, 0] * share[0] + likely[i, 1, 2] * share[1], sum(likely[i, y, v] * share[y] for y in (0, 1) for v in (0, 2))) for i in range(len(titles))]
    accuracy = {t: float(right / max(1e-9, all_)) for t, (right, all_) in zip(titles, spoken, strict=True)}
    tied = [(titles[i], titles[j], round(float(corr[i, j]), 3)) for i in range(len(titles)) for j in range(i) if abs(corr[i, j]) > 0.2]
    return Model({f: float(w[i]) for f, i in column.items()}, [float(v) for v in w[len(names) : -1]], float(w[-1]), accuracy, tied, q)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; a map without shuffle."""
    model = replace(model, posterior=None)

    def make():
        def one(doc_id, text):
            score = model.score(text)
            return doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0, score, int(score >= 0.5)

        return one

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = replace(fit(docs, labels), posterior=None)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array([model.score(t) < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
