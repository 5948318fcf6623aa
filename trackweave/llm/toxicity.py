"""A counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their beginnings, told apart by whether they occur once, twice or more.  Every
labelled text that names a group gets counterfactuals: the same text with the identity term exchanged, wherever it stands,
for others of its kind and language.  The squared change of the score's logit between a text and its counterfactuals is
added to the loss, so the weight that labels put on a group's name by accident is taken away and neutral mentions of a
group aren't held against a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, map_batches, table, written
from .language_id import remainder
from .textops import LOWER, NOT_ALNUM, Words, chunks, mix64, split_words

#: Labelled rows used for training at most, chosen by hash; of them the driver gets the features that tell the labels apart.
TRAIN_ROWS = 12_000
HASH_BITS = 18
#: Counterfactuals of one term in one text; texts take different ones.
SWAPS = 4

#: Identity terms by kind and language; a counterfactual takes another term of the same kind and language.
IDENTITY_TERMS = {
    "religion": {
        "en": ("christian", "christians", "muslim", "muslims", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists", "catholic", "catholics"),
        "de": ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
        "fr": ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
        "es": ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    },
    "origin": {
        "en": ("african", "american", "arab", "asian", "chinese", "european", "french", "german", "indian", "irish", "italian", "japanese", "mexican", "polish", "russian", "spanish", "turkish", "immigrants", "refugees"),
        "de": ("afrikaner", "amerikaner", "araber", "asiaten", "chinesen", "franzosen", "italiener", "polen", "russen", "spanier", "türken", "einwanderer", "flüchtlinge"),
        "fr": ("africains", "américains", "arabes", "asiatiques", "chinois", "allemands", "italiens", "polonais", "russes", "espagnols", "turcs", "immigrés", "réfugiés"),
        "es": ("africanos", "americanos", "árabes", "asiáticos", "chinos", "alemanes", "italianos", "polacos", "rusos", "franceses", "turcos", "inmigrantes", "refugiados"),
    },
    "colour": {"en": ("black", "white", "brown"), "de": ("schwarze", "weiße"), "fr": ("noirs", "blancs"), "es": ("negros", "blancos")},
    "gender": {
        "en": ("men", "women", "male", "female", "transgender", "nonbinary"),
        "de": ("männer", "frauen", "transgender"),
        "fr": ("hommes", "femmes", "transgenres"),
        "es": ("hombres", "mujeres", "transgénero"),
    },
    "orientation": {
        "en": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
        "de": ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
        "fr": ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
        "es": ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    },
    "ability": {"en": ("blind", "deaf", "disabled", "autistic", "paralyzed"), "de": ("blinde", "gehörlose", "behinderte"), "fr": ("aveugles", "sourds", "handicapés"), "es": ("ciegos", "sordos", "discapacitados")},
    "age": {"en": ("young", "old", "elderly", "teenage"), "de": ("junge", "alte"), "fr": ("jeunes", "vieux"), "es": ("jóvenes", "viejos")},
}

#: Bytes of the word beginnings that are features too, and the counts of a feature that are told apart.
PREFIXES, LEVELS = (5, 6, 7), 3


def _cells(words: Words, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and document of every word and every beginning of a longer word."""
    cells, of = [(words.hashes() >> np.uint64(64 - HASH_BITS)).astype(np.int64)], [docs]
    for k in PREFIXES:
        own = words.end - words.start > k
        part = Words(words.data, words.start[own], words.start[own] + k, words.bounds)
        cells.append((mix64(part.hashes() + np.uint64(k)) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        of.append(docs[own])
    return np.concatenate(cells), np.concatenate(of)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words; (document, cell) as one sorted number; how often each occurs."""
    words = split_words(LOWER[data], offsets, NOT_ALNUM)
    cells, docs = _cells(words, words.doc)
    return words, *np.unique((docs << HASH_BITS) | cells, return_counts=True)


def _features(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(document, feature) as one sorted number: the cells, and one more for those that occur twice or three times."""
    mask = (1 << HASH_BITS) - 1
    more = [key[count >= 1]]
    for level in range(2, LEVELS + 1):
        again = key[count >= level]
        more.append((again & ~np.int64(mask)) | (mix64((again & mask).astype(np.uint64) + np.uint64(level << 32)) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return np.unique(np.concatenate(more))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, and their bounds."""
    key = _features(*_counted(data, offsets)[1:])
    return key & ((1 << HASH_BITS) - 1), np.searchsorted(key >> HASH_BITS, np.arange(len(offsets)))


def _term_table() -> tuple[np.ndarray, list[tuple[str, int]], list[tuple[str, ...]], dict[str, np.ndarray]]:
    """Sorted hashes of the terms that can be exchanged; of each its text and group; the groups; the cells of each term."""
    groups = [terms for languages in IDENTITY_TERMS.values() for terms in languages.values()]
    seen: dict[str, int] = {}
    for g, terms in enumerate(groups):
        for t in terms:
            seen.setdefault(t, g)
    raw = [t.encode() for t in seen]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    words = split_words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, NOT_ALNUM)
    cells, docs = _cells(words, words.doc)
    order = np.argsort(words.hashes())
    names = list(seen.items())
    return words.hashes()[order], [names[i] for i in order.tolist()], groups, {t: cells[docs == i] for i, (t, _) in enumerate(names)}


def counterfactuals(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(document, features lost, features won, weight) of each counterfactual.

    Each identity term of a text is exchanged at all its places for ``SWAPS`` others of its group at most; which ones depends on
    the text.  A term's counterfactuals weigh 1 together.  The features are those that the changed text has: only counts of
    the two terms' cells change.
    """
    hashes, names, groups, cells = _term_table()
    words, key, count = _counted(data, offsets)
    own = words.hashes()
    place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    at = np.flatnonzero(hashes[place] == own)
    doc = words.doc[at]
    found, times = np.unique((doc << 16) | place[at], return_counts=True)
    for pair, n in zip(found.tolist(), times.tolist(), strict=True):
        d, (term, g) = pair >> 16, names[pair & 0xFFFF]
        others = [t for t in groups[g] if t != term]
        if not others:
            continue
        a, b = np.searchsorted(key, [d << HASH_BITS, (d + 1) << HASH_BITS])
        before = _features(key[a:b], count[a:b])
        first = int(own[words.bounds[d]] % np.uint64(len(others)))
        chosen_ = {others[(first + k * max(1, len(others) // SWAPS)) % len(others)] for k in range(SWAPS)}
        for other in sorted(chosen_):
            change = np.concatenate((key[a:b], (d << HASH_BITS) | cells[term], (d << HASH_BITS) | cells[other]))
            by = np.concatenate((count[a:b], np.full(len(cells[term]), -n), np.full(len(cells[other]), n)))
            keys, inverse = np.unique(change, return_inverse=True)
            after = _features(keys, np.bincount(inverse, weights=by).astype(np.int64))
            mask = (1 << HASH_BITS) - 1
            yield d, np.setdiff1d(before, after) & mask, np.setdiff1d(after, before) & mask, 1 / len(chosen_)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cells, bounds = features(data, offsets)
        total = np.concatenate(([0.0], np.cumsum(self.weights[cells])))
        return 1 / (1 + np.exp(-np.clip(total[bounds[1:]] - total[bounds[:-1]] + self.bias, -30, 30)))


@dataclass(frozen=True)
class Swaps:
    """Changes of features in counterfactuals: pair, feature and sign (1 lost, -1 won), and the weight of each pair."""

    pair: np.ndarray
    cell: np.ndarray
    sign: np.ndarray
    weight: np.ndarray


NO_SWAPS = Swaps(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))


def chosen(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, least: int = 5, z: float = 4.0) -> np.ndarray:
    """Cells whose share differs between the labels by more than ``z`` standard errors, in ``least`` rows at least; ``ones`` and
    ``zeros`` count the rows of either label with the cell."""
    n1, n0 = max(1, n1), max(1, n0)
    p = (ones + zeros) / (n1 + n0)
    score = (ones / n1 - zeros / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((np.abs(score) > z) & (ones + zeros >= least))


def fit(cells: np.ndarray, bounds: np.ndarray, labels: np.ndarray, swaps: Swaps = NO_SWAPS, *, fairness: float = 1.0, decay: float = 1e-4, steps: int = 300) -> Model:
    """The model by Adam on all rows (their features, chosen before).

    ``fairness`` weighs the squared changes of the logit over all counterfactuals, by row.  Without rows nothing counts as
    toxic; with one label only the model is constant.
    """
    n = len(labels)
    if not n or labels.min() == labels.max():
        rate = float(labels.mean()) if n else 0.0
        return Model(np.zeros(1 << HASH_BITS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    rows = np.repeat(np.arange(n), np.diff(bounds))
    active = np.unique(np.concatenate((cells, swaps.cell)))
    local, changed = np.searchsorted(active, cells), np.searchsorted(active, swaps.cell)
    size, pull = len(active), 2 * fairness / n * swaps.weight
    wa, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=wa[local], minlength=n) + b, -30, 30)))
        err = (p - labels) / n
        grad = np.bincount(local, weights=err[rows], minlength=size) + decay * wa
        gap = pull * np.bincount(swaps.pair, weights=swaps.sign * wa[changed], minlength=len(pull))
        grad += np.bincount(changed, weights=gap[swaps.pair] * swaps.sign, minlength=size)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        wa = wa - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    w = np.zeros(1 << HASH_BITS)
    w[active] = wa
    return Model(w, float(b))


def label_counts(rows: DataFrame, text: str, label: str, features_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """By cell, the rows of label 1 and of label 0 that have it, counted in tasks; and the rows of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, 1 << HASH_BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                cells, bounds = features_of(data, offsets)
                own = (batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False) == 1).astype(np.int64)
                seen += np.bincount(own, minlength=2)
                of = np.repeat(own, np.diff(bounds))
                for k in (0, 1):
                    counts[k] += np.bincount(cells[of == k], minlength=1 << HASH_BITS)
        for k in (0, 1):
            have = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(have) + 1, k)), pa.array(np.append(have, -1)), pa.array(np.append(counts[k][have], seen[k]))], names=["label", "cell", "n"])

    got = map_batches(rows.select(F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text")), run, "label long, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, (1 << HASH_BITS) + 1), dtype=np.int64)
    out[got.column("label").to_numpy(), got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out[1, :-1].astype(np.float64), out[0, :-1].astype(np.float64), int(out[1, -1]), int(out[0, -1])


def sample_features(rows: DataFrame, text: str, label: str, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Swaps]:
    """The picked cells of each row, their bounds and the labels, and the rows' counterfactuals."""
    asked = rows.sparkSession.sparkContext.broadcast(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                cells, bounds = features(data, offsets)
                keep = np.isin(cells, asked.value)
                bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
                swaps: list[list[dict]] = [[] for _ in range(b - a)]
                for d, lost, won, weight in counterfactuals(data, offsets):
                    swaps[d].append({"lost": lost.tolist(), "won": won.tolist(), "weight": weight})
                kind = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("won", pa.list_(pa.int32())), ("weight", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cells[keep].astype(np.int32))), pa.array(swaps, kind)], names=["label", "cells", "swaps"])

    schema = "label int, cells array<int>, swaps array<struct<lost: array<int>, won: array<int>, weight: double>>"
    got = map_batches(rows.select(F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text")), run, schema).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0), NO_SWAPS
    lists = got.column("cells").combine_chunks()
    pairs = [s for own in got.column("swaps").to_pylist() for s in own]
    parts = [(k, np.array(cells, dtype=np.int64), sign) for k, s in enumerate(pairs) for cells, sign in ((s["lost"], 1.0), (s["won"], -1.0))]
    swaps = Swaps(np.concatenate([np.full(len(c), k) for k, c, _ in parts]), np.concatenate([c for _, c, _ in parts]), np.concatenate([np.full(len(c), g) for _, c, g in parts]), np.array([s["weight"] for s in pairs])) if pairs else NO_SWAPS
    return lists.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())))), got.column("label").to_numpy().astype(np.float64), swaps


def train(labelled: DataFrame, *, text: str = "text", label: str = "toxic", key: str = "doc_id", bound: int = TRAIN_ROWS, fairness: float = 1.0) -> Model:
    """A model from at most ``bound`` of the rows with a non-null label; without rows, or with one label only, it is constant."""
    rows = written(bounded_ids(labelled.where(F.col(label).isNotNull()), key, bound).select(label, text), "sample")
    picked = chosen(*label_counts(rows, text, label, features))
    return fit(*sample_features(rows, text, label, picked), fairness=fairness)


def scored(df: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with score and predicted (1 from ``threshold`` on).

    Null and wordless texts get the score of no words; rows that repeat are scored one by one; an empty table gives an empty
    result; texts of any length are read whole.  Columns of ``keep`` with the names of new ones aren't allowed.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                score = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return map_batches(source, run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """Documents with a label outside the held-out remainder; of a doc_id that repeats among the labels one is taken."""
    own = labels.where(F.col(label).isNotNull() & (remainder("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max(label).alias("__label"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded_ids(own, "doc_id", TRAIN_ROWS)), "doc_id").select("doc_id", "text", F.col("__label").alias(label))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return scored(docs, model).select("doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "score", "predicted")
