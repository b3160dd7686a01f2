"""Language identification by the nearest centroid of character n-gram vectors.

A text's vector holds log counts of its letter n-grams in a fixed number of hashed dimensions, times the
inverse document frequency, at unit length. Every language has several centroids, found by clustering
a bounded sample of its texts on the sphere. The language of the nearest centroid by cosine wins;
a text that is farther from it than nearly all texts it was made of is marked as rejected.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, parts, table

#: Letters in an n-gram, words being set off by one blank, and dimensions of a vector.
SIZES, DIMENSIONS = (1, 2, 3), 1 << 13
#: About so many texts a language are clustered; document frequencies are counted over all.
PER_LANGUAGE = 1_000
CLUSTERS, ROUNDS = 3, 12
#: This part of a centroid's own texts lies outside its radius.
OUTSIDE = 0.005
#: More languages than this are an error, since all centroids go to every task.
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
#: Code points that are made into numbers at once, texts that are compared at once.
_PIECE, _ROWS = 1 << 18, 64
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased words, one blank around each; no words, no points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    spaced = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint32)
    blank = spaced == 32
    keep = np.ones(len(spaced), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return spaced[keep]


def _counts(text: str) -> np.ndarray:
    """How often each dimension's n-grams occur in the whole text."""
    points, total, most = _points(text), np.zeros(DIMENSIONS, np.int64), max(SIZES)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for start in range(0, len(points), _PIECE):
        piece = points[start:start + _PIECE + most - 1]
        rolled = np.zeros(len(piece), np.uint32)
        for size in range(1, most + 1):
            n = min(_PIECE, len(piece) - size + 1)
            if n <= 0:
                break
            rolled = rolled[:n] + piece[size - 1:size - 1 + n] * np.uint32(_FACTORS[size - 1])
            if size in SIZES:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount(mixed >> shift, minlength=DIMENSIONS)
    return total


def _vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        if text:
            row[:] = np.log1p(_counts(text))
    out *= idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inverse_frequencies(taught: DataFrame) -> np.ndarray:
    """log((1 + texts) / (1 + texts that have it)) + 1 per dimension, over all rows."""
    def count(batches):
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in parts(batches):
            for text in batch.column("text").to_pylist():
                total += _counts(text) > 0
                rows += 1
        yield pa.record_batch({"dim": pa.array(np.arange(-1, DIMENSIONS), pa.int32()),
                               "n": pa.array(np.concatenate([[rows], total]), pa.int64())})

    found = (taught.select("text").mapInArrow(count, "dim int, n long").filter("n > 0")
             .groupBy("dim").agg(F.sum("n")).collect())  # at most one row a dimension
    n = dict(map(tuple, found))
    seen = np.array([n.get(d, 0) for d in range(DIMENSIONS)], float)
    return (np.log((1 + n.get(-1, 0)) / (1 + seen)) + 1).astype(np.float32)


def clustered(vectors: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS):
    """Unit centroids of the unit rows, and the radius of each as a least cosine.

    Begins with the row nearest to the mean; each further one is the row farthest from those chosen.
    """
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        # halfway to the farthest: single odd texts make no good seeds
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // (2 * k)]))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids, owner = vectors[chosen], None
    for _ in range(rounds):
        now = np.argmax(vectors @ centroids.T, axis=1)
        if owner is not None and (now == owner).all():
            break
        owner = now
        sums = np.stack([vectors[owner == c].sum(axis=0) if (owner == c).any() else centroids[c]
                         for c in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosines = vectors @ centroids.T
    owner, best = cosines.argmax(axis=1), cosines.max(axis=1)
    radius = [float(np.quantile(best[owner == c], OUTSIDE)) if (owner == c).any() else 1.0
              for c in range(len(centroids))]
    return centroids, radius


def train(docs: DataFrame, store: Store, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS):
    """(idf, languages of the centroids, centroids, radii), from rows that are not held out."""
    taught = (docs.select("doc_id", "text", "lang")
              .filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
                      & F.col("text").rlike(r"\p{L}")))
    sizes = taught.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = store.keep(sizes.limit(MOST_LANGUAGES + 1))
    n_languages = sizes.count()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not n_languages:
        return np.ones(DIMENSIONS, np.float32), [], np.zeros((0, DIMENSIONS), np.float32), []
    # a hash of the id decides, so that a language's share is bounded whatever its size
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = (taught.join(F.broadcast(sizes), "lang").filter(part * F.col("n") < per_language)
              .dropDuplicates(["doc_id", "lang"]).select("lang", "doc_id", "text"))
    chosen = store.keep(chosen)
    idf = _inverse_frequencies(taught)

    def cluster(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group.column("doc_id"))
        texts = group.column("text").take(order).to_pylist()
        centroids, radius = clustered(_vectors(texts, idf), clusters)
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(radius), pa.string()),
                         "centroid": pa.array([c.tolist() for c in centroids], pa.list_(pa.float32())),
                         "radius": pa.array(radius, pa.float64())})

    made = (chosen.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<float>, radius double")
            .toArrow().sort_by([("lang", "ascending"), ("radius", "ascending")]))
    centroids = np.array(made["centroid"].to_pylist(), np.float32).reshape(-1, DIMENSIONS)
    return idf, made["lang"].to_pylist(), centroids, made["radius"].to_pylist()


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1) and rejected for every row of ``docs``.

    Texts that are null or have no letter are ``und`` with score 0, rejected, and so are all if no language can
    be learned. A text with letters gets the nearest language also if it is rejected for its distance;
    at equal distance the first in order. Rows without lang or doc_id are not learned from, but
    predicted like others, and so are rows that repeat. Texts of any length are read whole. Empty
    tables give no rows. Other columns are not read.
    """
    idf, languages, centroids, radii = train(docs, Store(docs.sparkSession, "language"),
                                             per_language, clusters)

    def predict(batches):
        least = np.array(radii)
        for batch in parts(batches, _ROWS):
            texts = batch.column("text").to_pylist()
            vectors = _vectors(texts, idf)
            lettered = vectors.any(axis=1)
            if languages:
                cosines = vectors @ centroids.T
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                rejected = ~lettered | (score < least[best])
                named = [languages[b] if known else UNKNOWN for b, known in zip(best, lettered)]
            else:
                score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
                named = [UNKNOWN] * len(texts)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(named, pa.string()),
                                   "score": score, "rejected": rejected})

    found = docs.select("doc_id", "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
