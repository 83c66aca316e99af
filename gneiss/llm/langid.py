"""Language identification by nearest centroid.

A text's vector holds the tf-idf weights of its letter bigrams and trigrams, hashed to ``DIMS``
places and scaled to length 1. Each language has several centroids, clusters of its training
vectors; a text gets the language of the centroid of greatest cosine. A text farther from it
than that centroid's texts of about as many n-grams lie is rejected.

A short text lies far from every centroid because it has few n-grams, so each centroid has a radius for each band of
different n-grams (``BANDS``): the ``QUANTILE`` of the distances of its own training texts and of excerpts of them,
and ``MARGIN``. The quantile keeps single junk texts from setting it.

Document frequencies are counted over all training texts in Spark. The centroids are fitted on a
sample of ``per_lang`` distinct texts of each language at most, those of smallest hash, and so are of
bounded number and size: languages x ``clusters`` x ``DIMS`` floats are broadcast, and more than
``MOST_LANGS`` languages are refused.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import sliced, small_batches

DIMS, MOST_LANGS, UNDETERMINED = 4096, 500, "und"
#: Texts of one matrix, and characters after which a matrix is closed early.
BATCH, BATCH_CHARS = 256, 250_000
#: Where bands of different n-grams end, and characters of the excerpts that fill the bands of short texts.
BANDS, EXCERPTS = (10, 20, 40, 80, 160, 320, 640, 1280), (8, 16, 32, 64, 128, 256, 512, 1024)
#: A radius is this quantile of distances and this share of the way from there to 1, the distance of texts without a common n-gram.
QUANTILE, MARGIN = 0.99, 0.2
#: It takes so many texts of the centroid's own (fewer have no such quantile), or so many of its language.
LEAST_OWN, LEAST_ALL = 100, 20
#: The largest radius: a text farther away has hardly an n-gram in common with the centroid.
FARTHEST = 0.995
#: Of a language's texts a centroid has this share at least, and two texts.
LEAST_SHARE = 0.02
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Python's ``\w`` has numerals that are neither letters nor digits (\u00bd, \u00b2, \u2167); few texts have any, so they are looked for apart.
_NUMERALS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha())


def letters(text: str) -> str:
    """The text in lower case with one blank for each run of what is no letter, and at both ends."""
    out = _NOT_LETTERS.sub(" ", text.lower())
    if not out.isascii() and (odd := _NUMERALS.intersection(set(out))):
        out = re.sub(" +", " ", out.translate(dict.fromkeys(map(ord, odd), " ")))
    return f" {out} "


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _batches(texts):
    """Lists of texts of bounded number and size; a longer text stands alone."""
    held, chars = [], 0
    for t in texts:
        if held and (len(held) == BATCH or chars + len(t) > BATCH_CHARS):
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def counts(texts: list[str]) -> np.ndarray:
    """How often each place occurs: a row for each text, over its whole length."""
    words = [letters(t) for t in texts]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    out = np.zeros(len(texts) * DIMS, np.float32)
    for n in (2, 3):
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h + codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        own = (rows[:m] == rows[n - 1 :]) & ~((codes[:m] == 32) & (codes[n - 1 :] == 32))
        out += np.bincount(rows[:m][own] * DIMS + (h[own] >> np.uint64(52)).astype(np.int64), minlength=len(out))[: len(out)].astype(np.float32)
    return out.reshape(len(texts), DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from rows drawn in proportion to their distance from the starts before them: ``k`` centroids
    of length 1 at most, and each row's cluster. Clusters of fewer than ``LEAST_SHARE`` of the rows are given up to the others."""
    draw = np.random.default_rng(0)
    at = [int(np.argmax(x @ x.mean(0)))]
    while len(at) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[at].T).max(1).astype(np.float64), 0)
        if far.sum() < 1e-6:
            break
        at.append(int(draw.choice(len(x), p=far / far.sum())))
    c = x[at]
    while True:
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            new = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
            c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        sizes = np.bincount(own, minlength=len(c))
        if len(c) == 1 or sizes.min() >= max(2, LEAST_SHARE * len(x)):
            return c, own
        c = np.delete(c, int(sizes.argmin()), axis=0)


def excerpts(texts: list[str]) -> list[str]:
    """Pieces of the longer texts, from a third of them on, without those that hold no letter."""
    cut = (t[len(t) // 3 :][:n] for t in texts for n in EXCERPTS if len(t) > 2 * n)
    return [t for t in cut if has_letter(t)]


def radii(texts: list[str], c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The radius of each centroid in each band. Where it has fewer than ``LEAST_OWN`` texts, those of all centroids count; where
    these are fewer than ``LEAST_ALL``, the radius of the next shorter band holds, as shorter texts lie farther; ``FARTHEST`` where there is none."""
    own, far, band = [], [], []
    for batch in _batches(texts + excerpts(texts)):
        v = vectors(batch, idf)
        cos = v @ c.T
        own.append(cos.argmax(1))
        far.append(1 - cos.max(1))
        band.append(np.digitize((v > 0).sum(1), BANDS))
    own, far, band = np.concatenate(own), np.concatenate(far), np.concatenate(band)
    out = np.full((len(c), len(BANDS) + 1), FARTHEST)
    for i in range(len(c)):
        for b in range(len(BANDS) + 1):
            its = far[(own == i) & (band == b)]
            its = its if len(its) >= LEAST_OWN else far[band == b]
            if len(its) >= LEAST_ALL:
                q = float(np.quantile(its, QUANTILE))
                out[i, b] = min(FARTHEST, q + MARGIN * (1 - q))
            elif b:
                out[i, b] = out[i, b - 1]
    return out


def drawn(t: DataFrame, distinct: dict[str, int], per_lang: int) -> DataFrame:
    """(lang, text): of each language's distinct texts the ``per_lang`` of smallest hash. About twice as many, by the estimated
    numbers of ``distinct`` ones, pass the first level, copies are dropped, and the second level keeps the bound."""
    share = F.create_map(*[x for k, n in distinct.items() for x in (F.lit(k), F.lit(min(1.0, 2 * per_lang / max(1, n))))])
    passed = t.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("draw")).where(F.col("draw") / float(1 << 40) < F.element_at(share, F.col("lang"))).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return passed.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "text")


class LanguageModel:
    """Centroids and their radii, a row of ``BANDS`` for each; ``fit`` makes one and ``predict`` applies it."""

    def __init__(self, langs: list[str], centroids: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.radii, self.idf = langs, centroids, radii, idf

    @classmethod
    def fit(cls, train: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 1000, clusters: int = 4) -> LanguageModel:
        """``train``'s rows of null text or language, or without letters, teach nothing.
        Without any row that teaches, the model predicts ``und`` everywhere."""
        t = train.select(train[text].cast("string").alias("text"), train[lang].cast("string").alias("lang")).where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
        found = t.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("distinct")).limit(MOST_LANGS + 1).collect()
        sizes = {r["lang"]: r["n"] for r in found}
        if len(sizes) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages")
        if not sizes:
            return cls([], np.zeros((0, DIMS), np.float32), np.zeros((0, len(BANDS) + 1)), np.ones(DIMS, np.float32))

        def seen(batches):
            df, n = np.zeros(DIMS, np.int64), 0
            for batch in sliced(batches):
                for texts in _batches(batch.column(0).to_pylist()):
                    df += (counts(texts) > 0).sum(0)
                    n += len(texts)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS)), pa.array(df)], ["dim", "df"])

        df = np.zeros(DIMS)
        with small_batches(train.sparkSession):
            found_in = t.select("text").mapInArrow(seen, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
        for r in found_in:
            df[r["dim"]] = r["df"]
        idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
        sample = drawn(t, {r["lang"]: r["distinct"] for r in found}, per_lang)

        def fit_lang(key, pdf: pd.DataFrame) -> pd.DataFrame:
            texts = sorted(pdf["text"])
            x = np.concatenate([vectors(b, idf) for b in _batches(texts)])
            c, _ = cluster(x, clusters)
            return pd.DataFrame({"lang": key[0], "centroid": [v.astype(np.float32).tolist() for v in c], "radius": radii(texts, c, idf).tolist()})

        rows = sorted(sample.groupBy("lang").applyInPandas(fit_lang, "lang string, centroid array<float>, radius array<double>").collect(), key=lambda r: r["lang"])
        return cls([r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), DIMS), np.array([r["radius"] for r in rows]).reshape(len(rows), len(BANDS) + 1), idf)

    def score(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; null texts and those without a letter are ``und``, 0 and rejected."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        done = 0
        for batch in _batches([texts[i] for i in known]):
            v = vectors(batch, self.idf)
            cos, band = v @ self.centroids.T, np.digitize((v > 0).sum(1), BANDS)
            best = cos.argmax(1)
            for j, b in enumerate(best):
                c = float(min(1.0, max(0.0, cos[j, b])))
                out[known[done + j]] = (self.langs[b], c, 1 - c > self.radii[b, band[j]])
            done += len(batch)
        return out

    def predict(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, lang_pred, score, rejected) for every row; repeated rows and null ids keep their rows."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in sliced(batches):
                found = model.value.score(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([bool(f[2]) for f in found], pa.bool_())],
                    ["id", "lang_pred", "score", "rejected"],
                )

        return docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")


def held_out(id: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text the model, trained on the rows with a language, rejects.

    Null and empty texts and those without a letter are rejected. Where no row teaches a language nothing can be judged, and
    every row stays. Rows are judged by their text alone: ids may be null or repeated, copies are judged alike; an
    empty table gives an empty one; columns are those of ``docs``.
    """
    model = LanguageModel.fit(docs.where(~held_out()), **options)
    if not model.langs:
        return docs
    names = docs.columns
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at = names.index("text")
        for batch in sliced(batches):
            keep = [not f[2] for f in known.value.score(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
