"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, fitted by follow-the-
regularised-leader with elastic-net penalties, then calibrated by one temperature.

Texts are lowered, what isn't a letter counts as a blank, and runs of one to three characters are hashed to `DIMENSIONS`
features. Document frequencies are counted over all training documents, each partition adding up its own; the classifier
is fitted on at most `SAMPLE` documents, spread evenly over the languages and chosen by a hash of their id and text, so the
fit costs the same at any size. Every document is read whole and predicted in Arrow batches.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without language or text teach nothing; a
single language is predicted with score 1, and with nothing to learn from every text is `und`; ties go to the language that
sorts first; a null id counts as the empty text in the split; repeated rows are kept, and stand once in the sample; other columns are never read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 14
LENGTHS = (1, 2, 3)
SAMPLE = 2_400
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point of the first plane is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16))
    return _letters[0]


def counted(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a text, ascending, and their counts; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    plain = letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    for i in high:
        plain[i] = chr(codes[i]).isalpha()
    if not plain.any():
        return None
    codes = np.concatenate([[np.uint32(32)], np.where(plain, codes, np.uint32(32)), [np.uint32(32)]])
    # runs of blanks count as one
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for n in LENGTHS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for j in range(n):
                h = (h ^ codes[j:len(codes) - n + 1 + j]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            total += np.bincount(h & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per language, the last column for the constant
    temperature: float = 1.0

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(n)) * self.idf[at]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def probabilities(self, text: str | None) -> np.ndarray | None:
        found = counted(text) if text else None
        if found is None or not self.languages:
            return None
        at, n = found
        return softmax((self.weights[:, at] @ self.values(at, n) + self.weights[:, -1]) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dimensions: int = DIMENSIONS, *,
                      rounds: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05,
                      seed: int = 7) -> np.ndarray:
    """FTRL-proximal weights for examples (features, values, class); the constant is the last feature, without penalty."""
    z, n = np.zeros((classes, dimensions + 1)), np.zeros((classes, dimensions + 1))

    def weights(zs: np.ndarray, ns: np.ndarray, free: bool = False) -> np.ndarray:
        flat = 0.0 if free else l1
        return np.where(np.abs(zs) <= flat, 0.0, (np.sign(zs) * flat - zs) / ((beta + np.sqrt(ns)) / alpha + (0.0 if free else l2)))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(examples)):
            at, value, target = examples[i]
            w, b = weights(z[:, at], n[:, at]), weights(z[:, -1], n[:, -1], True)
            p = softmax(w @ value + b)
            p[target] -= 1.0
            for cols, g, now in ((at, np.outer(p, value), w), (dimensions, p, b)):
                old = n[:, cols]
                n[:, cols] = old + g * g
                z[:, cols] += g - (np.sqrt(n[:, cols]) - np.sqrt(old)) / alpha * now
    full = weights(z, n)
    full[:, -1] = weights(z[:, -1], n[:, -1], True)
    return full


def best_temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    One example more with an unknown language is counted in, so a sample without a mistake doesn't claim certainty.
    """
    def loss(log_t: float) -> float:
        x = scores / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        losses = np.log(np.exp(x).sum(axis=1))[:, None] - x
        return float(losses[np.arange(len(x)), target].sum() + losses.mean(axis=1).mean())

    a, b, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (one column) each feature occurs, and how many have a letter."""
    def count(batches):
        seen, docs = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = counted(text) if text else None
                if found:
                    seen[found[0]] += 1
                    docs += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMENSIONS)), pa.array(np.append(seen[at], docs))],
                                         names=["feature", "n"])

    rows = texts.mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in rows:  # at most DIMENSIONS + 1
        df[r["feature"]] = r["n"]
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """A model of the languages of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       (~held_out(id_col)).alias("teaches")).where("teaches AND lang IS NOT NULL AND text IS NOT NULL")
    identity = F.xxhash64("id", "text")
    sizes = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct(identity, 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS + 1)))
    df, n_docs = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    each = max(1, sample // len(languages))
    # the rows whose hash lies under a share of the hashes that holds a little more than is wanted of each language; neither
    # null or repeated ids nor repeated rows, which count once, add to it
    spread = 1 << 31
    under = F.from_json(F.lit(json.dumps({lang: min(spread, int(spread * (1.4 * each + 50) / n)) for lang, n in sizes.items()})),
                        "map<string,bigint>")
    picked = rows.withColumn("key", F.pmod(identity, F.lit(spread))).where(F.col("key") < under[F.col("lang")]).select(
        "lang", "key", "text")

    def features(batches):
        for batch in batches:
            langs, keys, ats, ns = [], [], [], []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = counted(text)
                if found:
                    langs.append(lang)
                    keys.append(key)
                    ats.append(found[0].astype("<u2").tobytes())
                    ns.append(found[1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()),
                                              pa.array(ats, pa.binary()), pa.array(ns, pa.binary())],
                                             names=["lang", "key", "at", "n"])

    # repeated rows fall together before the shuffle, and the ranking sees the few rows of the share only
    found = picked.mapInArrow(features, "lang string, key bigint, at binary, n binary").groupBy("lang", "key").agg(
        F.min(F.struct("at", "n")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = found.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "key", "f.at", "f.n").collect()
    chosen.sort(key=lambda r: (r["key"], r["lang"]))
    model = Model(languages, idf, np.zeros((len(languages), DIMENSIONS + 1)))
    number = {lang: i for i, lang in enumerate(languages)}
    examples = []
    for r in chosen:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        examples.append((at, model.values(at, np.frombuffer(r["n"], "<u4")), number[r["lang"]]))
    apart = [e for i, e in enumerate(examples) if i % 5 == 0]
    taught = [e for i, e in enumerate(examples) if i % 5]
    model.weights = follow_the_leader(taught or examples, len(languages))
    if taught and len(languages) > 1:
        scores = np.array([model.weights[:, at] @ v + model.weights[:, -1] for at, v, _ in apart])
        model.temperature = best_temperature(scores, np.array([c for *_, c in apart]))
    return model


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score; nothing but the text is read for them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.languages, model.idf, model.weights.astype(np.float64), model.temperature))
    held = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))

    def label(batches):
        known = Model(*sent.value)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                p = known.probabilities(text)
                best = int(np.argmax(p)) if p is not None else 0
                names.append(known.languages[best] if p is not None else UNKNOWN)
                scores.append(float(p[best]) if p is not None else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["_doc", "lang_pred", "score"])

    out = held.select("_doc").schema.add("lang_pred", "string").add("score", "double")
    return held.mapInArrow(label, out)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` without those of unknown language; all columns stay as they are.

    A text with a letter has a language, whatever its score; a model that has learnt nothing keeps all such texts.
    """
    if not model.languages:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return predict(docs, model, text_col=text_col).where(F.col("lang_pred") != UNKNOWN).select("_doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns the query returns; the model learns from the rows that are not held out."""
    model = fit(docs)
    known = predict(docs.select("doc_id", "text"), model)
    return known.select("_doc.doc_id", "lang_pred", "score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
