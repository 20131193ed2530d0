"""Toxicity of texts: a support vector machine over a subsequence string kernel with Nyström landmarks.

A text is cut into sentences, a sentence into units: words with letters next to each other joined where they are written
one by one, and windows of `WIDE` characters where a word is longer. The kernel of two units is the sum over their common
subsequences of `ORDER` characters, each weighted by `DECAY` to the lengths it spans in both, divided by the units' own
norms: inserted characters and gaps lower it, they don't end it. Landmarks are words that tell toxic rows from others, and
frequent words beside them. A sentence is described by its greatest kernel with each landmark, taken into the landmarks'
Nyström space; the machine is trained there on labelled sentences, a text's decision is that of its worst sentence, and a
sigmoid fitted on rows kept apart makes it a score.

The model is fitted on at most `SAMPLE` labelled rows of each label, chosen by a hash of their ids; their texts are found by
a broadcast of that bounded list. Of a row labelled 0 the sentence nearest to the landmarks and one other are labelled 0. Of a
row labelled 1 those sentences are labelled 1 that hold a word which rows labelled 1 have and others hardly do; where none
does, the one nearest to the landmarks is, so spoilt forms of such words are learnt from too. Its other sentences teach
nothing.

A unit shares no subsequence of `ORDER` characters with a landmark unless their longest common subsequence is that long,
which bit-parallel sums tell for all units at once; the kernel itself is computed for those that remain.

Defined cases: null and empty texts, and texts without words, get the score of a text without any landmark; rows without an
id teach nothing, as no label names them, and count as the empty text in the split; repeated rows are kept, and rows of one id
teach once; of several labels of one id the greatest holds; texts and words of any length are read whole; with no labels, or labels of one
kind, every score is 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions.scale import spread
from postingworks.session import materialize

ORDER, DECAY = 4, 0.6
WIDE, STEP = 24, 12
LANDMARKS, PLAIN_LANDMARKS, LONGEST_LANDMARK = 40, 8, 12
SAMPLE = 3_000
SENTENCES = 12_000
CACHE = 400_000
SENTENCE = re.compile(r"[.!?](?=\s)|\n").split
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def units(sentence: str) -> list[str]:
    """Words of a sentence that can share a subsequence of `ORDER` characters with a landmark, lowered, without marks at
    their ends; letters written one by one are one word."""
    out, single = [], []
    for token in sentence.lower().split():
        word = token if token.isalnum() else EDGES.sub("", token)
        if len(word) == 1:
            single.append(word)
            continue
        if len(single) >= ORDER:
            out.append("".join(single))
        single = []
        if len(word) >= ORDER:
            out.append(word)
    if len(single) >= ORDER:
        out.append("".join(single))
    return [w for word in out for w in ([word] if len(word) <= WIDE else
                                        [word[a:a + WIDE] for a in range(0, len(word) - WIDE + STEP, STEP)])]


def codes(words: list[str], wide: int = WIDE) -> np.ndarray:
    """Code points of words in rows of one width, 0 beyond their ends."""
    flat = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat.reshape(len(words), wide)


def widest(words: np.ndarray) -> int:
    return int((words != 0).any(axis=0).sum())


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The subsequence kernel of row i of `a` with row i of `b` (code points, 0 beyond the end), without norms.

    `m[q]` holds, per place of b, the weight of common subsequences of length q that end at or before the places reached,
    with the decay up to there (the usual recursion, a place of `a` at a time over all rows at once).
    """
    high, wide = widest(a), widest(b)
    n, at = len(a), np.ascontiguousarray(b[:, :wide].T)  # a place of b in each row: all steps run along the pairs
    total = np.zeros(n)
    m = np.zeros((ORDER, wide + 1, n))
    m[0] = 1.0
    for i in range(high):
        own = a[:, i]
        same = (at == own) & (own != 0)
        total += DECAY ** 2 * np.where(same, m[ORDER - 1, :-1], 0.0).sum(axis=0)
        for q in range(min(ORDER - 1, i + 1), 0, -1):
            ending = np.where(same, m[q - 1, :-1] * DECAY ** 2, 0.0)
            for j in range(1, wide):
                ending[j] += DECAY * ending[j - 1]
            m[q] *= DECAY
            m[q, 1:] += ending
    return total


def common_lengths(words: np.ndarray, landmarks: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of every word (row of code points) with every landmark."""
    out = np.zeros((len(words), len(landmarks)), dtype=np.int8)
    letters = {c: k + 1 for k, c in enumerate(sorted({c for w in landmarks for c in w}))}
    known = np.array([ord(c) for c in letters], dtype=np.uint32)
    at = np.searchsorted(known, words)
    place = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == words), at + 1, 0)
    per = 64 // (LONGEST_LANDMARK + 1)
    for first in range(0, len(landmarks), per):
        some = landmarks[first:first + per]
        match = np.zeros(len(letters) + 1, dtype=np.uint64)
        guard = 0
        for f, w in enumerate(some):
            shift = f * (LONGEST_LANDMARK + 1)
            guard |= 1 << (shift + LONGEST_LANDMARK)
            for j, c in enumerate(w):
                match[letters[c]] |= np.uint64(1 << (shift + j))
        v = np.full(len(words), (1 << 64) - 1, dtype=np.uint64) & ~np.uint64(guard)
        for i in range(widest(words)):
            hit = match[place[:, i]]
            v = ((v + (v & hit)) | (v & ~hit)) & ~np.uint64(guard)
        for f, w in enumerate(some):
            mine = (~v >> np.uint64(f * (LONGEST_LANDMARK + 1))) & np.uint64((1 << len(w)) - 1)
            out[:, first + f] = np.bitwise_count(mine)
    return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    space: np.ndarray | None = None  # from kernels with the landmarks to their Nyström space
    weights: np.ndarray | None = None  # the last is the constant
    slope: float = 1.0
    shift: float = 0.0

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels of units with the landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        marks = codes(self.landmarks, LONGEST_LANDMARK)
        own = np.sqrt(kernel(marks, marks))
        order = np.argsort([len(w) for w in words], kind="stable")  # words of one length have no empty places
        for a in range(0, len(words), 4000):
            mine = order[a:a + 4000]
            given = codes([words[i] for i in mine])
            rows, columns = np.nonzero(common_lengths(given, self.landmarks) >= ORDER)
            if len(rows):
                kept, where = np.unique(rows, return_inverse=True)
                norm = np.sqrt(kernel(given[kept], given[kept]))
                for k in range(0, len(rows), 8000):
                    r, c, w = rows[k:k + 8000], columns[k:k + 8000], where[k:k + 8000]
                    out[mine[r], c] = kernel(given[r], marks[c]) / (norm[w] * own[c])
        return out

    def decisions(self, values: np.ndarray) -> np.ndarray:
        """Of sentences described by their greatest kernels."""
        return values @ (self.space @ self.weights[:-1]) + self.weights[-1]


class Described:
    """Greatest kernels of sentences; a worker keeps those of the units it has seen, up to `CACHE` of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.zero = np.zeros(len(model.landmarks), dtype=np.float32)

    def sentences(self, split: list[list[str]]) -> np.ndarray:
        """A row per sentence, given as its units."""
        distinct = list(dict.fromkeys(u for s in split for u in s))
        new = [u for u in distinct if u not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, distinct
        values = self.model.kernels(new)
        some = values.any(axis=1)
        self.known.update((u, v if s else None) for u, v, s in zip(new, values, some, strict=True))
        out = np.zeros((len(split), len(self.zero)), dtype=np.float32)
        for i, s in enumerate(split):
            found = [v for v in map(self.known.__getitem__, s) if v is not None]
            if found:
                out[i] = np.max(found, axis=0)
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The decision of each text's worst sentence."""
        split, owner = [], []
        for i, text in enumerate(texts):
            for sentence in SENTENCE(text or ""):
                split.append(units(sentence))
                owner.append(i)
        best = np.full(len(texts), -np.inf)
        if split:
            np.maximum.at(best, np.array(owner), self.model.decisions(self.sentences(split)))
        return best


def separator(x: np.ndarray, y: np.ndarray, *, cost: float = 10.0, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine (labels 1 and -1, both kinds of equal weight) by dual coordinate ascent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    squares = (x * x).sum(axis=1)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1.0) / squares[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def sigmoid(decision: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the sigmoid of greatest likelihood, with smoothed targets; Newton steps, a little held back."""
    ones = int(label.sum())
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.column_stack([decision, np.ones(len(decision))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(-(x @ at), -500, 500)))
        grad = x.T @ (p - target) + 1e-3 * at
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
        at = at - step / max(1.0, float(np.abs(step).max()))
    return float(max(at[0], 1e-3)), float(at[1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def teaching(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """At most `sample` rows of each label: text, toxic (0 or 1) and a key by which some are kept apart."""
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"))
    keyed = known.where("toxic IN (0, 1)").withColumn("key", F.xxhash64(F.col("id").cast("string")))
    some = [keyed.where(F.col("toxic") == t).orderBy("key", "id").limit(sample) for t in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(some[0].unionAll(some[1])), "id")
    return rows.groupBy("id").agg(F.min_by(F.struct("text", "toxic", "key"), F.xxhash64("text")).alias("r")).select("r.*")


def words_of_rows(rows: DataFrame) -> DataFrame:
    """unit, and in how many rows labelled 1 and 0 it stands."""
    def found(batches):
        for batch in batches:
            words, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted({u for s in SENTENCE(text) for u in units(s)})
                words += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["unit", "toxic"])

    return rows.select("text", "toxic").mapInArrow(found, "unit string, toxic int").groupBy("unit").agg(
        F.sum("toxic").cast("bigint").alias("bad"), F.sum(1 - F.col("toxic")).cast("bigint").alias("good"))


def chosen_landmarks(telling: list[str], plain: list[str]) -> list[str]:
    """Words in turn, none too like an earlier one."""
    out: list[str] = []
    for words, more in ((telling, LANDMARKS), (plain, PLAIN_LANDMARKS)):
        most = len(out) + more
        for w in words:
            w = w[:LONGEST_LANDMARK]
            if len(out) < most and (not out or Model([*out]).kernels([w]).max() < 0.75):
                out.append(w)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **columns) -> Model:
    """A model of the labelled rows that are not held out."""
    rows = materialize(spread(teaching(docs, labels, sample=sample, **columns)), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    counts = materialize(words_of_rows(rows), "units")
    bad, good = F.col("bad") / sizes[1], (F.col("good") + 0.5) / sizes[0]
    # so many rows labelled 1 that a word of no meaning is hardly found in them alone
    least = max(5, int(np.ceil(9.0 / np.log((sizes[0] + sizes[1]) / sizes[1]))))
    telling = counts.where((F.col("bad") >= least) & (bad >= 10 * good)).orderBy(
        (F.col("bad") * F.log(bad / good)).desc(), "unit").limit(5000)
    plain = counts.where("bad + good >= 3").orderBy((F.col("bad") + F.col("good")).desc(), "unit").limit(100)
    told = [r["unit"] for r in telling.collect()]
    if not told:
        return Model()
    model = Model(chosen_landmarks(told[:400], [r["unit"] for r in plain.collect()]))
    telling_marks = len(chosen_landmarks(told[:400], []))
    gram = model.kernels(model.landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    kept = value > 1e-6
    model.space = vector[:, kept] / np.sqrt(value[kept])
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, frozenset(told)))

    def taught(batches):
        own, marks = sent.value
        described = Described(own)
        for batch in batches:
            keys, labels_out, values = [], [], []
            for text, label, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = [u for u in map(units, SENTENCE(text)) if u]
                if not split:
                    continue
                told_apart = [u for u in split if not marks.isdisjoint(u)] if label else []
                v = described.sentences(told_apart or split)
                nearest = int(np.argmax(v[:, :telling_marks].max(axis=1)))
                some = range(len(told_apart)) if told_apart else {nearest} if label else {nearest, key % len(split)}
                for i in some:
                    keys.append(key)
                    labels_out.append(label)
                    values.append(v[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels_out, pa.int32()),
                                              pa.array(values, pa.binary())], names=["key", "toxic", "v"])

    apart = F.pmod(F.col("key"), F.lit(5)) == 0
    vectors = rows.where(~apart).select("text", "toxic", "key").mapInArrow(taught, "key bigint, toxic int, v binary")
    some = [r for t in (0, 1) for r in vectors.where(F.col("toxic") == t).orderBy("key", "v").limit(SENTENCES // 2).collect()]
    x = np.frombuffer(b"".join(r["v"] for r in some), dtype=np.float32).reshape(len(some), len(model.landmarks)).astype(np.float64)
    y = np.array([1 if r["toxic"] else -1 for r in some])
    if len(set(y.tolist())) < 2:
        return Model()
    model.weights = separator(x @ model.space, y)
    judged = decided(rows.where(apart), model, "text").select("_doc.toxic", "decision").collect()  # a fifth of the sample
    label = np.array([r["toxic"] for r in judged])
    if len(set(label.tolist())) == 2:
        model.slope, model.shift = sigmoid(np.array([r["decision"] for r in judged]), label)
    return model


def decided(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """Each row as `_doc`, and the decision of its worst sentence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))

    def judge(batches):
        described = Described(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = [described.texts(texts[a:a + 500]) for a in range(0, len(texts), 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(values or [np.zeros(0)]), pa.float64())],
                                             names=["_doc", "decision"])

    return held.mapInArrow(judge, held.select("_doc").schema.add("decision", "double"))


def scored(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Each row as `_doc`, and its score from 0 to 1."""
    if model.weights is None:
        return docs.select(F.struct("*").alias("_doc"), F.lit(0.0).alias("score"))
    return decided(docs, model, text_col).select("_doc", (
        1 / (1 + F.exp(-(F.col("decision") * model.slope + model.shift)))).alias("score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns the query returns; the model learns from the rows that are not held out."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("_doc.doc_id", "score").select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
