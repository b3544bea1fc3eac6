"""Language identification in two levels.

First the language family is predicted (one-versus-rest linear support vector
machines over the families), then one-versus-one linear support vector
machines separate the languages of that family.  Features are relative
frequencies of hashed byte 1-, 2- and 3-grams of the whole text (A-Z lower-
cased, other ASCII non-letters folded to a space).

Training uses a bounded sample: about ``per_language`` labelled documents per
language, those with the smallest hash of doc_id, whole texts.  Their feature
vectors (``DIMS`` floats each), not their texts, are brought to the driver;
the fitted weights are a table of DIMS x classifiers.

Defined results: ``und`` with score 0 for a null text or one without a
letter; rows with a null doc_id or lang are never learned from; with no
labelled rows every text is ``und``.  One language learned: that language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import Shared, byte_texts, crc_mod, fresh

DIMS = 4096
PER_LANGUAGE = 500       # bound of the training sample, in documents per language
MAX_TRAIN = 8_000        # and over all languages

# Language families; a language not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def gram_codes(text: bytes) -> list[np.ndarray]:
    """Hashed positions of the 1-, 2- and 3-byte grams of the folded text."""
    a = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(257) + a[2:]
    return [a, ((two * np.uint32(2654435761)) >> np.uint32(20)) & np.uint32(DIMS - 1),
            ((three * np.uint32(2246822519)) >> np.uint32(20)) & np.uint32(DIMS - 1)]


def features(text: bytes) -> np.ndarray:
    """Sum of the relative frequencies of each order."""
    x = np.zeros(DIMS, np.float32)
    for codes in gram_codes(text):
        x += np.bincount(codes, minlength=DIMS).astype(np.float32) / len(codes)
    return x


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sq = (x * x).sum(1) + 1 / (2 * c)
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(0.0, alpha[i] - g / sq[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Weights of the family classifiers and of the pairs within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs)
        family = np.array([FAMILIES.get(v, v) for v in langs])
        self.families = sorted(set(family.tolist()))
        scale = 1 / np.sqrt(x.mean(0) + 1e-5) if len(x) else np.ones(DIMS)
        z = (x * scale).astype(np.float32)
        unit = np.sqrt((z * z).sum(1).mean()) if len(z) else 1.0
        z /= unit
        columns = []
        if len(self.families) > 1:
            columns += [svm(z, np.where(family == f, 1.0, -1.0)) for f in self.families]
        self.pairs = []
        for f in self.families:
            members = sorted(set(lang[family == f].tolist()))
            for a, b in combinations(members, 2):
                at = (lang == a) | (lang == b)
                self.pairs.append((f, a, b))
                columns.append(svm(z[at], np.where(lang[at] == a, 1.0, -1.0)))
        w = np.array(columns).reshape(len(columns), DIMS + 1)
        self.bias = w[:, -1].copy()
        self.weights = np.ascontiguousarray((w[:, :-1] * (scale / unit)).astype(np.float32))

    def margins(self, text: bytes) -> np.ndarray:
        m = self.bias.copy()
        for codes in gram_codes(text):
            for k in range(len(m)):
                m[k] += float(np.take(self.weights[k], codes).sum(dtype=np.float64)) / len(codes)
        return m

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        m = self.margins(text)
        nf = len(self.families) if len(self.families) > 1 else 0
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(3 * v, -50, 50)))
        family, score = self.families[0], 1.0
        if nf:
            best = int(np.argmax(m[:nf]))
            p = sigmoid(m[:nf])
            family, score = self.families[best], float(p[best] / max(1e-12, p.sum()))
        votes: dict[str, list[float]] = {}
        for k, (f, a, b) in enumerate(self.pairs, nf):
            if f == family:
                p = float(sigmoid(m[k]))
                for v, win in ((a, p), (b, 1 - p)):
                    t = votes.setdefault(v, [0, 0.0, 0])
                    t[0] += win >= 0.5 if v == a else win > 0.5
                    t[1] += win
                    t[2] += 1
        if not votes:
            return next(v for v in self.langs if FAMILIES.get(v, v) == family), score
        lang = max(sorted(votes), key=lambda v: (votes[v][0], votes[v][1]))
        return lang, score * votes[lang][1] / votes[lang][2]


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN) -> Model:
    """Fit on a bounded sample of the rows where ``learn`` holds and lang and text are given."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros((0, DIMS), np.float32), [])
    bound = max(1, min(per_language, max_train // len(sizes)))
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    take = F.lit(False)
    for lang, n in sizes.items():
        take = take | ((F.col("lang") == lang) & (u < int(min(1.0, 1.2 * bound / n) * (1 << 30)) + 1))

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = byte_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("u"),
                 pa.array([features(t).tobytes() if has_letter(t) else None for t in texts], pa.binary())],
                names=["lang", "u", "x"])

    got = (rows.filter(take).select("lang", u.alias("u"), "text")
           .mapInArrow(vectors, "lang string, u long, x binary").filter("x is not null"))
    by: dict[str, list] = {}
    for r in got.toLocalIterator():
        by.setdefault(r["lang"], []).append((r["u"], bytes(r["x"])))
    x, langs = [], []
    for lang in sorted(by):
        for _, v in sorted(by[lang])[:bound]:
            x.append(np.frombuffer(v, np.float32))
            langs.append(lang)
    return Model(np.array(x, np.float32).reshape(len(x), DIMS), langs)


_PRED = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def predict_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """struct<lang, score> of a text column."""
    model_b = Shared(docs.sparkSession, model)

    @F.arrow_udf("struct<lang:string, score:double>")
    def guess(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model_b.get()
        for a in it:
            yield pa.array([dict(zip(("lang", "score"), m.predict(t))) for t in byte_texts(a)], type=_PRED)
    return guess.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32(doc_id as text) mod 3 is 1, or no id."""
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(True))


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = train(docs, ~held_out(F.col("doc_id")), **kw)
    return (docs.select("doc_id", predict_column(docs, model, F.col("text")).alias("_p"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                    F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")))


def keep_identified(docs: DataFrame, min_score: float = 0.1, **kw) -> DataFrame:
    """Documents with a recognised language; ``und`` and scores under min_score go."""
    model = train(docs, ~held_out(F.col("doc_id")), **kw)
    at = fresh(docs, "_p")
    p = docs.withColumn(at, predict_column(docs, model, F.col("text")))
    return p.filter((F.col(f"{at}.lang") != "und") & (F.col(f"{at}.score") >= min_score)).select(*docs.columns)
