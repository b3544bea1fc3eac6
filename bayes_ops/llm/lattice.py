"""Language-model scoring by the likelihood of a subword lattice.

The vocabulary is an existing public one (a sentencepiece model file, path a
parameter; its byte pieces spell any character it lacks).  A text is the
sequence of its words, each with a word-start mark, then one end.  The model
draws pieces independently; the probability of a text is the sum over all
segmentations, taken by a forward recursion in log space.  A piece never
crosses a word start, so the text's marginal is the product of its words'
marginals and the end's, and each distinct word's lattice is summed once.

The vocabulary's own scores (ranks) give the first piece probabilities,
p ~ 1 / (rank + 10); they are then fitted to the training words: every
distinct training word is segmented once by its best path, pieces are counted
with the word's count, and the counts with 0.5 added are the new weights.

Work follows the corpus: word counts over all documents (one shuffle of
partial counts), one lattice per distinct word, and a join of word scores back
to the documents.  Words that are over 1/2^20 of all tokens -- fewer than
2^20 of them, and none over 64 bytes -- are looked up in a broadcast table;
the other words go through a join, which has no hot key since every frequent
word is in the broadcast.

Defined results: a null or empty text has one token, the end; rows that repeat
a doc_id are scored each by itself; without training documents no word is
known and the first piece probabilities hold; a null doc_id is held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import Shared, byte_texts, crc_mod, spill

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 1 << 20           # words over 1/HEAD of all tokens are broadcast: fewer than HEAD
HEAD_BYTES = 64          # and none longer than this
FLUSH = 400_000          # distinct words a task counts before it passes them on
MARK = "▁"
LN10 = math.log(10.0)


# --- the lattice ------------------------------------------------------------

def read_vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model in the order of their scores, best first.
    Byte pieces ``<0xNN>`` come as they are; control and inner-mark pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [(-sp.GetScore(i), i, sp.IdToPiece(i)) for i in range(sp.GetPieceSize())
            if not sp.IsControl(i) and not sp.IsUnknown(i)]
    ordered = [p for _, i, p in sorted(kept) if not sp.IsByte(i) and MARK not in p[1:]]
    return ordered + [f"<0x{b:02X}>" for b in range(256)]


class Lattice:
    """Piece log probabilities (natural log).

    ``ahead`` maps every piece to its log probability and every mere prefix of
    one to 1.0, so one look-up per step tells whether to go on."""

    def __init__(self, pieces: list[str], logp: list[float], end: float):
        self.byte = [0.0] * 256
        self.logp: dict[str, float] = {}
        self.index: dict[str, int] = {}
        for i, (p, v) in enumerate(zip(pieces, logp)):
            if len(p) == 6 and p.startswith("<0x"):
                self.byte[int(p[3:5], 16)] = v
            else:
                self.logp[p] = v
                self.index[p] = i
        self.first_byte = len(pieces) - 256
        self.ahead = {p[:k]: 1.0 for p in self.logp for k in range(1, len(p))} | self.logp
        self.chars: dict[str, float] = {}
        self.end = end

    def spelled(self, char: str) -> float:
        """Log probability of a character by its UTF-8 bytes."""
        return sum(self.byte[b] for b in char.encode())

    def char(self, char: str) -> float:
        """Log probability of a character, as a piece or by its bytes."""
        v = self.spelled(char)
        if char in self.logp:
            top, low = max(v, self.logp[char]), min(v, self.logp[char])
            v = top + math.log1p(math.exp(low - top))
        if len(self.chars) < 100_000:
            self.chars[char] = v
        return v

    def word(self, word: str) -> float:
        """Log probability of a word, summed over all segmentations (forward recursion)."""
        s = MARK + word
        n = len(s)
        exp, log, ahead, chars = math.exp, math.log, self.ahead.get, self.chars.get
        into: list[list[float]] = [[] for _ in range(n + 1)]
        a = 0.0
        for i in range(n):
            v = chars(s[i])
            into[i + 1].append(a + (self.char(s[i]) if v is None else v))
            j = i + 2
            while j <= n:
                v = ahead(s[i:j])
                if v is None:
                    break
                if v < 0:
                    into[j].append(a + v)
                j += 1
            terms = into[i + 1]
            if len(terms) == 1:
                a = terms[0]
            else:
                top = max(terms)
                a = top + log(sum([exp(t - top) for t in terms]))
        return a

    def best(self, word: str) -> list[int]:
        """Piece ids of the best segmentation."""
        s = MARK + word
        n = len(s)
        ahead = self.ahead.get
        score, back = [-math.inf] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            a = score[i]
            v = ahead(s[i], 1.0)
            v = a + (v if v < 0 else self.spelled(s[i]))
            if v > score[i + 1]:
                score[i + 1], back[i + 1] = v, i
            j = i + 2
            while j <= n:
                v = ahead(s[i:j])
                if v is None:
                    break
                if v < 0 and a + v > score[j]:
                    score[j], back[j] = a + v, i
                j += 1
        ids: list[int] = []
        at = n
        while at:
            i = back[at]
            piece = self.index.get(s[i:at])
            if piece is None:
                ids += [self.first_byte + b for b in reversed(s[i:at].encode())]
            else:
                ids.append(piece)
            at = i
        return ids[::-1]


def first_weights(pieces: list[str]) -> tuple[list[float], float]:
    """Log probabilities from the vocabulary's ranks; bytes and the end weigh as the last rank."""
    raw = [1 / (r + 10) for r in range(len(pieces) - 256)]
    raw += [1 / (len(pieces) + 10)] * 256
    total = sum(raw) + raw[0]
    return [math.log(v / total) for v in raw], math.log(raw[0] / total)


# --- counts -----------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows not learned from: crc32(doc_id as text) mod 10 is 0, or no id."""
    return F.coalesce(crc_mod(doc_id, 10) == 0, F.lit(True))


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in training rows), c_all (in all rows); the end is not among them."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(train.keys() | rest.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()).cast(pa.string()), pa.array([train[k] for k in keys], pa.int64()),
                 pa.array([train[k] + rest[k] for k in keys], pa.int64())], names=["word", "c", "c_all"])

        for b in it:
            for held, t in zip(b.column("held_out").to_pylist(), byte_texts(b.column("text"))):
                (rest if held else train).update(tokens(t))
                if len(train) + len(rest) > FLUSH:
                    yield out()
                    train.clear()
                    rest.clear()
        yield out()

    return (docs.select(held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(count, "word string, c long, c_all long")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")))


def fit(counts: DataFrame, ends: int, vocabulary: str = VOCABULARY) -> Lattice:
    """Piece weights fitted to the training words."""
    spark = counts.sparkSession
    pieces = read_vocabulary(vocabulary)
    logp, end = first_weights(pieces)
    start = spark.sparkContext.broadcast((pieces, logp, end))

    def segment(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, use = Lattice(*start.value), Counter()
        for b in it:
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()):
                for i in lattice.best(w):
                    use[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(use), pa.int64()), pa.array(list(use.values()), pa.int64())],
                                         names=["piece", "n"])

    used = (counts.filter("c > 0").select("word", "c").mapInArrow(segment, "piece long, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")).collect())     # one row per piece at most
    if not used:
        return Lattice(pieces, logp, end)
    n = [0.5] * len(pieces)
    for r in used:
        n[r["piece"]] += r["n"]
    total = math.log(sum(n) + ends + 0.5)
    return Lattice(pieces, [math.log(v) - total for v in n], math.log(ends + 0.5) - total)


# --- scores -----------------------------------------------------------------

_DOC = "struct<n:bigint,known:bigint,base:double,score:double,rest:array<struct<word:string,tf:bigint>>>"


def score(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Row ids are taken from the scan, so ``docs`` should come from files (or a
    spilled table): a restarted task then reads the same rows in the same order."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = spill(word_counts(docs), "counts")
    t = counts.agg(F.sum("c").alias("n"), F.sum("c_all").alias("n_all"),
                   F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    lattice = fit(counts, ends, vocabulary)
    lattice_b = Shared(spark, lattice)
    n_train, n_all, v = (t["n"] or 0) + ends, t["n_all"] or 0, (t["v"] or 0) + (ends > 0)
    under = 0.1 * (v + 1) + n_train

    def base(c: int) -> float:
        return math.log10((c + 0.1) / under) if under else 0.0

    def lattices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice_b.get()
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("c"), b.column("c_all"),
                 pa.array([base(c) for c in b.column("c").to_pylist()], pa.float64()),
                 pa.array([lat.word(w) / LN10 for w in b.column("word").to_pylist()], pa.float64())],
                names=["word", "c", "c_all", "base", "score"])

    scored = spill(counts.mapInArrow(lattices, "word string, c long, c_all long, base double, score double"), "words")
    frequent = (F.col("c_all") * head > n_all) & (F.octet_length("word") <= HEAD_BYTES)
    table = {r["word"].encode(): (r["c"] > 0, r["base"], r["score"])
             for r in scored.filter(frequent).toLocalIterator()}
    table_b = spark.sparkContext.broadcast(table)
    end_known, end_base, end_score = int(ends > 0), base(ends), lattice.end / LN10

    @F.arrow_udf(_DOC)
    def partial(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = table_b.value.get
        for a in it:
            n, known, bases, scores, rest, tfs, ends_at = [], [], [], [], [], [], [0]
            for text in byte_texts(a):
                ws = tokens(text)
                k, b, s = end_known, end_base, end_score
                for w, tf in Counter(ws).items():
                    hit = look(w)
                    if hit is None:
                        rest.append(w)
                        tfs.append(tf)
                    else:
                        k += tf * hit[0]
                        b += tf * hit[1]
                        s += tf * hit[2]
                n.append(len(ws) + 1)
                known.append(k)
                bases.append(b)
                scores.append(s)
                ends_at.append(len(rest))
            lines = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())],
                                               names=["word", "tf"])
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(bases, pa.float64()),
                 pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), lines)],
                names=["n", "known", "base", "score", "rest"])

    rows = (docs.withColumn("_d", partial.asNondeterministic()(F.col("text")))
            .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "_d"))
    # each row once by itself (no word), and once for each word that is not in the table
    # (a key with a space is no word: the row's own line meets nothing and is spread evenly)
    own = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("tf")))
    lines = rows.select("rid", "doc_id", "_d.n", "_d.known", "_d.base", "_d.score",
                        F.explode(F.concat(own, "_d.rest")).alias("w"))
    mine = F.col("w.word").isNull()
    lines = lines.select(
        "rid", F.when(mine, F.col("doc_id")).alias("doc_id"), "w.tf",
        F.coalesce("w.word", F.concat(F.lit(" "), F.col("rid").cast("string"))).alias("word"),
        *[F.when(mine, F.col(c)).alias(c) for c in ("n", "known", "base", "score")])
    w = scored.filter(~frequent).select("word", (F.col("c") > 0).cast("long").alias("wk"),
                                        F.col("base").alias("wb"), F.col("score").alias("ws"))
    got = lines.join(w, "word", "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n_tokens"),
        F.sum(F.coalesce("known", F.lit(0)) + F.coalesce(F.col("tf") * F.col("wk"), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.coalesce(F.col("tf") * F.col("wb"), F.lit(0.0))).alias("base_score"),
        F.sum(F.coalesce("score", F.lit(0.0)) + F.coalesce(F.col("tf") * F.col("ws"), F.lit(0.0))).alias("score"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
