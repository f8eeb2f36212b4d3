"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted over all training documents. The ``OWN`` most frequent words and the end of a text are output
units of their own; all other words share ``UNITS - OWN - 1`` bins by their last bytes, and a word's share of its bin
is its add-one count (each bin keeps one place for unknown words). The model predicts the next unit from the two
before it: s(w | u1, u2) = (A u1 + B u2) . q_w + b_w with vectors of ``WIDTH`` numbers.

Training is numpy inside mapInArrow: every training document is used once, in one of a few rounds; tasks
start a round from the same parameters and their results are averaged by tokens, in two steps, so the driver
receives a bounded number of small arrays. How documents are dealt to tasks (files and cores) is part of the training: another
cluster gives a slightly different model of the same quality. Normalisation is exact: the sums over all units for all pairs of contexts
are one matrix product, exp(A q) times exp(B q + b).

Words beyond the ``HEAD`` most frequent (a bounded broadcast) find their counts in a join.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, most_frequent, segments, table, text_column

UNITS = 1024
OWN = 767
END = OWN
HEAD = 1 << 18
WIDTH = 24
NOISE = 64
BATCH = 2048
#: Step size of each round.
RATES = (0.12, 0.06, 0.03)
ROUNDS = len(RATES)


def unit_of_tail(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-3:]) % (UNITS - OWN - 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from (a null id is learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, some: int = 256) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Lower-cased words of a few documents at a time."""
    data, offsets = text_column(batch)
    whole = memoryview(data)
    for at in range(0, len(batch), some):
        yield at, [bytes(whole[offsets[i] : offsets[i + 1]]).lower().split() for i in range(at, min(at + some, len(batch)))]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, docs in texts_of(batch):
            held.update(itertools.chain.from_iterable(docs))
            if len(held) > 400_000:
                yield flush()
                held.clear()
    if held:
        yield flush()


class Lexicon:
    """The most frequent words: index in order of frequency, unit and count."""

    def __init__(self, words: list[bytes], counts: np.ndarray, end_count: int, bins: np.ndarray):
        self.words, self.counts, self.end_count, self.bins = words, counts, end_count, bins
        self.units = np.array([k if k < OWN else unit_of_tail(w) for k, w in enumerate(words)] or [0], np.int32)
        self.places: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"places": None}

    def tokens(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(head index or -1 of the words, units with ends, words a document, words outside the head)."""
        if self.places is None:
            self.places = {w: k for k, w in enumerate(self.words)}
        get = self.places.get
        flat = list(itertools.chain.from_iterable(docs))
        head = np.array([get(w, -1) for w in flat], np.int64)
        sizes = np.array([len(d) for d in docs])
        units = self.units[head]
        missing = np.flatnonzero(head < 0)
        tail = [flat[i] for i in missing.tolist()]
        units[missing] = [unit_of_tail(w) for w in tail]
        out = np.full(len(flat) + len(docs), END, np.int32)
        doc, place = segments(sizes)
        out[np.arange(len(flat)) + doc] = units
        return head, out, sizes, tail


def contexts(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each token; the end of a text stands before its beginning."""
    one = np.append(END, units[:-1])
    two = np.append([END, END], units[:-2])[: len(units)]
    begin = np.cumsum(sizes + 1) - sizes - 1
    two[begin] = END
    return one, two


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum rows by their target; returns the targets."""
    order = np.argsort(at, kind="stable")
    got = at[order]
    new = np.flatnonzero(np.append(True, got[1:] != got[:-1]))
    out[got[new]] = np.add.reduceat(rows[order], new, axis=0)
    return got[new]


class Trainer:
    """AdaGrad on the noise-contrastive objective; the noise of a batch is shared by all its contexts."""

    def __init__(self, model: dict[str, np.ndarray], noise: np.ndarray, seed: int, rate: float):
        self.rate = rate
        self.p = {k: v.copy() for k, v in model.items()}
        self.g2 = {k: np.full(v.shape, 1e-2, np.float32) for k, v in model.items()}
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(noise)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.tokens = 0

    def move(self, name: str, at: np.ndarray, gradient: np.ndarray) -> None:
        self.g2[name][at] += gradient * gradient
        self.p[name][at] += self.rate * gradient / np.sqrt(self.g2[name][at])

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(w)
        h = p["a"][one] + p["b"][two]
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), UNITS - 1)
        q, qn = p["q"][w], p["q"][noise]
        right = 1 / (1 + np.exp(np.clip((h * q).sum(1) + p["bias"][w] - self.log_noise[w], -30, 30)))
        wrong = -1 / (1 + np.exp(-np.clip(h @ qn.T + (p["bias"][noise] - self.log_noise[noise]), -30, 30)))
        to_h = right[:, None] * q + wrong @ qn
        scale = np.float32(1 / math.sqrt(n))
        gq, gb = np.zeros_like(p["q"]), np.zeros_like(p["bias"])
        add_rows(gq, w, right[:, None] * h)
        np.add.at(gq, noise, wrong.T @ h)
        gb += np.bincount(w, weights=right, minlength=UNITS).astype(np.float32)
        np.add.at(gb, noise, wrong.sum(0))
        ga, gc = np.zeros_like(p["a"]), np.zeros_like(p["b"])
        at_a, at_b = add_rows(ga, one, to_h), add_rows(gc, two, to_h)
        at_q = np.unique(np.append(w, noise))
        self.move("q", at_q, gq[at_q] * scale)
        self.move("bias", at_q, gb[at_q] * scale)
        self.move("a", at_a, ga[at_a] * scale)
        self.move("b", at_b, gc[at_b] * scale)
        self.tokens += n


NAMES = ("a", "b", "q", "bias")


def packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[k].astype("<f4").tobytes() for k in NAMES)


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    for k in NAMES:
        shape = (UNITS,) if k == "bias" else (UNITS, WIDTH)
        size = int(np.prod(shape))
        out[k] = flat[at : at + size].reshape(shape).copy()
        at += size
    return out


@frugal
def train(shared, lexicon, round_no: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, noise = shared.value
        trainer = Trainer(unpacked(model), noise, 1000 * round_no + TaskContext.get().partitionId(), RATES[round_no])
        for batch in batches:
            for _, docs in texts_of(batch):
                _, units, sizes, _ = lexicon.value.tokens(docs)
                one, two = contexts(units, sizes)
                for at in range(0, len(units), BATCH):
                    trainer.batch(units[at : at + BATCH], one[at : at + BATCH], two[at : at + BATCH])
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens]), pa.array([packed(trainer.p)], pa.binary())], names=["n", "model"])

    return run


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(raw, "<f4").astype(np.float64)
            total += n
            mean = own if mean is None else mean + (own - mean) * (n / total)
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=["n", "model"])


class Normalised:
    """log10 probabilities of units: scores less the logarithm of their sum over all units, for any context."""

    def __init__(self, model: dict[str, np.ndarray]):
        a, b = (model[k].astype(np.float64) @ model["q"].astype(np.float64).T for k in ("a", "b"))
        b += model["bias"]
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        total = np.exp(b - top_b) @ np.exp(a - top_a).T  # [two, one]
        scale = 1 / math.log(10)
        self.a, self.b = (a * scale).astype(np.float32), (b * scale).astype(np.float32)
        self.z = ((np.log(total) + top_b + top_a.T) * scale).astype(np.float32)

    def of(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.a[one, w].astype(np.float64) + self.b[two, w] - self.z[two, one]


#: The tables of the last model that this process scored with, by a digest of its bytes.
_tables: dict[bytes, Normalised] = {}


@frugal
def score(model, lexicon) -> Callable:
    """One row a document: a key, n_tokens, what the head and the model give, and the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        name = hashlib.blake2b(model.value).digest()
        if name not in _tables:
            _tables.clear()
            _tables[name] = Normalised(unpacked(model.value))
        tables = _tables[name]
        log_count = np.append(np.log10(lex.counts + 1.0), 0.0)
        log_bin = np.log10(lex.bins)
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, docs in texts_of(batch):
                head, units, sizes, tail = lex.tokens(docs)
                one, two = contexts(units, sizes)
                begin = np.cumsum(sizes + 1) - sizes - 1
                ends = np.cumsum(sizes)
                log_unit = tables.of(units, one, two)
                model_sum = np.add.reduceat(log_unit, begin)
                over = lambda x: np.diff(np.append(0.0, np.cumsum(x))[np.append(0, ends)])
                word_log = log_count[head]
                in_bin = np.where((head < 0) | (head >= OWN), word_log - log_bin[np.delete(units, ends + np.arange(len(docs)))], 0.0)
                head_log = over(word_log) + math.log10(lex.end_count + 1)
                known = over((head >= 0).astype(float)).astype(np.int64) + (lex.end_count > 0)
                outside = over((head < 0).astype(float)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(outside)).astype(np.int32)), pa.array(tail, pa.binary()))
                cols = [ids.slice(at, len(docs)), pa.array(key + np.arange(len(docs))), pa.array(sizes + 1), pa.array(known), pa.array(head_log), pa.array(model_sum + over(in_bin)), lists]
                key += len(docs)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_tokens", "known", "head_log", "model_log", "tail"])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are one end token. Rows with a null id are learned from; repeated rows count as often
    as they occur; texts of any length are learned from and scored whole; other columns aren't read. Without
    training documents all counts are zero and the model stays as it starts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id")))
    counts = cut(training.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_docs = training.count()
    summed = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_train, v = summed["n"] + n_docs, summed["v"] + (n_docs > 0)
    frequent, others = most_frequent(counts, HEAD)
    top = frequent.toArrow()  # at most HEAD rows
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    words, head_counts = top.column("word").to_pylist(), top.column("n").to_numpy()

    suffix = F.expr(f"{OWN + 1} + crc32(substring(word, -3, 3)) % {UNITS - OWN - 1}").cast("int")
    last = (int(head_counts[OWN - 1]), words[OWN - 1]) if len(words) >= OWN else None
    rest = others if last is None else counts.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > F.lit(bytearray(last[1])))))
    bins = np.ones(UNITS)
    unit_counts = np.ones(UNITS)
    for row in rest.groupBy(suffix.alias("unit")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most UNITS rows
        bins[row["unit"]] += row["n"] + row["v"]
        unit_counts[row["unit"]] += row["n"]
    own = head_counts[:OWN]
    unit_counts[: len(own)] += own
    unit_counts[END] += n_docs
    noise = unit_counts / unit_counts.sum()

    rng = np.random.default_rng(7)
    model = {k: rng.normal(0, 0.05, (UNITS, WIDTH)).astype(np.float32) for k in ("a", "b", "q")} | {"bias": np.log(noise).astype(np.float32)}
    context = spark.sparkContext
    lexicon = context.broadcast(Lexicon(words, head_counts, n_docs, bins))
    tasks = max(2, context.defaultParallelism)
    raw = packed(model)
    for k in range(ROUNDS):
        shared = context.broadcast((raw, noise))
        part = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)
        trained = part.coalesce(tasks).mapInArrow(train(shared, lexicon, k), "n long, model binary")
        means = trained.repartition(max(1, math.isqrt(tasks))).mapInArrow(average, "n long, model binary").collect()
        if means:
            total = sum(r["n"] for r in means)
            raw = sum(np.frombuffer(bytes(r["model"]), "<f4").astype(np.float64) * (r["n"] / total) for r in means).astype("<f4").tobytes()
    final = context.broadcast(raw)

    scored = cut(docs.mapInArrow(score(final, lexicon), "doc_id long, key long, n_tokens long, known long, head_log double, model_log double, tail array<binary>"), "scored")
    tail = scored.select("key", F.explode("tail").alias("word")).groupBy("key", "word").agg(F.count("*").alias("times"))
    found = tail.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored.drop("tail").join(found, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + zero("tail_known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_log") + zero("tail_log") - F.col("n_tokens") * math.log10(n_train + v + 1)).alias("base_score"),
        (F.col("model_log") + zero("tail_log")).alias("score"),
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op2_lm_scores": op2_lm_scores}
