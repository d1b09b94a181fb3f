"""Log-bilinear neural language model, trained with noise-contrastive estimation.

Tokens are runs of characters that are not ASCII blanks, A-Z lower-cased, then one end per text.
Every token belongs to a class: the `OWN_CLASSES` most frequent tokens and the end have one of their
own, all others share `SHAPES` classes by their last two bytes, which also places tokens never seen.
The network predicts the class from the two tokens before it: position matrices turn their
embeddings into a predicted embedding, whose products with all class embeddings, normalised over the
classes, are the probabilities. Within a shared class a token has its smoothed share of the counts,
(c + 1) / (T + V + 1), so that all tokens and one unseen token per class add up to one.

What is learnt grows with the corpus: tokens of all training texts are counted (combined per task,
then by token), and each task trains on all its training texts from the same start; the parameters
are averaged by how many tokens stand behind them. Repeated contexts within a task are trained on
once, weighted by their number.

Scoring: contexts of a portion of texts are made distinct and go through the matrix product in
blocks. Counts of the most frequent tokens, at most `HEAD_TOKENS`, are broadcast, a bounded table; the
rest of a text's tokens, distinct with their number, meets the counts in a join. None of them makes
up more than about one in HEAD_TOKENS of the training tokens, so no key of that join is hot in
training texts.

Null texts count as empty: one token, the end. Without any training text every class is equally
likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.pieces import portions
from cueflow.session import settle

OWN_CLASSES = 448
SHAPES = 64
HEAD_TOKENS = 65_536
DIMENSIONS = 24
NOISE = 64
RATE = 0.3
MINIBATCH = 512
#: Tokens counted or trained on before a task passes them on.
TOKENS_AT_ONCE = 500_000
CONTEXTS_AT_ONCE = 4096
END = b""
SEED = 11


def tokens(text: str | None) -> list[bytes]:
    """Tokens of a whole text, the end as an empty one."""
    return [*(text or "").encode().lower().split(), END]  # on bytes: ASCII letters and blanks only


def shape(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SHAPES


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, n) over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counter: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counter.keys(), pa.binary()), pa.array(counter.values(), pa.int64())],
                ["token", "n"])

        counter: Counter = Counter()
        for batch in batches:
            for part in portions(batch.column(0).to_pylist()):
                for text in part:
                    counter.update(tokens(text))
                if len(counter) > TOKENS_AT_ONCE:
                    yield rows(counter)
                    counter = Counter()
        yield rows(counter)

    return (
        docs.select(text_col).mapInArrow(run, "token binary, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
    )


@dataclass
class Vocabulary:
    """Head tokens with counts and classes, and what is known of the shared classes."""

    head: dict[bytes, int]
    head_class: np.ndarray
    head_count: np.ndarray
    n_tokens: int
    n_distinct: int
    own: int
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return self.own + SHAPES

    @cached_property
    def unigram(self) -> np.ndarray:
        """Smoothed share of each class."""
        counts = np.zeros(self.classes)
        mine = self.head_class < self.own
        counts[self.head_class[mine]] = self.head_count[mine]
        counts[self.own:] = self.shape_tokens
        return (counts + 1) / (counts.sum() + self.classes)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place in the head of each token, -1 outside."""
        get = self.head.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def classes_of(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        inside = at >= 0
        out[inside] = self.head_class[at[inside]]
        out[~inside] = [self.own + shape(words[i]) for i in np.flatnonzero(~inside).tolist()]
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Only the head and sums per shape come to the driver, both bounded by parameters."""
    # the lowest of a fixed list of counts that no more than HEAD_TOKENS tokens reach
    steps = sorted({int(2 ** (k / 4)) for k in range(250)})
    reached = [F.sum((F.col("n") >= step).cast("long")) for step in steps]
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"),
                       F.array(*reached).alias("reached")).first()
    least = next(step for step, k in zip(steps, total.reached, strict=True)
                 if (k or 0) <= HEAD_TOKENS)
    top = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.token))
    words = [bytes(r.token) for r in top]
    count = np.array([r.n for r in top], np.int64)
    own = {END: 0}
    for w in words:
        if len(own) > OWN_CLASSES:
            break
        own.setdefault(w, len(own))
    if END not in words:  # it occurs once per text and may be rarer than the head
        words.append(END)
        count = np.append(count, sum(r.n for r in counts.filter(F.col("token") == F.lit(END)).collect()))
    head_class = np.array([own.get(w, len(own) + shape(w)) for w in words], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, distinct = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            shapes = [shape(w) if w not in own else -1 for w in batch.column(0).to_pylist()]
            at = np.array(shapes, np.int64)
            keep = at >= 0
            n = batch.column(1).to_numpy(zero_copy_only=False)
            np.add.at(seen, at[keep], n[keep])
            np.add.at(distinct, at[keep], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SHAPES)), pa.array(seen), pa.array(distinct)], ["shape", "t", "v"])

    shapes = counts.mapInArrow(run, "shape long, t long, v long").groupBy("shape").agg(
        F.sum("t").alias("t"), F.sum("v").alias("v")).collect()
    t, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in shapes:
        t[r.shape], v[r.shape] = r.t, r.v
    return Vocabulary({w: i for i, w in enumerate(words)}, head_class, count, total.n or 0, total.v,
                      len(own), t, v)


@dataclass
class LogBilinear:
    """Embeddings of classes as context and as target, position matrices and biases."""

    context: np.ndarray  # one more row than classes: before the beginning
    target: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(SEED)
        c, d = len(unigram), DIMENSIONS
        draw = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
        return LogBilinear(draw(c + 1, d), draw(c, d), np.eye(d, dtype=np.float32) + draw(d, d),
                           np.eye(d, dtype=np.float32) * np.float32(0.5) + draw(d, d),
                           np.log(unigram).astype(np.float32))

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.near, self.far, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, values: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for p in self.parts:
            out.append(values[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return LogBilinear(*out)

    def predicted(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return self.context[near] @ self.near + self.context[far] @ self.far

    def log_probabilities(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all classes, normalised, one row per context."""
        logits = self.predicted(near, far) @ self.target.T + self.bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


class Trainer:
    """Noise-contrastive estimation by AdaGrad; noise is shared within a minibatch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.model = model.filled(model.flat())
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.model.parts]
        self.rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)

    def learn(self, triples: np.ndarray) -> None:
        """`triples`: packed (far, near, class), one per token.

        A distinct triple has the weight of all its occurrences; the weights of one call have mean 1.
        """
        size = len(self.unigram) + 1
        distinct, weight = np.unique(triples, return_counts=True)
        order = self.rng.permutation(len(distinct))
        far, rest = np.divmod(distinct[order], size * size)
        near, klass = np.divmod(rest, size)
        weight = (weight[order] / weight.mean()).astype(np.float32)
        for i in range(0, len(order), MINIBATCH):
            at = slice(i, i + MINIBATCH)
            self._step(near[at], far[at], klass[at], weight[at])

    def _step(self, near, far, klass, weight) -> None:
        noise = self.rng.choice(len(self.unigram), NOISE, p=self.unigram)
        for p, s, d in zip(self.model.parts, self.squares,
                           self.gradients(near, far, klass, weight, noise), strict=True):
            d = d / np.float32(MINIBATCH)
            s += d * d
            p += RATE * d / np.sqrt(s)

    def gradients(self, near, far, klass, weight, noise) -> tuple[np.ndarray, ...]:
        """By part of the model, summed over the triples."""
        m = self.model
        x, y = m.context[near], m.context[far]
        q = x @ m.near + y @ m.far
        true = (q * m.target[klass]).sum(1) + m.bias[klass] - self.log_noise[klass]
        false = q @ m.target[noise].T + m.bias[noise] - self.log_noise[noise]
        # gradients of the log-likelihood of telling data from noise
        g_true = weight / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = -weight[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        dq = g_true[:, None] * m.target[klass] + g_false @ m.target[noise]
        d_target = sums_by_row(
            len(m.target), np.concatenate([klass, noise]), np.vstack([
                np.column_stack([g_true[:, None] * q, g_true]),
                np.column_stack([g_false.T @ q, g_false.sum(0)])]))
        d_context = sums_by_row(
            len(m.context), np.concatenate([near, far]), np.vstack([dq @ m.near.T, dq @ m.far.T]))
        return d_context, d_target[:, :-1], x.T @ dq, y.T @ dq, d_target[:, -1]


def sums_by_row(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` by the row `at` that each belongs to."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    own = at[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    out[own[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def triples_of(classes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(near, far) classes before each token of texts laid end to end; `size` - 1: none."""
    none = size - 1
    near = np.concatenate([[none], classes[:-1]])
    far = np.concatenate([[none, none], classes[:-2]])[:len(classes)]
    starts = np.cumsum(lengths) - lengths
    near[starts] = none
    far[starts] = none
    second = starts[lengths > 1] + 1
    far[second] = none
    return near, far


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> LogBilinear:
    """Each task trains on its rows from the same start; parameters are averaged by tokens."""
    begin = LogBilinear.start(vocab.unigram)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, begin = shared.value
        trainer, size, seen, held = Trainer(begin, vocab.unigram, SEED), vocab.classes + 1, 0, []

        def learn() -> None:
            trainer.learn(np.concatenate(held))
            held.clear()

        for batch in batches:
            for part in portions(batch.column(0).to_pylist()):
                cut = [tokens(t) for t in part]
                words = [w for c in cut for w in c]
                classes = vocab.classes_of(words, vocab.places(words))
                near, far = triples_of(classes, np.array([len(c) for c in cut]), size)
                held.append((far * size + near) * size + classes)
                seen += len(words)
                if sum(map(len, held)) > TOKENS_AT_ONCE:
                    learn()
        if held:
            learn()
        if seen:
            values = trainer.model.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(values.astype(np.float64)),
                 pa.array(np.full(len(values), float(seen)))], ["place", "value", "weight"])

    rows = (
        docs.select(text_col).mapInArrow(run, "place long, value double, weight double")
        .groupBy("place")
        .agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
        .collect()
    )
    values = begin.flat()
    for r in rows:
        values[r.place] = r.value
    return begin.filled(values)


def _class_scores(model: LogBilinear, near, far, classes, size: int) -> np.ndarray:
    """log10 P(class | context) of each token, one matrix product per block of distinct contexts."""
    contexts, which = np.unique(far * size + near, return_inverse=True)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(0, len(contexts) + CONTEXTS_AT_ONCE,
                                                     CONTEXTS_AT_ONCE))
    out = np.empty(len(classes))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a == b:
            continue
        block = contexts[i * CONTEXTS_AT_ONCE:(i + 1) * CONTEXTS_AT_ONCE]
        log_p = model.log_probabilities(block % size, block // size)
        own = order[a:b]
        out[own] = log_p[which[own] - i * CONTEXTS_AT_ONCE, classes[own]]
    return out / np.log(10)


def score(
    docs: DataFrame, vocab: Vocabulary, model: LogBilinear, counts: DataFrame,
    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, `carry`, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    names = ["n_tokens", "head_known", "head_logs", "shape_logs", "rest", "rest_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        size = vocab.classes + 1
        head_log = np.log10(vocab.head_count + 1)
        shape_log = np.log10(vocab.shape_tokens + vocab.shape_distinct + 1)
        for batch in batches:
            done = 0
            for part in portions(batch.column(0).to_pylist()):
                cut = [tokens(t) for t in part]
                lengths = np.array([len(c) for c in cut])
                words = [w for c in cut for w in c]
                starts = np.cumsum(lengths) - lengths
                at = vocab.places(words)
                classes = vocab.classes_of(words, at)
                near, far = triples_of(classes, lengths, size)
                inside, shared_class = at >= 0, classes >= vocab.own
                logs = np.where(inside, head_log[at] if len(head_log) else 0.0, 0.0)
                by_model = _class_scores(model, near, far, classes, size)
                by_model -= np.where(shared_class, shape_log[np.maximum(classes - vocab.own, 0)], 0.0)
                # a shared class's head tokens: their counts are known here
                by_model += np.where(shared_class & inside, logs, 0.0)
                rest = [Counter(w for w in c if w not in vocab.head) for c in cut]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(done, len(part)) for c in batch.columns[1:]), pa.array(lengths),
                     pa.array(np.add.reduceat((inside & (vocab.head_count[at] > 0)).astype(np.int64)
                                              if len(head_log) else np.zeros(len(at), np.int64),
                                              starts)),
                     pa.array(np.add.reduceat(logs, starts)),
                     pa.array(np.add.reduceat(by_model, starts)),
                     pa.array([list(r) for r in rest], pa.list_(pa.binary())),
                     pa.array([list(r.values()) for r in rest], pa.list_(pa.int64()))],
                    [id_col, *carry, *names])
                done += len(part)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]
    fields += ["n_tokens long", "head_known long", "head_logs double", "shape_logs double",
               "rest array<binary>", "rest_n array<long>"]
    rows = settle(
        docs.select(F.col(text_col).alias("__text"), id_col, *carry)
        .mapInArrow(run, ", ".join(fields))
        .withColumn("__row", F.monotonically_increasing_id()), "scored")
    met = (
        rows.select("__row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r"))
        .select("__row", F.col("r.rest").alias("token"), F.col("r.rest_n").alias("times"))
        .join(counts, "token", "left")
        .groupBy("__row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rest_logs"))
    )
    rest_logs = F.coalesce("rest_logs", F.lit(0.0))
    share = float(np.log10(vocab.n_tokens + vocab.n_distinct + 1))
    return rows.join(met, "__row", "left").select(
        id_col, *carry, "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head_logs") + rest_logs - F.col("n_tokens") * share).alias("base_score"),
        (F.col("shape_logs") + rest_logs).alias("score"))


def train_and_score(
    docs: DataFrame, held_out_col: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores of all rows by a model of those whose `held_out_col` is false."""
    training = docs.filter(~F.col(held_out_col))
    counts = settle(count_tokens(training, text_col), "token-counts")
    vocab = vocabulary(counts)
    model = train(training, vocab, text_col)
    return score(docs, vocab, model, counts, id_col, text_col, (held_out_col,))
