"""Log-bilinear neural language model, trained with noise-contrastive estimation, and scores of whole texts.

A token's probability is that of its class given the two classes before it, times its share of the class. The most
frequent training tokens are classes of their own, more of them the more training text there is; all others fall into
classes by their last bytes. The class model is log-bilinear: a prediction vector, the sum of the context classes' vectors
scaled by position, meets each target class's vector and bias.

Training texts are dealt by hash into blocks of a fixed size, and blocks into rounds. In a round every block is trained on
by itself, by noise-contrastive estimation from the parameters that the last round left, and the results are averaged,
weighted by tokens, as integers. Blocks, rounds and their order follow from the texts alone, so that the model is the same
however the table is partitioned; blocks grow in number with the text, and rounds with the logarithm of that number.

Scoring normalises exactly: all normalisers for pairs of context classes come from one matrix product. Within a class, a
token has (count + 1) over the class's sum of (count + 1) plus 1 for what was never seen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, slices

#: Classes of rare tokens, width of the vectors, noise samples, tokens in a step.
BUCKETS, WIDTH, NOISE, STEP = 256, 16, 32, 512
#: Tokens with a class of their own for each doubling of the training tokens.
OWN_PER_DOUBLING = 64
START, END = 0, 1
#: Tokens of a training block on average; at most twice as many.
BLOCK = 1 << 18
#: Tokens whose counts are handed to every worker, at most (a few MB); the counts of all others are joined.
TABLE = 300_000
#: Bytes of texts that are split into words at once; a longer text is a slice of its own.
SLICE = 4_000_000
RATE = 0.15
#: Key of the end token. Keys hold 56 bits of a hash and the class of rare tokens in the last 8.
END_KEY = np.int64(-1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, all words one after another as places in a list, and that list of different words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    at, parent = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    # joined and split again, which is quicker than an object for each word
    different = coded.dictionary.cast(pa.binary())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), b" ")[0].as_py()
    words = joined.split(b" ") if len(different) else []
    if b"" in words:  # what stands before white space at a text's start and behind it at its end
        inner = at != words.index(b"")
        at, parent = at[inner], parent[inner]
    return np.bincount(parent, minlength=len(texts)).astype(np.int64), at, words


def keys_of(words: list[bytes]) -> np.ndarray:
    """A signed key for each word: 56 bits of its hash, and 8 bits from its last three bytes that name its class."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ends = np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), np.uint64, len(words))
    return ((hashes & ~np.uint64(255)) | (ends & np.uint64(255))).view(np.int64)


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    return slices(pc.binary_length(texts).to_pylist(), lambda n: n + 1, most)


def is_held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    keys: np.ndarray  # sorted keys of frequent tokens
    counts: np.ndarray
    classes: np.ndarray  # of each of them
    bucket_sums: np.ndarray  # sum of (count + 1) over a class's tokens, and 1
    noise: np.ndarray  # share of each class among training tokens
    params: np.ndarray
    first_bucket: int  # classes: start, end, tokens of their own, and from here on BUCKETS of the others

    @property
    def size(self) -> int:
        return self.first_bucket + BUCKETS

    def split(self, params: np.ndarray | None = None):
        p = self.params if params is None else params
        cut = np.cumsum([self.size * WIDTH, self.size * WIDTH, 2 * WIDTH])
        return p[: cut[0]].reshape(-1, WIDTH), p[cut[0] : cut[1]].reshape(-1, WIDTH), p[cut[1] : cut[2]].reshape(2, WIDTH), p[cut[2] :]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the table, or -1, and its class."""
        if not len(self.keys):
            return np.full(len(keys), -1), self.first_bucket + (keys & 255)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, at, -1), np.where(found, self.classes[at], self.first_bucket + (keys & 255))


def first_params(noise: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 0.1, 2 * len(noise) * WIDTH)
    bias = np.log(np.maximum(noise, 1e-9))
    return np.concatenate([vectors, np.ones(2 * WIDTH), bias]).astype(np.float32)


#: Fractions of parameters and of their squared gradients when they are summed as integers, and the most that is kept of
#: a squared gradient. With weights of 1024 tokens, sums stay exact up to 5e11 tokens a round.
_PARAM_UNIT, _SQUARE_UNIT, _MOST_SQUARE = 2.0**24, 2.0**16, 2.0**17


class Trainer:
    """Steps of noise-contrastive estimation with adaptive rates."""

    def __init__(self, model: Model, seed: int = 0, square: np.ndarray | None = None):
        self.model, self.params = model, model.params.copy()
        self.square = np.full(len(self.params), 1e-2, np.float32) if square is None else square.copy()
        self.rng = np.random.default_rng(seed)
        self.sums = np.cumsum(model.noise)
        with np.errstate(divide="ignore"):
            self.offset = np.log(NOISE * np.maximum(model.noise, 1e-9)).astype(np.float32)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        context, output, scale, bias = self.model.split(self.params)
        s_context, s_output, s_scale, s_bias = self.model.split(self.square)
        n = len(target)
        noise = np.minimum(np.searchsorted(self.sums, self.rng.random(NOISE) * self.sums[-1]), self.model.size - 1)
        r1, r2, q, qn = context[one], context[two], output[target], output[noise]
        predicted = r1 * scale[0] + r2 * scale[1]
        up = 1 / (1 + np.exp(np.clip((predicted * q).sum(1) + bias[target] - self.offset[target], -30, 30)))
        down = 1 / (1 + np.exp(-np.clip(predicted @ qn.T + bias[noise] - self.offset[noise], -30, 30)))
        to = (up[:, None] * q - down @ qn) / n
        g_scale = np.stack([(to * r1).sum(0), (to * r2).sum(0)])
        # only the rows a step touches change
        seen, g_context = row_sums(np.concatenate([one, two]), np.concatenate([to * scale[0], to * scale[1]]))
        hit, g_output = row_sums(np.concatenate([target, noise]), np.concatenate([np.column_stack([up[:, None] * predicted, up]), -np.column_stack([down.T @ predicted, down.sum(0)])]) / n)
        g_output, g_bias = g_output[:, :-1], g_output[:, -1]
        rate = RATE * np.float32(np.sqrt(n))
        for values, square, rows, grad in ((context, s_context, seen, g_context), (output, s_output, hit, g_output), (bias, s_bias, hit, g_bias), (scale, s_scale, np.arange(2), g_scale)):
            square[rows] += grad * grad * n
            values[rows] += rate * grad / np.sqrt(square[rows])

    def block(self, target: np.ndarray) -> None:
        """One pass over a block: classes of consecutive tokens, every text closed by END."""
        one, two = contexts(target)
        order = self.rng.permutation(len(target))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            self.step(one[part], two[part], target[part])

    def weighed(self, tokens: int) -> np.ndarray:
        """Parameters and squared gradients times the block's weight, as integers, so that sums don't depend on order."""
        weight = -(-tokens // 1024)
        both = np.stack([self.params * _PARAM_UNIT, np.minimum(self.square, _MOST_SQUARE) * _SQUARE_UNIT])
        return np.rint(both.astype(np.float64)).astype(np.int64) * weight


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.nonzero(np.append(True, rows[1:] != rows[:-1]))[0]
    return rows[starts], np.add.reduceat(values[order], starts, axis=0)


def contexts(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; START before a text's first."""
    one, two = np.roll(target, 1), np.roll(target, 2)
    one[:1] = two[:2] = START
    one[one == END] = START
    two[(two == END) | (one == START)] = START
    return one, two


def rounds_of(blocks: int) -> int:
    """Rounds for so many blocks: one each for a few, then as many more as the logarithm of their number."""
    return min(blocks, 3 + math.ceil(math.log2(blocks + 1)))


class Scorer:
    """Normalised log10 probabilities of classes given two context classes, from tables."""

    def __init__(self, model: Model):
        context, output, scale, bias = (x.astype(np.float64) for x in model.split())
        output, bias = output[1:], bias[1:]  # a text's start is no target
        self.one, self.two = (context * scale[0]) @ output.T, (context * scale[1]) @ output.T + bias
        top1, top2 = self.one.max(1, keepdims=True), self.two.max(1, keepdims=True)
        z = np.exp(self.one - top1) @ np.exp(self.two - top2).T
        self.norm = np.log(z) + top1 + top2.T
        self.one, self.two, self.norm = (x.astype(np.float32) for x in (self.one, self.two, self.norm))

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.one[one, target - 1].astype(np.float64) + self.two[two, target - 1] - self.norm[one, two]) / np.log(10)


def _sequences(model: Model, texts: pa.Array):
    """Of several texts: how many words each has, keys and places of all words, and classes of all tokens with each text's
    end; at: where each text's tokens begin. Only different words are hashed and looked up."""
    n, which, words = words_of(texts)
    keys = keys_of(words)
    place, classes = model.look_up(keys)
    at = np.cumsum(n + 1) - (n + 1)
    target = np.full(int((n + 1).sum()), END, np.int64)
    inner = np.ones(len(target), bool)
    inner[at + n] = False
    target[inner] = classes[which]
    return n, keys[which], place[which], target, at, inner


def _cached(shared):
    """The broadcast model's scorer, made once in each worker."""
    model = shared.value
    if not hasattr(model, "scorer"):
        model.scorer = Scorer(model)
    return model, model.scorer


def fit(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"):
    """(model, counts, train_tokens, vocabulary): counts has key and c of every training token. All training texts are
    counted and trained on; only the TABLE most frequent tokens, sums by class and averaged parameters come to the driver."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    learnt = docs.where(~is_held_out(docs[id_col])).select(F.xxhash64(docs[id_col].cast("string"), text).alias("deal"), text.alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(0), SLICE):
                _, which, words = words_of(batch.column(0).slice(lo, hi - lo))
                keys, n = keys_of(words), np.bincount(which, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[n > 0], END_KEY)), pa.array(np.append(n[n > 0], hi - lo))], ["key", "n"])

    counts = scratch.put(learnt.select("_text").mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("c")))
    total, size = counts.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    level = F.floor(F.log("c") * 16)
    levels = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, taken = None, 0
    for at, n in levels:
        if taken + n > TABLE:
            break
        least, taken = at, taken + n
    top = counts.where(level >= least if least is not None else F.lit(False)).toPandas().sort_values(["c", "key"], ascending=[False, True])
    keys, c = top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    ends = keys == END_KEY
    n_ends = int(c[ends].sum()) if ends.any() else (counts.where(F.col("key") == int(END_KEY)).agg(F.sum("c")).first()[0] or 0)
    keys, c = keys[~ends], c[~ends]
    own = min(len(keys), OWN_PER_DOUBLING * int(math.log2(total + 1)))
    first_bucket = own + 2
    classes = np.where(np.arange(len(keys)) < own, np.arange(len(keys)) + 2, first_bucket + (keys & 255))
    order = np.argsort(keys)
    sums, shares = np.ones(BUCKETS), np.zeros(first_bucket + BUCKETS)
    bucket = F.col("key").bitwiseAND(255)
    for r in counts.where(F.col("key") != int(END_KEY)).groupBy(bucket.alias("k")).agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("c")).collect():
        sums[r.k] += r.s
        shares[first_bucket + r.k] += r.c
    np.subtract.at(sums, keys[:own] & 255, c[:own] + 1)
    np.subtract.at(shares, first_bucket + (keys[:own] & 255), c[:own])
    shares[2 : 2 + own], shares[END] = c[:own], n_ends
    # a class without training tokens keeps a little mass, for words that were never seen
    noise = (shares + 1.0) / (shares[1:] + 1.0).sum()
    noise[START] = 0.0
    model = Model(keys[order], c[order], classes[order], sums, noise, first_params(noise), first_bucket)
    if total:
        model.params = train(learnt, model, total, scratch)
    return model, counts, int(total), int(size)


def train(learnt: DataFrame, model: Model, total: int, scratch: Scratch) -> np.ndarray:
    """Parameters after all rounds over the texts of learnt (deal, _text). Only sums of parameters reach the driver."""
    spark = learnt.sparkSession
    shards = -(-total // BLOCK)
    turns = rounds_of(shards)
    shared = spark.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for lo, hi in text_slices(texts, SLICE):
                _, _, _, target, at, _ = _sequences(shared.value, texts.slice(lo, hi - lo))
                parts = [x.tobytes() for x in np.split(target.astype("<i2"), at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("deal").slice(lo, hi - lo), pa.array(parts, pa.binary())], ["deal", "seq"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows sorted by shard: a shard's texts one after another, cut after 2 * BLOCK tokens. Rows stream by, so
        that a shard of any size takes no more memory than a block."""
        most, now, part, held, size = 4 * BLOCK, None, 0, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(now + part) % turns], pa.int32()), pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["turn", "shard", "part", "seq"])

        for batch in batches:
            for shard, seq in zip(batch.column("shard").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if shard != now:
                    if size:
                        yield block()
                    now, part, held, size = shard, 0, [], 0
                while size + len(seq) > most:
                    held.append(seq[: most - size])
                    seq = seq[most - size :]
                    yield block()
                    part, held, size = part + 1, [], 0
                held.append(seq)
                size += len(seq)
        if size:
            yield block()

    dealt = learnt.mapInArrow(lean(classify), "deal long, seq binary").withColumn("shard", F.pmod("deal", F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "deal").select("shard", "seq")
    blocks = scratch.put(dealt.mapInArrow(lean(gather), "turn int, shard long, part int, seq binary"))
    in_turn = {r.turn: r.n for r in blocks.groupBy("turn").agg(F.count("*").alias("n")).collect()}

    square = None
    for turn in range(turns):
        if not in_turn.get(turn):
            continue
        state = spark.sparkContext.broadcast((model.params, square))

        def learn(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            start, total_weight, sums = shared.value, 0, None
            start.params, before = state.value
            for batch in batches:
                for shard, part, seq in zip(*[batch.column(c).to_pylist() for c in ("shard", "part", "seq")], strict=True):
                    target = np.frombuffer(seq, "<i2").astype(np.int64)
                    trainer = Trainer(start, seed=(shard, part), square=before)
                    trainer.block(target)
                    sums = trainer.weighed(len(target)) if sums is None else sums + trainer.weighed(len(target))
                    total_weight += -(-len(target) // 1024)
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total_weight], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["w", "sums"])

        found = blocks.where(F.col("turn") == turn).mapInArrow(lean(learn), "w long, sums binary")
        weight, sums = add_up(found, in_turn[turn], scratch)
        mean = sums.reshape(2, -1) / weight
        model.params, square = (mean[0] / _PARAM_UNIT).astype(np.float32), np.maximum(mean[1] / _SQUARE_UNIT, 1e-2).astype(np.float32)
        state.destroy()
    scratch.drop(blocks)
    return model.params


def add_up(found: DataFrame, rows: int, scratch: Scratch, fan: int = 16) -> tuple[int, np.ndarray]:
    """Sums of (w, sums) over all rows, of which there are at most so many: in a tree where a driver would get too many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, out = 0, None
        for batch in batches:
            for n, x in zip(batch.column("w").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                w, out = w + n, np.frombuffer(x, np.int64) + (0 if out is None else out)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["w", "sums"])

    while rows > fan:
        rows = -(-rows // fan)
        found = scratch.put(found.repartition(rows).mapInArrow(lean(add), "w long, sums binary"))
    batch = next(add([pa.RecordBatch.from_pandas(found.toPandas(), schema=pa.schema([("w", pa.int64()), ("sums", pa.binary())]))]))
    return batch.column("w")[0].as_py(), np.frombuffer(batch.column("sums")[0].as_py(), np.int64)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z lower-cased, and one end. The model learns from all texts that are not held out. base_score
    is the sum of log10((c + 1) / (N + V + 1)) over the tokens. Counts of frequent tokens (at most TABLE) go to every
    worker; occurrences of all other tokens are joined with their counts and summed by row.

    A null text counts as empty, a single end. A null id is in training. Repeated rows are counted and scored each. With
    no training text, N and V are 0. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    model, counts, total, size = fit(docs, scratch, id_col, text_col)
    shared = spark.sparkContext.broadcast(model)
    floor = float(np.log10(total + size + 1))
    ends = counts.where(F.col("key") == int(END_KEY)).agg(F.sum("c")).first()[0] or 0
    rows = docs.select(docs[id_col].alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, score = _cached(shared)
        table_logs = np.log10(known.counts + 1.0)
        bucket_logs = np.log10(known.bucket_sums)
        for batch in batches:
            texts = batch.column("_text")
            for lo, hi in text_slices(texts, SLICE):
                n, keys, place, target, at, inner = _sequences(known, texts.slice(lo, hi - lo))
                one, two = contexts(target)
                in_table = place >= 0
                logs = np.zeros(len(keys))
                logs[in_table] = table_logs[place[in_table]]
                base, lm = np.full(len(target), np.log10(ends + 1.0)), score(one, two, target)
                base[inner] = logs
                shared_class = target[inner] >= known.first_bucket
                lm[inner] += np.where(shared_class, logs - bucket_logs[keys & 255], 0.0)
                hits = np.full(len(target), int(ends > 0))
                hits[inner] = in_table
                rare_at = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[~in_table], minlength=len(n))))
                rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(keys[~in_table]))
                sums = [np.add.reduceat(x, at) for x in (base, lm, hits)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(n + 1), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), rare], ["doc_id", "held_out", "n_tokens", "base", "lm", "hits", "rare"])

    found = rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, base double, lm double, hits long, rare array<long>")
    found = scratch.put(found.withColumn("rid", F.monotonically_increasing_id()))
    rare = found.select("rid", F.explode("rare").alias("key")).join(counts, "key")
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("more_hits"))
    out = found.drop("rare").join(rare, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("lm") + more).alias("score"),
    )
