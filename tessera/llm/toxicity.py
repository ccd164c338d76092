"""Toxicity scores of texts restored from leetspeak, spacing and repetition by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import ship
from .common import Scratch, lean

#: Labelled rows that the models are fitted on at most.
MAX_TRAIN = 8_000
#: Distinct words a worker holds before it counts their trigrams, and trigrams before it passes them on.
MOST_WORDS, MOST_TRIGRAMS = 200_000, 300_000
#: Letters with trigrams of their own, the most frequent ones; all others count as one letter. With both ends of words the
#: table has fewer than (LETTERS + 3)**3 rows, whatever scripts there are.
LETTERS = 96
OTHER = "\uffff"
BITS = 22
PREFIXES = (4, 5, 6, 7)
#: Fixed letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l", "€": "e"}
SEPARATORS = ".-_*~ "
#: Costs in nats: keeping a letter, reading a sign as a letter, dropping a separator, dropping a repeated letter.
SIGN_COST, GAP_COST, REPEAT_COST = 0.7, 0.2, 0.3
#: Nats a letter of the character model beyond which a token is a key or an address, and no obfuscated word.
WORST = 4.5

_SIGN = "".join(re.escape(c) for c in LEET)
_LETTER = r"[^\W\d_]"
_WORDS = re.compile(_LETTER + "+")
#: Three or more single letters or signs in a row, blanks between them.
_SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}|[{_SIGN}])(?: +(?:{_LETTER}|[{_SIGN}])){{2,}}(?!\S)")
#: Marks the letters of a run whose words are unknown: any part of it may be one.
_RUN = "\0"
#: What makes a token worth decoding: a sign or separator beside or between letters, or three equal letters.
_SUSPECT = re.compile(rf"{_LETTER}[{_SIGN}.\-_*~]+{_LETTER}|[{_SIGN}]{_LETTER}|{_LETTER}[0-9@$]|({_LETTER})\1\1")
#: The part of a token that is decoded.
_CORE = re.compile(rf"(?:{_LETTER}|[{_SIGN}])(?:{_LETTER}|[{_SIGN}.\-_*~ ])*")
_STRETCHED = re.compile(r"(.)\1\1")


def trigrams_of(words: Counter) -> Counter:
    three: Counter = Counter()
    for word, n in words.items():
        s = f"^^{word}$"
        for i in range(2, len(s)):
            three[s[i - 2 : i + 1]] += n
    return three


def count_trigrams(docs: DataFrame, text_col: str = "text", letters: int = LETTERS) -> Counter:
    """Character trigrams of the words of all texts, counted in each partition and then summed. The most frequent letters have
    trigrams of their own, all others are OTHER: the sums that come to the driver are bounded by their number."""
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, three = Counter(), Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(three.keys()), pa.string()), pa.array(list(three.values()), pa.int64())], ["t", "n"])
            three.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(_WORDS.findall(text.lower()))
                if len(words) > MOST_WORDS:
                    three.update(trigrams_of(words))
                    words.clear()
                    if len(three) > MOST_TRIGRAMS:
                        yield passed_on()
        three.update(trigrams_of(words))
        yield passed_on()

    texts = docs.where(docs[text_col].isNotNull()).select(docs[text_col].alias("_text"))
    table = scratch.put(texts.mapInArrow(lean(run), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")))
    last = F.substring("t", 3, 1)
    own = [r.c for r in table.where(last != "$").groupBy(last.alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(letters).collect()]
    fold = f"[^^${''.join(map(re.escape, own))}]"
    frame = table.groupBy(F.regexp_replace("t", fold, OTHER).alias("t")).agg(F.sum("n").alias("n")).toPandas()
    scratch.keep()
    return Counter(dict(zip(frame["t"].tolist(), frame["n"].tolist(), strict=True)))


class CharModel:
    """Interpolated character trigrams over words; `^` and `$` mark ends."""

    def __init__(self, words: Counter | None = None, trigrams: Counter | None = None):
        three = trigrams_of(words) if trigrams is None else trigrams
        one, two, ctx1, ctx2 = Counter(), Counter(), Counter(), Counter()
        for t, n in three.items():
            one[t[2]] += n
            two[t[1:]] += n
            ctx1[t[1]] += n
            ctx2[t[:2]] += n
        self.one, self.two, self.three, self.ctx1, self.ctx2 = map(dict, (one, two, three, ctx1, ctx2))
        self.total, self.size = max(1, sum(one.values())), len(one) + 1
        self.known: dict[str, float] = {}

    def cost(self, context: str, char: str) -> float:
        key = context + char
        found = self.known.get(key)
        if found is None:
            a, b, c = (x if x in self.one or x in "^$" else OTHER for x in key)
            p1 = (self.one.get(c, 0) + 1) / (self.total + self.size)
            p2 = self.two.get(b + c, 0) / self.ctx1.get(b, math.inf)
            p3 = self.three.get(a + b + c, 0) / self.ctx2.get(a + b, math.inf)
            found = -math.log(0.05 * p1 + 0.25 * p2 + 0.7 * p3)
            if len(self.known) >= MOST_TRIGRAMS:
                self.known.clear()
            self.known[key] = found
        return found

    def decode(self, raw: str) -> tuple[str, float, int]:
        """The cheapest words behind a string of letters, signs and separators, by Viterbi over the last two letters;
        their cost under the character model, and over how many letters and ends. Linear in the string: a state holds
        (cost, cost of the letters alone, their number, path), a path its last letter and the path before it."""
        best: dict[str, tuple] = {"^^": (0.0, 0.0, 0, None)}
        stretched = {m.group(1) for m in _STRETCHED.finditer(raw)}
        before, run = "", 0
        for c in raw:
            run = run + 1 if c == before else 1
            options = [(c, 0.0)] if c not in LEET and c not in SEPARATORS else [(x, SIGN_COST) for x in LEET.get(c, "")]
            if c in SEPARATORS:
                options.append(("", GAP_COST))
            elif run > 2:
                options.append(("", REPEAT_COST))
            elif c == before and c in stretched:
                options.append(("", REPEAT_COST))
            reached: dict[str, tuple] = {}
            if c in SEPARATORS:
                # kept, as the end of a word: the next letter begins a new one
                state = min(best, key=lambda s: (best[s][0] + self.cost(s, "$"), s))
                spent, plain, n, path = best[state]
                end = self.cost(state, "$")
                reached["^^"] = (spent + end, plain + end, n + 1, (path, c))
            for state, (spent, plain, n, path) in best.items():
                for letter, cost in options:
                    model = self.cost(state, letter) if letter else 0.0
                    total = spent + cost + model
                    to = (state + letter)[-2:]
                    if to not in reached or total < reached[to][0]:
                        reached[to] = (total, plain + model, n + 1, (path, letter)) if letter else (total, plain, n, path)
            best, before = reached, c
        state = min(best, key=lambda s: (best[s][0] + self.cost(s, "$"), s))
        _, plain, n, path = best[state]
        out = []
        while path is not None:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)), plain + self.cost(state, "$"), n + 1


class Restorer:
    """Replaces obfuscated words of lower-case texts by what they stand for; remembers a bounded number of tokens."""

    def __init__(self, model: CharModel):
        self.model, self.seen = model, {}

    def restored(self, raw: str) -> str:
        """The string with its cores decoded, or as it is where the decoded letters are no words."""
        parts, at, spent, events = [], 0, 0.0, 0
        for found in _CORE.finditer(raw):
            core = found.group(0).rstrip("!|+$@.-_*~")
            if core:
                out, cost, n = self.model.decode(core)
                parts += [raw[at : found.start()], out]
                at, spent, events = found.start() + len(core), spent + cost, events + n
        return "".join(parts) + raw[at:] if spent <= WORST * events else raw

    def token(self, token: str) -> str:
        if not _SUSPECT.search(token):
            return token
        if token not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[token] = self.restored(token)
        return self.seen[token]

    def words(self, token: str) -> list[str]:
        """Words of a token as it stands, and of what it was restored to; of a run, its parts of each length a beginning has."""
        if token[:1] == _RUN:
            return [_RUN + token[i : i + n] for i in range(1, len(token) - PREFIXES[0] + 1) for n in PREFIXES if i + n <= len(token)]
        out = self.token(token)
        return _WORDS.findall(token) + (_WORDS.findall(out) if out != token else [])

    def run(self, raw: str) -> str:
        """Letters that stand apart, put together. The narrowest gaps lie between letters, and wider ones between words."""
        least = min(map(len, re.findall(" +", raw)))
        return " ".join(self.restored(re.sub(" +", " ", word)) for word in re.split(" {%d,}" % (least + 1), raw))

    def spaced(self, text: str) -> str:
        """A text with its runs put together. Only texts with single-letter tokens need the search."""
        return _SPACED.sub(lambda m: self.run(m.group(0)), text)

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text, with letters that stood apart put together; and those runs as a whole, as where
        their words end is the decoder's guess."""
        text = text.lower()
        found = set(text.split())
        if sum(len(t) == 1 for t in found) > 1:
            runs: list[str] = []

            def put(m) -> str:
                out = self.run(m.group(0))
                runs.append(_RUN + "".join(_WORDS.findall(out)))
                return out

            found = set(_SPACED.sub(put, text).split()).union(runs)
        return found

    def text(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(m.group(0)), self.spaced(text.lower()))


class Features:
    """Hashed features of a restored text: its words, and the beginnings of its words."""

    def __init__(self, most: int = 100_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, word: str) -> tuple[int, ...]:
        if word not in self.known:
            if len(self.known) > self.most:
                self.known.clear()
            if word[:1] == _RUN:
                keys = ["w" + word[1:], "p" + word[1:]]
            else:
                keys = ["w" + word] + [f"p{word[:n]}" for n in PREFIXES if len(word) >= n]
            self.known[word] = tuple(xxhash.xxh32_intdigest(k) >> (32 - BITS) for k in keys)
        return self.known[word]


class ToxicityModel:
    """Words and word beginnings that mark toxic training texts, weighed by logistic regression over their presence. The
    character model is that of all documents.

    x has a column for each of the chosen features, log_odds theirs; toxic is 1 for each toxic row, 0 for others.
    """

    def __init__(self, chars: CharModel, toxic: np.ndarray, chosen: list[int], log_odds: np.ndarray, x: np.ndarray):
        self.chars, y = chars, np.asarray(toxic, np.float64)
        prior = float((y.sum() + 1) / (len(y) + 2))
        self.weights: dict[int, float] = {}
        self.bias = math.log(prior / (1 - prior)) if y.sum() else -5.0
        if not y.sum() or y.sum() == len(y):
            self.bias = -5.0 if not y.sum() else 5.0
            return
        x = np.hstack([x, np.ones((len(y), 1))]).astype(np.float64)
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
        w[-1], penalty[-1] = self.bias, 1e-6
        # a word counts twice at least, as itself and by its beginning: each half of its log odds is where weights shrink to
        mean = np.append(log_odds / 2, 0.0)
        for _ in range(25):  # Newton steps, damped
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * (w - mean))
            w += step / max(1.0, np.abs(step).max() / 2)
        self.weights, self.bias = {int(f): float(v) for f, v in zip(chosen, w, strict=False)}, float(w[-1])

    def scorer(self):
        """A function from texts to scores, with tables of its own."""
        features, restorer, weights = Features(1), Restorer(self.chars), self.weights
        memory: dict[str, tuple[int, ...]] = {}

        def weigh(token: str) -> tuple[int, ...]:
            if len(memory) > 150_000:
                memory.clear()
            found = tuple(f for w in restorer.words(token) for f in features.of(w) if f in weights)
            memory[token] = found
            return found

        def score(text: str) -> float:
            found = set()
            for token in restorer.tokens(text):
                marks = memory.get(token)
                if marks is None:
                    marks = weigh(token)
                if marks:
                    found.update(marks)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, most_features: int = 400, least_toxic: int = 5, least_log_odds: float = 1.5, least_surprise: float = 6.0, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most max_train of them (by hash of the id).

    The character model is counted over all docs, labelled or not. The features of the labelled texts are made and counted by
    tasks. A feature is one of the model's if at least least_toxic toxic texts have it, its log odds are over least_log_odds,
    and the toxic texts that have it are more than expected by over least_surprise standard deviations; most_features of them
    stay, the most surprising ones. Only which of these each labelled text has comes to the driver.

    Rows with a null id or label are left out; of rows that repeat an id, that of the smallest hash of its text is taken. Where
    nothing toxic is labelled, every score is low.
    """
    scratch = Scratch(docs.sparkSession)
    rows = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_toxic"))
    rows = rows.where("_id is not null and _toxic is not null").where(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * max_train / max(1, total)))
    taken = rows.where(draw).limit(max_train)
    # at most max_train ids: small by that bound
    found = docs.select(docs[id_col].cast("long").alias("_doc"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).join(F.broadcast(taken), F.col("_doc") == F.col("_id"))
    one = Window.partitionBy("_doc").orderBy(F.xxhash64("_text"))
    found = found.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("_doc", "_toxic", "_text")
    chars = CharModel(trigrams=count_trigrams(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, restorer = Features(), Restorer(shared.value)
        for batch in batches:
            lists = [sorted({f for token in restorer.tokens(t) for w in restorer.words(token) for f in features.of(w)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["_doc", "_toxic", "_features"])

    listed = scratch.put(found.mapInArrow(lean(run), "_doc long, _toxic int, _features array<int>"))
    n, toxic = listed.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    counts = listed.select("_toxic", F.explode("_features").alias("f")).groupBy("f").agg(F.sum("_toxic").cast("double").alias("m"), F.count("*").cast("double").alias("all"))
    expected = F.col("all") * F.lit(toxic / max(1, n))
    odds = F.log((F.col("m") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("all") - F.col("m") + 0.5) / F.lit(n - toxic + 1.0))
    surprise = (F.col("m") - expected) / F.sqrt(expected * F.lit(1 - toxic / max(1, n)) + 1e-9)
    good = counts.where(F.col("m") >= least_toxic).select("f", odds.alias("odds"), surprise.alias("surprise")).where((F.col("odds") > least_log_odds) & (F.col("surprise") > least_surprise))
    best = sorted((r.f, r.odds) for r in good.orderBy(F.desc("surprise"), "f").limit(most_features).collect())
    chosen = [f for f, _ in best]
    frame = listed.select("_doc", "_toxic", F.array_intersect("_features", F.lit(chosen).cast("array<int>")).alias("has")).toPandas().sort_values("_doc")
    scratch.keep()
    x = np.zeros((len(frame), len(chosen)))
    for k, has in enumerate(frame["has"]):
        x[k, np.searchsorted(chosen, has)] = 1
    return ToxicityModel(chars, frame["_toxic"].to_numpy(), chosen, np.array([o for _, o in best]), x)


def toxicity(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, and held_out, score and predicted behind them. No shuffle.

    Labels, language, source and ids are no inputs of a score. A null text counts as empty and gets the score of a text
    without marks. held_out is false for a null id. Repeated rows are scored each; an empty table gives an empty result.
    Columns of docs that have a result's name are dropped for it.
    """
    ship(docs.sparkSession)
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(*[docs[c] for c in rest], held.alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("_toxicity_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            scores = [score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*rest, "held_out", "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["score double", "predicted int"])
    return rows.mapInArrow(lean(run), schema)
