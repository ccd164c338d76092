"""Quality rules: base counts, and repetition measured by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from .common import lean, slices

#: Fixed characters of the base rules: ASCII white space, symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
#: Words of a common prefix that are compared for all positions at once.
STEP = 4
#: The method's limits: repeats of this many words and more count as covered; a text fails if they cover more than this
#: share of its words, or if a single repeat has more than this share of its words (and more words than the floor).
LEAST_REPEAT, MOST_COVERED, MOST_LONGEST, LONGEST_FLOOR = 10, 0.30, 0.25, 25


def suffix_ranks(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of every suffix of several texts at once.

    words: word numbers of all texts, one text after another; starts: where each begins. Suffixes end with their text and
    sort by text first. Ranks are places of the first equal prefix, so those that are unique already are sorted no more:
    after a few doublings only true repeats remain.
    """
    n = len(words)
    text = np.zeros(n, np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    ends = np.append(starts[1:], n)[text]
    key = text * (int(words.max()) + 1) + words
    rank = np.empty(n, np.int64)
    todo = np.arange(n)

    def place(todo: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give the positions their new ranks, within groups that share a base rank; return those that still tie."""
        order = np.argsort(key, kind="stable")
        key, todo, base = key[order], todo[order], base[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.ones(len(key), bool)
        group[1:] = base[1:] != base[:-1]
        at = np.arange(len(key))
        lead = np.maximum.accumulate(np.where(first, at, 0))
        rank[todo] = base + lead - np.maximum.accumulate(np.where(group, at, 0))
        alone = first & np.append(first[1:], True)
        return todo[~alone]

    todo = place(todo, key, np.zeros(n, np.int64))
    h = 1
    while len(todo):
        ahead = todo + h
        second = np.where(ahead < ends[todo], rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = rank[todo]
        todo = place(todo, base * (n + 1) + second, base)
        h *= 2
    return rank


def longest_repeats(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest substring from there on that its text has elsewhere too: the larger of
    the common prefixes with both neighbours in the suffix array.

    Common prefixes below STEP are found for all positions at once; the longer ones by a walk in the order of the text, in
    which each is at least one less than the one before it. Memory is a few numbers a word, whatever repeats.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(suffix_ranks(words, starts))
    # every text ends in a mark of its own, so that no prefix crosses an end
    ends = np.append(starts[1:], n)
    place = np.arange(n) + np.repeat(np.arange(len(starts)), ends - starts)
    marked = np.empty(n + len(starts), np.int64)
    marked[place] = words
    marked[ends + np.arange(len(starts))] = -1 - np.arange(len(starts))
    before = np.empty(n, np.int64)  # the suffix that sorts just before
    before[order[1:]], before[order[0]] = order[:-1], order[0]
    i, j = place, place[before]
    common, alike = np.zeros(n, np.int64), i != j
    for k in range(STEP):
        alike &= marked[np.minimum(i + k, len(marked) - 1)] == marked[np.minimum(j + k, len(marked) - 1)]
        common += alike
    at = np.nonzero(alike)[0]
    if len(at):
        w, reached, last, h = marked.tolist(), [], -2, 0
        for p, s, t in zip(at.tolist(), i[at].tolist(), j[at].tolist(), strict=True):
            h = max(STEP, h - 1) if p == last + 1 else STEP
            while w[s + h] == w[t + h]:
                h += 1
            reached.append(h)
            last = p
        common[at] = reached
    out = common.copy()
    np.maximum.at(out, before, common)
    return out


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the spans [at, at + length)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[str]) -> dict[str, list]:
    """The figures of several texts; see quality_rules."""
    split = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
    numbers: dict[bytes, int] = {}
    counts = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64, int(counts.sum()))
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    repeat = longest_repeats(words, starts)
    total = lambda marks: _per_text(marks.astype(np.int64), np.add, starts, some)
    again = np.nonzero(repeat >= WINDOW)[0]
    n_repeat = total(covered(again, np.full(len(again), WINDOW), len(words)))
    long = np.nonzero(repeat >= LEAST_REPEAT)[0]
    inside = covered(long, repeat[long], len(words))
    n_covered, longest = total(inside), _per_text(repeat, np.maximum, starts, some)
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    lo, hi = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    begin = np.cumsum(counts) - counts
    owner = np.searchsorted(begin, lo, side="right") - 1
    last = np.searchsorted(begin, hi - 1, side="right") - 1
    for a, b, s, t in zip(owner.tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for k in range(a, b + 1):  # a run may go on into the next text
            spans[k].append((max(s, int(begin[k])) - int(begin[k]), min(t, int(begin[k] + counts[k])) - int(begin[k])))
    out: dict[str, list] = {"n_words": counts.tolist(), "word_chars": [], "n_symbols": [], "n_dup_lines": [], "n_repeat_words": n_repeat.tolist(), "longest_repeat": longest.tolist(), "covered_words": n_covered.tolist(), "repeats": [[x for x in s if x[1] > x[0]] for s in spans]}
    for t in texts:
        out["word_chars"].append(len(t) - sum(map(t.count, SPACE)))
        out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    n = counts
    base = (n < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED_PERCENT * n)
    fails = (n_covered > MOST_COVERED * n) | ((longest > MOST_LONGEST * n) & (longest > LONGEST_FLOOR))
    out["base_failed"], out["kept"] = base.tolist(), (~base & ~fails).tolist()
    return out


def _per_text(values: np.ndarray, reduce, starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros(len(some), np.int64)
    if len(starts):
        out[some] = reduce.reduceat(values, starts)
    return out


#: A name for the text that no column of documents is likely to have; it is taken by place, so a clash does no harm.
_TEXT = "_quality_text"
_FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("longest_repeat", "long"), ("covered_words", "long"), ("repeats", "array<struct<start:int,end:int>>"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    longest_repeat, covered_words, repeats (merged spans in words) behind them. No shuffle.

    Words are runs of anything but ASCII white space. n_repeat_words are the words in 5-word windows that the text has
    twice or more. kept is false if base_failed, or if repeats of 10 words and more cover over 30 % of the words, or a
    single repeat has over 25 % of the words and over 25 words.

    A null text has no words and so fails. Null ids are kept, repeated rows are judged each, an empty table gives an
    empty result. Columns of docs that have a result's name are dropped for it.
    """
    ship(docs.sparkSession)
    names = [n for n, _ in _FIELDS]
    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(*[docs[c] for c in rest], F.coalesce(docs[text_col], F.lit("")).alias(_TEXT))
    kinds = [pa.bool_() if k == "boolean" else pa.int64() for _, k in _FIELDS[:-1]] + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in slices(texts, lambda t: len(t) + 1, 1_500_000):
                got = measure(texts[lo:hi])
                got["repeats"] = [[{"start": s, "end": e} for s, e in x] for x in got["repeats"]]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(got[n], k) for n, k in zip(names, kinds, strict=True)]], [*rest, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{n} {k}" for n, k in _FIELDS])
    return rows.mapInArrow(lean(run), schema)
