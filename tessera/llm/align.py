"""Alignment of two tokenizers' tokens: distinct segments are tokenised and aligned once, documents are composed of them."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, slices
from .pieces import MARK

#: The most frequent segments that are handed to the workers whole, and the longest that may be among them or in a worker's
#: table.
HEAD, LONGEST = 100_000, 64
#: Characters of segments that are encoded at once.
TOGETHER = 100_000
#: Characters of segments that a worker's count holds before it is passed on, and that its table of rare segments, whose
#: entries are larger, holds before it starts anew; and characters of texts that are split and composed at once.
HELD, TABLE, PART = 2_000_000, 1_000_000, 500_000


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, all others
    follow from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Alignments(NamedTuple):
    """Of each segment: tokens of A and B, groups, and the groups as text; if asked for, all links by the place of their segment."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    place: np.ndarray | None = None
    a: np.ndarray | None = None
    b: np.ndarray | None = None

    def pairs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets by segment, then A ids, B ids and numbers of the different pairs of each segment."""
        rows, counts = _different(self.place, self.a, self.b)
        return np.searchsorted(rows[0], np.arange(n + 1)), rows[1], rows[2], counts


def _different(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows in order, and how often each occurs."""
    by = np.lexsort(columns[::-1])
    sorted_ = [c[by] for c in columns]
    first = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)])
    at = np.nonzero(first)[0]
    return [c[at] for c in sorted_], np.diff(np.append(at, len(by)))


class Aligner:
    """Both tokenizers, the bytes of their tokens, and where texts may be split without a change of either's tokens.

    A (byte-level BPE) reads a blank and the text, B (SentencePiece) the text, before which it puts a blank itself. A run of
    white space may start a segment where both are proven, from their descriptions, to keep it apart from what comes before:

    * A parts texts by the usual pattern of byte-level tokenizers, none of whose alternatives has white space behind anything
      else and which looks ahead by a single character, over white space only. What counts as white space is asked of it.
    * No piece of B holds the run's first character behind another one: a blank behind no other character, any other
      white space in no longer piece at all.

    If that isn't proven, whole texts are the segments, and results are the same.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        spec, bytes_of = json.loads(self.a.to_str()), _alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or spec["model"].get("type") != "BPE":
            raise ValueError("the first tokenizer has to be byte-level BPE")
        self.a_bytes = {i: bytes(bytes_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in bytes_of for c in t)}
        proto = model.ModelProto()
        with open(b_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else b"" for p in proto.pieces]
        table = lambda rows: np.array([*rows, None], object)[:-1]
        self.a_bytes, self.b_bytes = table(self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)), table(self.b_bytes)
        self.a_size, self.b_size = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        names = [str(i) for t in (self.a_bytes, self.b_bytes) for i in range(len(t))]
        self.names, self.digits = np.stack([table(n + sign for n in names) for sign in (",", "|", ";", "")]), np.array([len(n) for n in names])
        self.blank = self.b.piece_to_id(MARK)
        apart = pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and not spec["model"].get("dropout")
        exact = train.model_type == 2 and train.byte_fallback and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix
        longer = [p.piece for p in proto.pieces if p.type == 1 and len(p.piece) > 1]
        crossing = any(MARK in p.lstrip(MARK) for p in longer) or any(p.type == 4 for p in proto.pieces)
        self.pattern = None
        if apart and exact and not crossing:
            parts = lambda s: len(self.a.pre_tokenizer.pre_tokenize_str(s))
            space = [c for c in map(chr, range(0x10000)) if c.isspace() and (c == " " or all(parts(c + x) == 2 for x in "!a1"))]
            inside = set("".join(longer))
            cls = lambda chars: "".join(map(re.escape, chars))
            self.space = set(space)
            every, never = cls(space), cls(c for c in space if c != " " and c in inside)
            more = f"(?:[{never}][{every}]*[^{every}]*)*" if never else ""
            self.pattern = re.compile(f"[{every}]*[^{every}]+{more}|[{every}]+")

    def split(self, text: str) -> list[str] | None:
        """The segments of a blank and the text, in order; None where the text has no tokens by definition: it is empty, or
        either tokenizer's bytes differ from it."""
        if not text:
            return None
        if self.pattern is None:
            try:
                self.align([" " + text], links=False)
            except ValueError:
                return None
            return [" " + text]
        # every other character is in a piece or falls back to its bytes
        return None if MARK in text else self.pattern.findall(" " + text)

    def _encoded(self, segments: list[str], together: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both, of all segments one after the other; A encodes the first `together` of them as one text."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        parts = ["".join(segments[:together])] * (together > 0) + segments[together:]
        first = [i for x in encode(parts, add_special_tokens=False) for i in x.ids]
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        second = [i for s, ids in zip(segments, found, strict=True) for i in ([self.blank] if s == " " else ids if s[0] == " " else ids[1:])]
        return np.array(first, np.int64), np.array(second, np.int64)

    def _texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each segment as text, from the group of each token and the last group of each segment."""
        ids, key = np.concatenate([a, b + len(self.a_bytes)]), np.concatenate([2 * group_a, 2 * group_b + 1])
        by = np.argsort(key, kind="stable")
        ids, key = ids[by], key[by]
        ends = np.append(key[1:] != key[:-1], True)
        # a comma, and at an end a bar behind A's, a semicolon behind B's, nothing behind the segment's last
        sign = np.where(ends, 1 + key % 2, 0)
        closing = np.nonzero(ends & (key % 2 == 1))[0][last]
        sign[closing] = 3
        every = "".join(self.names[sign, ids].tolist())
        at = np.cumsum(self.digits[ids] + (sign < 3))[closing].tolist()
        return [every[p:q] for p, q in pairwise([0, *at])]

    def align(self, segments: list[str], links: bool = True) -> Alignments:
        """Alignments of segments. A encodes them as one text, as nothing crosses their starts, but for those that end in white
        space or aren't proven; ValueError if the bytes differ."""
        joins = [self.pattern is not None and s[-1] not in self.space for s in segments]
        order = [k for k, j in enumerate(joins) if j] + [k for k, j in enumerate(joins) if not j]
        ordered = [segments[k] for k in order]
        raw = [s.encode() for s in ordered]
        a, b = self._encoded(ordered, sum(joins))
        whole = b"".join(raw)
        if b"".join(self.a_bytes[a].tolist()) != whole or b"".join(self.b_bytes[b].tolist()) != whole:
            raise ValueError("the bytes of the tokens differ from the text")
        mine, theirs, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum([len(x) for x in raw])
        common = mine[np.searchsorted(theirs, mine) < np.searchsorted(theirs, mine, "right")]
        of_a, of_b, of_groups = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (mine, theirs, common)]
        texts = self._texts(a, b, np.searchsorted(common, mine), np.searchsorted(common, theirs), np.cumsum(of_groups) - 1)
        back = np.argsort(order)
        out = Alignments(of_a[back], of_b[back], of_groups[back], [texts[k] for k in back.tolist()])
        if not links:
            return out
        # between two ends of either, one token of each is at work: a link
        places = np.sort(np.concatenate([mine, theirs]))
        places = places[np.append(places[1:] != places[:-1], True)]
        return out._replace(place=np.array(order)[np.searchsorted(ends, places)], a=a[np.searchsorted(mine, places)], b=b[np.searchsorted(theirs, places)])


@lru_cache(maxsize=2)
def _load(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _counted(paths: tuple[str, str]):
    """Segments and how often they occur, added up within a task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, counts, held = _load(*paths), Counter(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            segments = list(counts)
            for lo, hi in slices(segments, len, HELD):
                yield pa.RecordBatch.from_arrays([pa.array(segments[lo:hi], pa.string()), pa.array([counts[s] for s in segments[lo:hi]], pa.int64())], ["segment", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tool.split(text)
                if found:
                    before = len(counts)
                    counts.update(found)
                    held += sum(map(len, islice(reversed(counts), len(counts) - before)))  # new ones come last
                if held > HELD:
                    yield from flush()
                    counts, held = Counter(), 0
        yield from flush()

    return lean(run)


def _aligned(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _load(*paths)
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            for lo, hi in slices(segments, len, TOGETHER):
                found = tool.align(segments[lo:hi])
                offsets, *pairs = found.pairs(hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in pairs]
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in found[:3]], pa.array(found.groups, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "n", "n_a", "n_b", "n_groups", "groups", "a", "b", "m"])

    return lean(run)


def _composed(paths: tuple[str, str], head, full: bool):
    """Each document from its segments' alignments; those that aren't among the frequent ones are aligned where they stand,
    and listed with their numbers, so that their counts can be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known, held = _load(*paths), head.value, 0
        own: dict[str, tuple] = {}
        for batch in batches:
            whole = batch.column("_text").to_pylist()
            for lo, hi in slices(whole, lambda t: len(t or "") + 1, PART):
                texts = [tool.split(t) for t in whole[lo:hi]]
                counts = [Counter(t or ()) for t in texts]
                new = list({s for c in counts for s in c if s not in known and s not in own})
                here = {}
                for p, q in slices(new, len, TOGETHER):
                    x = tool.align(new[p:q], links=False)
                    here.update(zip(new[p:q], zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.groups, strict=True), strict=True))
                rows = []
                for segments, count in zip(texts, counts, strict=True):
                    figures, tail, groups = [0] * 6, [], []
                    for s, n in count.items():
                        x = known.get(s) or own.get(s) or here[s]
                        figures[0] += n * x[0]
                        figures[1] += n * x[1]
                        figures[2] += n * x[2]
                        if len(x) > 4:
                            figures[4] += n * x[4]
                            figures[5] += n * x[5]
                        else:
                            tail.append((s, n))
                    figures[3] = figures[0] + figures[1] - figures[2]  # every link but a group's last passes on to a next token
                    groups = ";".join([(known.get(s) or own.get(s) or here[s])[3] for s in segments]) if segments else ""
                    rows.append((*figures, hashlib.sha256(groups.encode()).hexdigest() if segments else "", [s for s, _ in tail], [n for _, n in tail], groups))
                short = {s: x for s, x in here.items() if len(s) <= LONGEST}
                size = sum(map(len, short))
                if held + size > TABLE:
                    own, held = {}, 0
                own |= short
                held += size
                kinds = [*[pa.int64()] * 6, pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "tail", "times", "groups"]
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), *columns[: 9 + full]], ["uid", "doc_id", *names[: 9 + full]])

    return lean(run)


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups if full).

    Byte offsets where tokens of both end cut a text into groups; tokens whose byte ranges overlap are linked. The count of an
    id pair is how many links of all documents hold it; a link is a best one if its pair's count is the highest of its B id.

    1. Texts are split into segments (see Aligner), which are counted within tasks and then by segment.
    2. Each distinct segment is tokenised and aligned once; pairs are counted over segments, times what they occur; each
       segment gets its own sums of counts and of best links by a join on pairs.
    3. Documents are composed of their segments' alignments. Those of the HEAD most frequent segments of at most LONGEST
       characters (a bound of the broadcast table) go to the workers whole; rarer ones are aligned anew by the task that
       meets them, and their sums are joined by segment and added to the document.

    Texts that are null or empty, or whose tokens' bytes differ from a blank and the text (those with a lower one eighth
    block, which stands for the blank), have no tokens: zeros and an empty groups_sha256. A null doc_id is kept; rows that
    repeat an id or a text are each counted and composed; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    standard = default_tokenizers() if a_path is None or b_path is None else ("", "")
    paths = (a_path or standard[0], b_path or standard[1])
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    counted = texts.select("_text").where("_text <> ''").mapInArrow(_counted(paths), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    known = scratch.put(counted.mapInArrow(_aligned(paths), "segment string, n long, n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>, m array<int>").withColumn("sid", F.monotonically_increasing_id()))
    links = known.select("sid", "n", F.explode(F.arrays_zip("a", "b", "m")).alias("x")).select("sid", "n", "x.a", "x.b", "x.m")
    pairs = scratch.put(links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("c")))
    most = pairs.groupBy("b").agg(F.max("c").alias("most"))
    pairs = scratch.put(pairs.join(most, "b").select("a", "b", "c", (F.col("c") == F.col("most")).cast("long").alias("best")))
    sums = links.join(pairs, ["a", "b"]).groupBy("sid").agg(F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("c")).alias("count_sum"))
    known = scratch.put(known.drop("a", "b", "m").join(sums, "sid"))

    columns = ["n_a", "n_b", "n_groups", "groups", "n_best", "count_sum"]
    # as many of the highest steps of a scale of counts as the table has room for
    step = F.floor(F.log2("n") * 16).cast("int")
    short = known.where(F.length("segment") <= LONGEST)
    room, least = HEAD, 1 << 16
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        room -= r.rows
        if room < 0:
            break
        least = r.step
    frequent = short.where(step >= least).select("segment", *columns).toArrow()
    head = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), zip(*[c.to_pylist() for c in frequent.columns[1:]], strict=True), strict=True)))
    figures = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    composed = scratch.put(texts.mapInArrow(_composed(paths, head, full), f"uid long, doc_id {kind}, {figures}, tail array<string>, times array<long>" + ", groups string" * full))
    rare = composed.select(F.col("uid").alias("of"), F.explode(F.arrays_zip("tail", "times")).alias("x")).select("of", F.col("x.tail").alias("segment"), "x.times")
    rare = rare.join(known.select("segment", F.col("n_best").alias("best"), F.col("count_sum").alias("sum")), "segment")
    rare = scratch.put(rare.groupBy("of").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("sum")).alias("more_sum")))
    scratch.keep(composed, rare)
    out = composed.join(rare, F.col("uid") == F.col("of"), "left")
    added = {c: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return out.select("doc_id", *[added.get(c, F.col(c)) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")], *["groups"] * full)
