"""op12 against whole texts in both libraries, with offsets and links by their definitions."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tessera.llm import align

PATHS = align.default_tokenizers()


@pytest.fixture(scope="session")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def decoder():
    """The byte of each letter of the byte-level alphabet, asked of the library."""
    letters = {}
    for c in map(chr, range(0x800)):
        shown = "".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c))
        letters.update(zip(shown, c.encode(), strict=True))
    for b in range(0xE0, 0xF5):
        c = bytes([b, 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80, 0x80, 0x80][: 3 if b < 0xF0 else 4]).decode("utf-8", "ignore")
        if c:
            letters.update(zip("".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)), c.encode(), strict=True))
    return letters


def tokens(libraries, text):
    first, second = libraries
    whole = (" " + text).encode()
    letters = decoder() if not hasattr(tokens, "letters") else tokens.letters
    tokens.letters = letters
    a = first.encode(" " + text, add_special_tokens=False)
    b = second.encode(text)
    mine = [bytes(letters[c] for c in t) for t in a.tokens]
    pieces = [second.id_to_piece(i) for i in b]
    theirs = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    if not text or b"".join(mine) != whole or b"".join(theirs) != whole:
        return None

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    return list(zip(a.ids, ranges(mine), strict=True)), list(zip(b, ranges(theirs), strict=True))


def plain(libraries, rows):
    found = [(i, tokens(libraries, t) if t else None) for i, t in rows]
    linked = [[(a, b) for a, (s, e) in x[0] for b, (u, v) in near(x[1], s, e)] if x else [] for _, x in found]
    counts = Counter(p for links in linked for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, x), links in zip(found, linked, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, (_, e) in x[0]} & {e for _, (_, e) in x[1]})
        groups, at, p, q = [], 0, 0, 0
        for cut in cuts:
            n, m = p, q
            while p < len(x[0]) and x[0][p][1][1] <= cut:
                p += 1
            while q < len(x[1]) and x[1][q][1][1] <= cut:
                q += 1
            groups.append(",".join(str(t) for t, _ in x[0][n:p]) + "|" + ",".join(str(t) for t, _ in x[1][m:q]))
        out.append((i, len(x[0]), len(x[1]), len(cuts), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def near(others, s, e):
    lo, hi = 0, len(others)
    while lo < hi:
        mid = (lo + hi) // 2
        if others[mid][1][1] <= s:
            lo = mid + 1
        else:
            hi = mid
    while lo < len(others) and others[lo][1][0] < e:
        yield others[lo]
        lo += 1


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  ", "\n", "\n\n a\n", "a\r\nb\r\n  c;\r\nd", "\ta\t\tb ", " a  b ", "x y  z　w", "a\x1c b\x85c\x1f", "a▁b", "▁", "<|endoftext|> <s>x</s> <unk> <0x41>", "naïve café 😀😀 ‍👩‍👩‍👧 日本語の文字列 текст", "don't we'll 'tis I'm  o'clock", "1234567 12.5% --- !!! ... ;;;\r", "a\x00b", "A" * 5_000, " " * 3_000 + "x", "word " * 4_000, "﻿bom ​zero"]


@pytest.mark.parametrize("sizes", [{}, {"HEAD": 3, "LONGEST": 6, "HELD": 60, "TOGETHER": 50}])
def test_align(table, libraries, sizes, monkeypatch):
    for name, size in sizes.items():
        monkeypatch.setattr(align, name, size)
    rng = random.Random(5)
    signs = ["the", " ", "  ", "\n", "\r", "\t", "é", "'s", "ing", "12", ".", "un", "token", " ", "字", ";", "{"]
    rows = list(enumerate(ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(150)]))
    rows += [(3, "the same id"), (3, "the same id"), (None, "no id")]
    got = align.align_tokenizers(table(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain(libraries, rows)
    for r in got:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")


def test_align_empty(table):
    assert align.align_tokenizers(table([], "doc_id long, text string")).count() == 0
    assert [r.n_a for r in align.align_tokenizers(table([(1, None)], "doc_id long, text string")).collect()] == [0]


def test_segments_are_apart(libraries):
    """Tokens of a text are those of its segments, one after the other; without a proof the whole text is the segment."""
    tool = align.Aligner(*PATHS)
    assert tool.pattern is not None
    for text in ODD:
        found = tool.split(text or "")
        if found:
            assert "".join(found) == " " + text
            parts, apart = tool.align(found), [tool.align([s]) for s in found]
            assert parts.groups == [x.groups[0] for x in apart] and parts.n_a.tolist() == [x.n_a[0] for x in apart]
            plain = align.Aligner(*PATHS)
            plain.pattern = None
            whole = plain.align([" " + text])
            assert parts.n_b.sum() == whole.n_b[0] and ";".join(parts.groups) == whole.groups[0]
            assert sorted(zip(parts.a, parts.b, strict=True)) == sorted(zip(whole.a, whole.b, strict=True))
    tool.pattern = None
    assert tool.split("a b") == [" a b"] and tool.split("a▁b") is None


def test_op12(spark, sf, libraries):
    from tessera.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op12_token_alignment"](spark, sf)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(libraries, rows)


def test_a_worker_holds_few_segments():
    """What composing holds of texts full of rare segments is bounded, within a batch and over batches."""
    import tracemalloc
    from types import SimpleNamespace

    run = align._composed(align.default_tokenizers(), SimpleNamespace(value={}), False)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(range(20)), pa.array([" ".join(f"q{b * 10**6 + k * 10**4 + j:x}" for j in range(6_000)) for k in range(20)])], ["uid", "doc_id", "_text"]) for b in range(3)]
    next(run(iter([b.slice(0, 1) for b in batches[:1]])))  # loads the tokenizers
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60 and peak < 90e6
