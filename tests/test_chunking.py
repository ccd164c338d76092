import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.constants import HEADER
from tessera.operators import chunking as K

NOTE = "Chief Complaint:\nChest pain since Monday. It is worse at night.\n\nHistory\n" + "He felt well before that day. " * 12 + "\nPlan:\nRest. Fluids."


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def plain_fixed(text, size, overlap):
    """Windows in closed form: one at every multiple of the step that is not behind a window that reached the end."""
    n, step = len(text), max(size - overlap, 1)
    every = ((s, min(s + size, n), text[s : s + size].strip()) for s in range(0, n, step) if s == 0 or s + size - step < n)
    return [w for w in every if w[2]]


def plain_sections(text):
    """Sections as ranges of lines between those that are headers."""
    lines = re.split(r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text)
    cuts = [0] + [k for k, line in enumerate(lines) if k and re.match(HEADER, line.strip())] + [len(lines)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := "\n".join(lines[a:b]).strip())]


def units(section, most):
    """A short section is a unit; of a long one, each sentence is, behind a unit that ends what came before."""
    if len(section) <= most:
        return [("whole", section)]
    return [("break", "")] + [("part", x.strip()) for x in re.split(r"(?<=[.!?])\s+|\n+", section) if x.strip()]


def merged(todo, most, least, buf=""):
    """Chunks of the units to do, by what the first of them does to the buffer."""
    if not todo:
        return [buf] if buf.strip() else []
    (kind, text), rest = todo[0], todo[1:]
    if kind == "break":
        return ([buf] if buf else []) + merged(rest, most, least)
    too_much = len(buf) + len(text) > most
    if too_much and (kind == "whole" or len(buf) >= least):
        return [buf] + merged(rest, most, least, text.strip())
    return merged(rest, most, least, (buf + ("\n" if kind == "whole" else " ") + text).strip())


def plain_semantic(text, most, least):
    out = []
    for c in merged([u for s in plain_sections(text) for u in units(s, most)], most, least):
        at = out[-1][1] if out else 0
        start = max(text.find(c[:40], at), at)
        out.append((start, start + len(c), c))
    return out


TEXT = st.lists(st.sampled_from(["A word. ", "Plan:\n", "History\n", "\n", "no stop here ", "Yes! ", "é", " ", "Long " * 9 + ". ", "\t"]), max_size=25).map("".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, min_size=10, max_size=20), st.sampled_from([(20, 5), (10, 0), (7, 9)]), st.sampled_from([(60, 20), (30, 10)]))
def test_against_plain(spark, texts, windows, limits):
    rows = docs(spark, texts)
    fixed, semantic, tree = {}, {}, {}
    for r in K.chunk_fixed(rows, *windows).orderBy("doc_id", "idx").collect():
        fixed.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    for r in K.chunk_semantic(rows, *limits).orderBy("doc_id", "idx").collect():
        semantic.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    for r in K.chunk_hierarchical(rows, limits[0], 20, 5).orderBy("doc_id", "ord").collect():
        tree.setdefault(r.doc_id, []).append((r.chunk_id, r.text, r.parent_id))
    for k, t in enumerate(texts):
        assert fixed.get(k, []) == plain_fixed(t, *windows)
        assert semantic.get(k, []) == plain_semantic(t, *limits)
        want, n = [], 0
        for i, (_, _, parent) in enumerate(plain_semantic(t, limits[0], 200)):
            want.append((f"{k}#c{i}", parent, None))
            for _, _, child in plain_fixed(parent, 20, 5):
                want.append((f"{k}#hc{n}", child, f"{k}#c{i}"))
                n += 1
        assert tree.get(k, []) == want


def test_properties(spark):
    """Whatever the text: chunks in order, ids that count, children inside their parents, and work linear in a long text."""
    long = "Plan:\nRest a while. Then go on, please.\n" * 30_000
    rows = docs(spark, [NOTE, long])
    fixed = K.chunk_fixed(rows).where("doc_id = 1").orderBy("idx").collect()
    assert all(long[r.start : r.end].strip() == r.text and r.end - r.start <= 800 for r in fixed) and fixed[-1].end == len(long)
    assert [r.idx for r in fixed] == list(range(len(fixed))) and all(b.start - a.start == 680 for a, b in zip(fixed, fixed[1:], strict=False))
    merged_ = K.chunk_semantic(rows).orderBy("doc_id", "idx").collect()
    assert all(len(r.text) <= 1200 for r in merged_) and sum(r.doc_id == 1 for r in merged_) > 900
    assert [r.chunk_id for r in merged_ if r.doc_id == 0] == [f"0#c{k}" for k in range(sum(r.doc_id == 0 for r in merged_))]


def test_overlap_and_ids(spark):
    got = K.chunk_fixed(docs(spark, ["abcdefghij" * 100]), 100, 20).orderBy("idx").collect()
    assert len(got) > 5 and got[0].text[-20:] in got[1].text and all(r.chunk_id.startswith("0#c") for r in got)


def test_dispatch(spark):
    rows = docs(spark, [NOTE, "", None])
    for name in K.CHUNKERS:
        assert K.chunk_documents(rows, name).where("doc_id = 0").count() > 0
        assert K.chunk_documents(rows, name).where("doc_id > 0").count() == 0
    assert K.chunk_semantic(rows, 100).count() >= 2
    with pytest.raises(ValueError):
        K.chunk_documents(rows, "other")
