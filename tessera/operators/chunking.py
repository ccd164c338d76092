"""Chunkers: documents (doc_id, text, and any others) to chunks. No shuffle: a document's chunks are made inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import CUT, empty, exploded, fold, let, piece, text_blocks
from ..functions.constants import HEADER
from ..functions.text import sentences_and_lines, strip, trimmed

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_PIECE = "struct<start:int,end:int,text:string>"


def windows(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Array of (start, end, text): windows of `size` characters every size - overlap, up to the one that reaches the end;
    text is stripped, start and end are not; blank ones are left out."""
    step = max(size - overlap, 1)

    def cut(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((x["n"] + (step - size - 1)) / step).cast("int") * step)
        one = lambda s: F.struct(s.alias("start"), F.least(s + size, x["n"]).alias("end"), trimmed(piece(x["b"], s, F.least(s + size, x["n"]))).alias("text"))
        return F.when(x["n"] > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), one)).otherwise(empty(_PIECE))

    made = let(F.struct(text_blocks(text).alias("b"), F.length(text).alias("n")), cut)
    return F.filter(made, lambda x: x["text"] != "")


def sections(text: Column) -> Column:
    """Stripped, non-empty sections; a header line begins a new one. Lines hold no carriage return, which so marks the
    beginnings of sections while lines are joined again."""
    lines = F.transform(F.split(text, _LINE_END, -1), lambda line, i: F.when((i > 0) & strip(line).rlike(HEADER), F.concat(F.lit("\r"), line)).otherwise(line))
    whole = F.transform(F.split(F.array_join(lines, "\n"), "\n\r", -1), strip)
    return F.filter(whole, lambda s: s != "")


def merged_sections(text: Column, max_chars: int = 1200, min_chars: int = 200) -> Column:
    """Array of texts: short sections put together, long ones taken sentence by sentence.

    Units are folded into a buffer. A section joins it by a line break if both fit into max_chars, and otherwise starts
    it anew. A long section empties the buffer; each of its sentences joins by a blank, unless that would exceed max_chars
    and the buffer has min_chars. Sentences are never cut.
    """
    unit = lambda t, kind: F.struct(t.alias("t"), F.lit(kind).alias("k"))
    pieces = F.flatten(F.transform(sections(text), lambda s: F.when(F.length(s) > max_chars, F.concat(F.array(unit(F.lit(""), 0)), F.transform(sentences_and_lines(s), lambda x: unit(x, 1)))).otherwise(F.array(unit(s, 2)))))

    def step(buf: Column, x: Column) -> tuple[Column, Column]:
        t = x["t"]
        fits = F.length(buf) + F.length(t) <= max_chars
        flush = F.when(x["k"] == 0, buf != "").when(x["k"] == 1, ~fits & (F.length(buf) >= min_chars)).otherwise(~fits)
        joiner = F.when(x["k"] == 1, F.lit(" ")).otherwise(F.lit("\n"))
        # units and buffer are stripped already
        after = F.when((x["k"] == 0) | flush | (buf == ""), t).otherwise(F.concat(buf, joiner, t))
        return after, F.when(flush, F.array(buf)).otherwise(empty("string"))

    return fold(pieces, F.lit(""), step, "string", lambda buf: F.when(buf != "", F.array(buf)).otherwise(empty("string")))


def located(text: Column, chunks: Column) -> Column:
    """Array of (start, end, text): each chunk where its first 40 characters occur behind the one before, or right there. They
    are looked for close by first, and in the rest of the text only where they aren't there."""

    def places(x: Column) -> Column:
        def step(at: Column, c: Column) -> tuple[Column, Column]:
            head = F.substring(c, 1, 40)
            near = F.position(head, piece(x["b"], at, F.least(x["n"], at + F.length(c) + CUT)))

            def place(found: Column) -> Column:
                start = F.when(found > 0, at + found - 1).otherwise(at).cast("int")
                return F.struct(start.alias("start"), (start + F.length(c)).cast("int").alias("end"), c.alias("text"))

            anywhere = lambda found: F.when(found > 0, found).otherwise(F.position(head, text, at + 1) - at)
            placed = let(let(near, anywhere), place)
            return placed["end"], F.array(placed)

        return fold(x["c"], F.lit(0), step, _PIECE)

    return let(F.struct(text_blocks(text).alias("b"), F.length(text).alias("n"), chunks.alias("c")), places)


def _own(docs: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    return ["doc_id", *["doc_ord"] * ("doc_ord" in docs.columns), *keep]


def _exploded(docs: DataFrame, pieces: Column, label: str, strategy: str, keep: tuple[str, ...]) -> DataFrame:
    rows = exploded(docs, _own(docs, keep), pieces, "p", "idx")
    return rows.select(
        *_own(docs, keep),
        "idx",
        F.concat(F.col("doc_id").cast("string"), F.lit(f"#{label}"), F.col("idx").cast("string")).alias("chunk_id"),
        F.col("p.text").alias("text"),
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
        F.lit(strategy).alias("strategy"),
    )


def chunk_fixed(docs: DataFrame, size: int = 800, overlap: int = 120, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of sliding windows: doc_id, idx, chunk_id, text, start, end, strategy. keep: columns of the documents that their
    chunks carry on."""
    return _exploded(docs, windows(F.coalesce("text", F.lit("")), size, overlap), "c", "fixed", keep)


def chunk_semantic(docs: DataFrame, max_chars: int = 1200, min_chars: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of merged sections, in the same columns; start and end are approximate, as white space is rewritten."""
    text = F.coalesce("text", F.lit(""))
    return _exploded(docs, located(text, merged_sections(text, max_chars, min_chars)), "c", "semantic", keep)


def chunk_hierarchical(docs: DataFrame, parent_max: int = 1500, child_size: int = 400, child_overlap: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parents of merged sections, each followed by its children, windows over the parent's text.

    Columns as above, and ord (place within the document), level, parent_id, parent_text (500 characters), owner_id (the
    document of a parent; the parent's id and `:ch` for a child). Children are numbered over the document; their offsets
    count from their parent's text.
    """
    text = F.coalesce("text", F.lit(""))
    parents = located(text, merged_sections(text, parent_max))
    nested = F.transform(parents, lambda p, i: F.struct(i.alias("i"), p.alias("p"), windows(p["text"], child_size, child_overlap).alias("kids")))

    def number(n: Column, x: Column) -> tuple[Column, Column]:
        item = lambda level, idx, piece: F.struct(F.lit(level).alias("level"), x["i"].alias("parent"), idx.cast("int").alias("idx"), piece.alias("piece"), x["p"]["text"].alias("parent_text"))
        kids = F.transform(x["kids"], lambda k, j: item("child", n + j, k))
        return n + F.size(x["kids"]), F.concat(F.array(item("parent", x["i"], x["p"])), kids)

    every = fold(nested, F.lit(0), number, f"struct<level:string,parent:int,idx:int,piece:{_PIECE},parent_text:string>")
    rows = exploded(docs, _own(docs, keep), every, "x", "ord")
    doc = F.col("doc_id").cast("string")
    parent_id = F.concat(doc, F.lit("#c"), F.col("x.parent").cast("string"))
    child = F.col("x.level") == "child"
    return rows.select(
        *_own(docs, keep),
        "ord",
        F.when(child, F.concat(doc, F.lit("#hc"), F.col("x.idx").cast("string"))).otherwise(parent_id).alias("chunk_id"),
        F.col("x.piece.text").alias("text"),
        F.col("x.piece.start").alias("start"),
        F.col("x.piece.end").alias("end"),
        F.when(child, F.lit("hierarchical")).otherwise(F.lit("semantic")).alias("strategy"),
        F.col("x.level").alias("level"),
        F.when(child, parent_id).alias("parent_id"),
        F.when(child, F.substring("x.parent_text", 1, 500)).alias("parent_text"),
        F.when(child, F.concat(parent_id, F.lit(":ch"))).otherwise(doc).alias("owner_id"),
    )


CHUNKERS = {"fixed": chunk_fixed, "semantic": chunk_semantic, "hierarchical": chunk_hierarchical}


def chunk_documents(docs: DataFrame, strategy: str = "semantic", **options) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"Unknown chunking strategy: {strategy}")
    return CHUNKERS[strategy](docs, **options)
