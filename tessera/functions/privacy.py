"""Column functions over texts with personal data: spans, redaction, restoring, seals and leaks. All stay inside a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import empty, fold, let, piece, running_sums, text_blocks
from .constants import NAME_PATTERNS, NOT_NAMES, PII_PATTERNS, PII_THRESHOLD, PII_TYPES
from .text import words_array

_SPAN = "struct<start:int,neg_length:int,neg_confidence:double,ord:int,entity_type:string,text:string,detector:string>"


def _matches(text: Column, pattern: str, entity: str, confidence: float, order: int, group: int, detector: str) -> Column:
    """Spans of a pattern. The lengths of the gaps between matches, and of the matches, add up to offsets; the group, if
    any, ends its match. A text without a match is searched once."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def spans(found: Column) -> Column:
        lengths = F.transform(F.slice(found["g"], F.lit(1), F.size(found["w"])), lambda g, i: F.length(g) + F.length(F.get(found["w"], i)))
        return F.zip_with(running_sums(lengths), found["i"], span)

    def span(end: Column, x: Column) -> Column:
        return F.struct(
            (end - F.length(x)).cast("int").alias("start"),
            (-F.length(x)).cast("int").alias("neg_length"),
            F.lit(-confidence).alias("neg_confidence"),
            F.lit(order).alias("ord"),
            F.lit(entity).alias("entity_type"),
            x.alias("text"),
            F.lit(detector).alias("detector"),
        )

    found = F.struct(F.split(text, pattern, -1).alias("g"), whole.alias("w"), inner.alias("i"))
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(empty(_SPAN))


def pii_spans(text: Column, enabled: Sequence[str] = PII_TYPES, thresholds: Mapping[str, float] | None = None, default: float = PII_THRESHOLD) -> Column:
    """Array of (start, end, entity_type, text, confidence, detector), by start, without overlaps.

    Patterns whose type isn't enabled or whose confidence is under the type's threshold are never run. Where spans
    overlap, the first by (start, longer, surer) stays, unless a later one is strictly surer.
    """
    limit = dict(thresholds or {})
    passes = lambda kind, c: kind in enabled and c >= limit.get(kind, default)
    found = [_matches(text, p, kind, c, k, 0, "regex") for k, (kind, p, c) in enumerate(PII_PATTERNS) if passes(kind, c)]
    for k, (p, c) in enumerate(NAME_PATTERNS):
        if passes("PERSON", c):
            names = _matches(text, p, "PERSON", c, len(PII_PATTERNS) + k, 1, "heuristic-ner")
            found.append(F.filter(names, lambda x: ~F.arrays_overlap(F.split(x["text"], r"\s+"), words_array(NOT_NAMES))))
    if not found:
        every = empty(_SPAN)
    else:
        every = F.array_sort(F.concat(*found))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        clear = last["text"].isNull() | (x["start"] >= last["start"] - last["neg_length"])
        surer = x["neg_confidence"] < last["neg_confidence"]
        done = clear & last["text"].isNotNull()
        return F.when(clear | surer, x).otherwise(last), F.when(done, F.array(last)).otherwise(empty(_SPAN))

    none = F.expr(f"cast(null as {_SPAN})")
    none = F.struct(*[none[c.split(":")[0]].alias(c.split(":")[0]) for c in _SPAN[7:-1].split(",")])
    kept = fold(every, none, step, _SPAN, lambda last: F.when(last["text"].isNotNull(), F.array(last)).otherwise(empty(_SPAN)))
    shape = lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["neg_length"]).alias("end"), x["entity_type"].alias("entity_type"), x["text"].alias("text"), (-x["neg_confidence"]).alias("confidence"), x["detector"].alias("detector"))
    return F.transform(kept, shape)


def placeholders(spans: Column) -> Column:
    """The placeholder of each span. Numbers of a type count from the right, for every span; equal texts share the
    placeholder of their last occurrence, whatever its type."""
    # spans sorted by type from the right, so that numbers run within a type; then by text from the right, so that the first
    # of a text leads the others; then back in order
    numbered = "struct<text:string,neg:int,name:string>"
    by_type = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["entity_type"].alias("t"), (-i).alias("neg"), x["text"].alias("text"))))

    def number(s: Column, x: Column) -> tuple[Column, Column]:
        n = F.when(s["t"] == x["t"], s["n"] + 1).otherwise(F.lit(1))
        name = F.concat(F.lit("["), x["t"], F.lit("_"), n.cast("string"), F.lit("]"))
        return F.struct(x["t"].alias("t"), n.alias("n")), F.array(F.struct(x["text"].alias("text"), x["neg"].alias("neg"), name.alias("name")))

    def lead(s: Column, x: Column) -> tuple[Column, Column]:
        name = F.when(s["text"] == x["text"], s["name"]).otherwise(x["name"])
        return F.struct(x["text"].alias("text"), name.alias("name")), F.array(F.struct((-x["neg"]).alias("i"), name.alias("name")))

    null = F.lit(None).cast("string")
    named = fold(by_type, F.struct(null.alias("t"), F.lit(0).alias("n")), number, numbered)
    led = fold(F.array_sort(named), F.struct(null.alias("text"), null.alias("name")), lead, "struct<i:int,name:string>")
    return F.transform(F.array_sort(led), lambda x: x["name"])


def redact(text: Column, spans: Column, names: Column) -> Column:
    """The text with each span replaced by its placeholder."""

    def cut(x: Column) -> Column:
        gap = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["s"], i - 1)["end"])
        marked = F.transform(x["s"], lambda s, i: F.concat(piece(x["b"], gap(i), s["start"]), F.get(x["n"], i)))
        return F.concat(F.array_join(marked, ""), piece(x["b"], F.element_at(x["s"], -1)["end"], x["l"]))

    parts = F.struct(text_blocks(text).alias("b"), spans.alias("s"), names.alias("n"), F.length(text).alias("l"))
    return F.when(F.size(spans) > 0, let(parts, cut)).otherwise(text)


def redaction_entries(spans: Column, names: Column) -> Column:
    """Array of (placeholder, original), in the order in which placeholders were made: from the right."""
    pairs = F.reverse(F.zip_with(names, spans, lambda n, s: F.struct(n.alias("placeholder"), s["text"].alias("original"))))
    return F.array_distinct(pairs)


def restore(text: Column, entries: Column) -> Column:
    """The text with each placeholder replaced by its original, in the map's order."""
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["placeholder"], e["original"]))


def seal(entries: Column, salt: Column) -> Column:
    """sha256 of the salt and the entries sorted by placeholder."""
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(e["placeholder"], F.lit("="), e["original"]))
    return F.sha2(F.concat(salt, F.lit(":"), F.array_join(lines, "|")), 256)


def leaked_types(answer: Column, entries: Column) -> Column:
    """Types whose originals of four characters and more stand in the answer, in the map's order."""
    found = F.filter(entries, lambda e: (F.length(e["original"]) >= 4) & F.contains(answer, e["original"]))
    return F.array_distinct(F.transform(found, lambda e: F.regexp_extract(e["placeholder"], r"^\[(.*)_", 1)))


def leak_count(answer: Column, entries: Column) -> Column:
    return F.size(F.filter(entries, lambda e: (F.length(e["original"]) >= 4) & F.contains(answer, e["original"])))


def type_counts(spans: Column) -> Column:
    """Map of type to number of spans."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(spans, lambda s: s["entity_type"] == k)))))
