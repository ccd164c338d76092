"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from .common import lean, slices

#: Characters of a chunk and of an overlap; longer texts are huge ones.
CHUNK = 8_192
OVERLAP = 512
#: Tokens behind a common boundary that must be the same in both encodings.
AGREE = 8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed parts of a tokenizer's description that squeeze white space and then leave it out of every piece.
_SQUEEZE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
_NO_SPACE = "[^\\s\\p{L}\\p{N}]+"


def _steps(spec: dict | None) -> list[dict]:
    if not spec:
        return []
    return spec.get("normalizers") or spec.get("pretokenizers") or [spec]


#: Characters that composition leaves as they are, whose lower case depends on no neighbour, and whose kind no edition of
#: Unicode has changed: Latin, Cyrillic, punctuation. Texts with any other go through the library as they are.
_KNOWN = [c for lo, hi in ((0x0, 0x130), (0x131, 0x180), (0x400, 0x460), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD)) for c in range(lo, hi)]
_SPACES = " \t\n\x0b\x0c\r\x85\xa0"
#: Words up to this long stay in a worker's table of so many, which starts anew when full.
WORD = 64
TABLE = 300_000


def _of(kind: str) -> str:
    """The known characters of a kind, for use inside a class of a pattern."""
    return "".join(re.escape(chr(c)) for c in _KNOWN if unicodedata.category(chr(c))[0] == kind)


class Tokens:
    """A tokenizer, and a quicker way to the same counts where its description proves it.

    `lean` squeezes no white space: the pre-tokenizer drops it anyway, as no alternative of its pattern takes any. `bare`
    normalises nothing, and counts single words: words don't reach across what the pre-tokenizer's pattern parts, so the
    count of a text of known characters is the sum over its words, and each distinct word is encoded once. Special strings
    are found before all that, on the raw text; texts that may hold one in another case go to `lean`.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = self.lean = Tokenizer.from_file(path)
        self.bare, self.special, self.table = None, (), {}
        spec = json.loads(self.whole.to_str())
        steps, pre = _steps(spec.get("normalizer")), _steps(spec.get("pre_tokenizer"))
        first = (pre or [{}])[0]
        kinds = [x["type"] for x in steps]
        pattern = str(first.get("pattern", {}).get("Regex", ""))
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and pattern.endswith("|" + _NO_SPACE)
        parts = pattern.removesuffix("|" + _NO_SPACE).split("|")
        # every other alternative is a contraction, letters or digits
        plain = drops and all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?", x) for x in parts)
        apart = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in pre[1:]] == [("ByteLevel", False, False)] and not spec.get("post_processor") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        raw = all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
        if plain and raw and kinds == ["NFC", "Replace", "Lowercase"] and steps[1] == _SQUEEZE:
            spec["normalizer"] = {"type": "Sequence", "normalizers": [steps[0], steps[2]]}
            self.lean = Tokenizer.from_str(json.dumps(spec))
            if apart:
                spec["normalizer"] = None
                self.bare = Tokenizer.from_str(json.dumps(spec))
                letters, numbers = _of("L"), _of("N")
                known = [x.replace(r"\p{L}", letters).replace(r"\p{N}", numbers) for x in parts]
                self.words = re.compile("|".join([*known, f"[^{re.escape(_SPACES)}{letters}{numbers}]+"])).findall
                self.unknown = re.compile("[^" + "".join(re.escape(chr(c)) for c in _KNOWN) + "]").search
            self.special = tuple(x["content"].lower() for x in spec["added_tokens"])
        for tool in (self.whole, self.lean, self.bare):
            if tool is not None:
                tool.no_truncation()
                tool.no_padding()

    def plain(self, text: str) -> str | None:
        """A text of known characters without special strings, in lower case and of the same length; None for others."""
        lower = None if self.bare is None or self.unknown(text) else text.lower()
        return None if lower is None or any(x in lower for x in self.special) else lower

    def _library(self, tool, texts: list[str]) -> list[int]:
        encode = getattr(tool, "encode_batch_fast", tool.encode_batch)
        return [len(x) for x in encode(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, encoded whole; words new to the table are encoded in one batch."""
        out, words, rest = [0] * len(texts), {}, []
        for k, text in enumerate(texts):
            lower = self.plain(text)
            if lower is None:
                rest.append(k)
            else:
                words[k] = self.words(lower)
        new = list(set().union(*words.values()).difference(self.table))
        if len(self.table) + len(new) > TABLE:
            self.table.clear()
            new = list(set().union(*words.values()))
        self.table.update(zip(new, self._library(self.bare, new), strict=True))
        for k, found in words.items():
            out[k] = sum(map(self.table.__getitem__, found))
        for w in new:
            if len(w) > WORD:
                del self.table[w]
        for k, n in zip(rest, self._library(self.lean, [texts[k] for k in rest]), strict=True):
            out[k] = n
        return out


@lru_cache(maxsize=2)
def _load(path: str) -> Tokens:
    return Tokens(path)


def _encode(tokenizer, text: str, at: int) -> tuple[list[int], list[int]]:
    """Where each token starts, in characters of the whole text, and its id."""
    found = tokenizer.encode(text, add_special_tokens=False)
    return [s + at for s, _ in found.offsets] if at else [s for s, _ in found.offsets], found.ids


def _blank(c: str) -> bool:
    """White space as tokenizers know it; Python counts four separators of ASCII too."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _boundary(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], text: str, lo: int, hi: int) -> int | None:
    """The first place between lo and hi where both encodings may be spliced.

    White space comes before it, which no token, no pre-token and no special string of the tokenizer spans and which no
    normalisation carries anything across; a token starts there in both; and from there on, up to the left chunk's last
    AGREE tokens, both have the same tokens.
    """
    (starts, ids), (others, other_ids) = left, right
    last = len(starts) - AGREE
    for k in range(bisect_right(starts, lo), last - AGREE + 1):
        s = starts[k]
        if s >= hi:
            break
        if s == starts[k - 1] or not _blank(text[s - 1]):
            continue
        j, n = bisect_left(others, s), last - k
        if others[j : j + n] == starts[k:last] and other_ids[j : j + n] == ids[k:last]:
            return s
    return None


def count_tokens(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text. A text longer than a chunk is encoded in chunks that overlap and are spliced at a common
    boundary; the overlap is doubled, and the next chunk with it, where there is none; what no boundary divides is
    encoded whole."""
    if len(text) <= chunk:
        return len(tokenizer.encode(text, add_special_tokens=False))
    total, begin, end = 0, 0, chunk
    left = _encode(tokenizer, text[:end], 0)
    while end < len(text):
        span = overlap
        while True:
            lo = max(begin, end - span)
            stop = min(len(text), lo + max(chunk, 2 * span))
            if lo == begin:  # the whole chunk is no overlap that helps: encode it again, made longer
                end = min(len(text), begin + 2 * (end - begin))
                left = _encode(tokenizer, text[begin:end], begin)
                break
            right = _encode(tokenizer, text[lo:stop], lo)
            cut = _boundary(left, right, text, lo, end)
            if cut is not None:
                total += bisect_left(left[0], cut)
                j = bisect_left(right[0], cut)
                left = right[0][j:], right[1][j:]
                begin, end = cut, stop
                break
            span *= 2
    return total + len(left[0])


def counts(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text; huge ones are encoded chunk by chunk, the others whole, in batches of bounded size."""
    tools = _load(path)
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= chunk]
    for lo, hi in slices(short, lambda i: len(texts[i]), 300_000):
        for i, n in zip(short[lo:hi], tools.counts([texts[i] for i in short[lo:hi]]), strict=True):
            out[i] = n
    for i, t in enumerate(texts):
        if len(t) > chunk:
            lower = tools.plain(t)
            out[i] = count_tokens(tools.lean, t, chunk, overlap) if lower is None else count_tokens(tools.bare, lower, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id is kept, repeated rows are counted each, other columns
    are ignored, an empty table gives an empty result. Memory is bounded by a batch and by a chunk's tokens.
    """
    ship(docs.sparkSession)
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column("_text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
