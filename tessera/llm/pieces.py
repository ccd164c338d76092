"""SentencePiece encoding and decoding with a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from .common import lean, slices

MARK = "▁"
#: Marks and what follows them up to the next mark; marks at the end stand alone.
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkEncoder:
    """Encodes a text chunk by chunk. Where no piece holds a mark behind another character, no merge can cross the
    start of a marked word, so that each distinct word needs segmenting only once. That is checked on loading, along
    with what makes marked text equal to the library's own normalisation; for any other model, texts go to the library
    whole. Chunks of more than `longest` characters, as scripts without blanks have them, are segmented where they stand and
    not kept; the table is emptied when its chunks reach `most` characters. Both bound memory and change no result."""

    def __init__(self, path: str, most: int = 4_000_000, longest: int = 64):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.lib, self.most, self.longest = sentencepiece.SentencePieceProcessor(model_file=path), most, longest
        self.table: dict[str, tuple[list[int], str]] = {}
        self.held = 0
        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces if p.type in (1, 4))
        user = any(p.type == 4 for p in spec.pieces)
        self.by_chunk = not crossing and not user and train.model_type == 2 and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix
        self.alone = [self.lib.piece_to_id(MARK)]

    def _segment(self, chunks: list[str]) -> dict[str, tuple[list[int], str]]:
        # the library itself puts the first mark before a text
        found = self.lib.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        found = [ids if len(c) > 1 else self.alone for c, ids in zip(chunks, found, strict=True)]
        return {c: (ids, ",".join(map(str, ids))) for c, ids in zip(chunks, found, strict=True)}

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same as decimals joined by commas."""
        if not self.by_chunk:
            return [(ids, ",".join(map(str, ids))) for ids in self.lib.encode(texts, num_threads=1)]
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {c for chunks in split for c in chunks if c not in self.table}
        long = {c for c in new if len(c) > self.longest}
        size = sum(map(len, new)) - sum(map(len, long))
        if self.held + size > self.most:
            self.table, self.held = {}, 0
            new = {c for chunks in split for c in chunks}
            size = sum(len(c) for c in new if len(c) <= self.longest)
        self.table |= self._segment(sorted(new - long))
        self.held += size
        here = self._segment(sorted(long)) if long else {}
        out = []
        for chunks in split:
            found = [self.table[c] if c in self.table else here[c] for c in chunks] if here else [self.table[c] for c in chunks]
            out.append(([i for ids, _ in found for i in ids], ",".join([s for _, s in found])))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row for each document: doc_id, ids, decoded, n_tokens, ids_sha256, decoded_sha256 (ids and decoded only if full).

    No shuffle: every worker keeps its own table of distinct chunks and joins ids back by position. A null text counts
    as empty: no ids. A null doc_id is kept, repeated rows are encoded each, other columns are ignored, an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    path = path or default_model()
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in slices(texts, lambda t: len(t) + 1, 1_000_000):
                found = tool.encode(texts[lo:hi])
                decoded = [tool.decode(ids) if ids else "" for ids, _ in found]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([sha(s) for _, s in found]), pa.array([sha(t) for t in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array([ids for ids, _ in found], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
