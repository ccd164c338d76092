"""Hash-chained audit logs. A chain is a log_id with records in order of seq; many chains are handled at once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StringType, StructField, StructType

from ..functions.constants import HINT_KEYS
from ..sources.session import ship

GENESIS = "GENESIS"
#: Places of a chain that are verified together.
BLOCK = 1 << 16
_TEXTS = MapType(StringType(), StringType())


def scrub(details: Column) -> Column:
    """The map with values hidden whose key hints at personal data."""
    return F.transform_values(details, lambda k, v: F.when(F.lower(k).rlike("|".join(HINT_KEYS)), F.concat(F.lit("<redacted:"), F.substring(F.sha2(v, 256), 1, 8), F.lit(">"))).otherwise(v))


def canonical_json(text: Column, scrubbed: bool = False) -> Column:
    """JSON text of any value as canonical JSON: keys sorted at each level, no blanks, ASCII alone, numbers in their shortest
    form. scrubbed: texts at the first level are hidden whose key hints at personal data. A null text stays null; a text that
    isn't JSON is an error."""
    hints = HINT_KEYS

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode

        def one(text):
            if text is None:
                return None
            value = json.loads(text)
            if scrubbed and isinstance(value, dict):
                value = {k: f"<redacted:{hashlib.sha256(v.encode()).hexdigest()[:8]}>" if isinstance(v, str) and any(h in k.lower() for h in hints) else v for k, v in value.items()}
            return encode(value)

        return texts.map(one)

    return run(text)


def details_json(details: Column, kind: DataType, scrubbed: bool = False) -> Column:
    """Details of any type as canonical JSON text, null as an empty object. A string holds JSON; a map of strings is encoded
    by columns alone; any other type (a variant, a struct, a map, with numbers, booleans, lists and nesting) goes through
    to_json, where nulls stay."""
    if kind == _TEXTS:
        pairs = F.transform(F.array_sort(F.map_entries(scrub(details) if scrubbed else details)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(json_text(e["value"]), F.lit("null"))))
        return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit("}"))
    text = details if isinstance(kind, StringType) else F.to_json(details, {"ignoreNullFields": "false"})
    return F.coalesce(canonical_json(text, scrubbed), F.lit("{}"))


def json_text(text: Column) -> Column:
    """A JSON string of ASCII alone: quotes and backslashes escaped, all beyond printable ASCII as \\uXXXX, in pairs beyond
    the first plane, and the usual short forms of control characters."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(c.rlike('["\\\\]'), F.concat(F.lit("\\"), c)).when(c.rlike("[ -~]"), c)
        for sign, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
            out = out.when(c == sign, F.lit(short))
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return out.when(n > 0xFFFF, pair).otherwise(unit(n))

    plain = F.regexp_replace(text, '(["\\\\])', "\\\\$1")
    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike("^[ -~]*$"), plain).otherwise(each), F.lit('"'))


def json_number(text: Column) -> Column:
    """A decimal as the shortest JSON number of its value: no zeros at its end, but one digit behind the point."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def _fields(record: Column, kind: DataType | None) -> dict[str, Column]:
    """The JSON of each field that is hashed, but for prev_hash. No kind: details are canonical JSON as they stand."""
    text = lambda c: F.coalesce(json_text(record[c]), F.lit("null"))
    details = record["details"] if kind is None else details_json(record["details"], kind)
    return {c: text(c) for c in ("actor", "event", "record_id", "request_id")} | {"details": details, "ts": F.coalesce(json_number(record["ts"]), F.lit("null"))}


def _object(fields: dict[str, Column]) -> list[Column]:
    """The parts of an object's JSON, keys sorted and no blanks."""
    out: list[Column] = []
    for name in sorted(fields):
        out += [F.lit(f'{"," if out else "{"}"{name}":'), fields[name]]
    return [*out, F.lit("}")]


def canonical(record: Column, kind: DataType | None = _TEXTS) -> tuple[Column, Column]:
    """The canonical JSON of a record, keys sorted and no blanks, before and behind the value of prev_hash.

    record has event, request_id, actor, details (of type kind, see details_json; of none, if they are canonical JSON), ts
    (seconds as decimal text) and record_id.
    """
    parts = _object(_fields(record, kind) | {"prev_hash": F.lit('"')})
    at = next(n for n, name in enumerate(sorted([*_fields(record, kind), "prev_hash"])) if name == "prev_hash") * 2 + 2
    return F.concat(*parts[:at]), F.concat(F.lit('"'), *parts[at:])


def line(record: Column, kind: DataType = _TEXTS, more: tuple[str, ...] = ()) -> Column:
    """A sealed record as a line of a log: its canonical JSON with both hashes, and with numbers or texts that `more` names."""
    quoted = lambda c: F.concat(F.lit('"'), record[c], F.lit('"'))
    extra = {c: F.coalesce(record[c].cast("string") if c == "seq" else json_text(record[c]), F.lit("null")) for c in more}
    return F.concat(*_object(_fields(record, kind) | {c: quoted(c) for c in ("prev_hash", "record_hash")} | extra))


def heads(log: DataFrame) -> DataFrame:
    """(log_id, head_seq, head_hash): the last place and hash of each chain of sealed records."""
    return log.groupBy("log_id").agg(F.max("seq").alias("head_seq"), F.max_by("record_hash", "seq").alias("head_hash"))


def seal(records: DataFrame, after: DataFrame | None = None, ready: bool = False) -> DataFrame:
    """Adds prev_hash and record_hash to records (log_id, seq, event, request_id, actor, details, ts, record_id).

    after: heads of chains that go on (see heads). Their first new record is linked to the head, and records up to a head's
    place are left out, as they are sealed already; so a batch that comes again changes nothing. Other chains begin anew.

    Details that are no map of strings become their canonical JSON; ready: they are that already (see details_json), and are
    taken as they stand. Sealing is sequential by its nature: chains are dealt to
    tasks, sorted, and hashed as their rows stream by, with no more kept of a chain than its last hash.
    """
    ship(records.sparkSession)
    kind = records.schema["details"].dataType
    if not ready and kind != _TEXTS:
        # canonical from here on
        records, ready = records.withColumn("details", details_json(F.col("details"), kind)), True
    kind = None if ready else kind
    before, behind = canonical(F.struct("*"), kind)
    rows = records.withColumn("_before", before).withColumn("_behind", behind).withColumn("_new", F.lit(True))
    if after is not None:
        ids = records.schema["log_id"].dataType
        rows = rows.unionByName(after.select(F.col("log_id").cast(ids).alias("log_id"), F.col("head_seq").cast(records.schema["seq"].dataType).alias("seq"), F.col("head_hash").alias("_before"), F.lit(False).alias("_new")), allowMissingColumns=True)
    rows = rows.repartition("log_id").sortWithinPartitions("log_id", "_new", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev, since, begun = None, GENESIS, None, False
        for batch in batches:
            links, hashes, new = [], [], []
            for log_id, seq, a, b, fresh in zip(*[batch.column(c).to_pylist() for c in ("log_id", "seq", "_before", "_behind", "_new")], strict=True):
                if not begun or log_id != chain:
                    chain, prev, since, begun = log_id, GENESIS, None, True
                if not fresh:
                    prev, since = a, seq
                new.append(fresh and (since is None or seq is None or seq > since))
                links.append(prev)
                if new[-1]:
                    prev = hashlib.sha256(f"{a}{prev}{b}".encode()).hexdigest()
                hashes.append(prev)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(links, pa.string()), pa.array(hashes, pa.string())], [*batch.schema.names[:-3], "prev_hash", "record_hash"])
            yield out.filter(pa.array(new, pa.bool_()))

    out = StructType([*[StructField(f.name, f.dataType) for f in records.schema.fields], StructField("prev_hash", StringType()), StructField("record_hash", StringType())])
    return rows.mapInArrow(run, out)


def verify(log: DataFrame, after: DataFrame | None = None, block: int = BLOCK, ready: bool = False) -> DataFrame:
    """One row for each chain: log_id, ok, checked, broken_at, reason. The first failing record decides, its link being tested
    before its own hash. Records come with their fields, or with `body`, the canonical JSON that was hashed
    (sources.io.read_audit_lines). after: heads that the chains go on from (see heads). ready: details are the canonical JSON
    that was hashed, so that any other text of the same value fails, too.

    A chain may be of any length: its records are tested in blocks of consecutive places, each against the record before it
    in the block, and blocks are dealt to tasks as such. A block leaves one row, its first link, its last hash and what failed
    first; those rows alone, a chain's length over `block`, are put in order by chain to test the links between blocks.
    """
    own = F.sha2("body", 256) if "body" in log.columns else F.sha2(F.concat(*(lambda p: (p[0], F.col("prev_hash"), p[1]))(canonical(F.struct("*"), None if ready else log.schema["details"].dataType))), 256)
    rows = log.select("log_id", "seq", "record_id", "prev_hash", "record_hash", (F.col("record_hash") != own).alias("changed"), F.floor(F.col("seq") / block).cast("long").alias("block"))
    within = Window.partitionBy("log_id", "block").orderBy("seq")
    rows = rows.withColumn("place", F.row_number().over(within) - 1).withColumn("before", F.lag("record_hash").over(within))
    unlinked = (F.col("place") > 0) & (F.col("prev_hash") != F.col("before"))
    bad = F.when(unlinked | F.col("changed"), F.struct(F.col("place").cast("long").alias("place"), "record_id", unlinked.alias("unlinked")))
    blocks = rows.groupBy("log_id", "block").agg(F.count("*").alias("n"), F.min(bad).alias("bad"), F.min(F.when(F.col("place") == 0, F.struct("record_id", "prev_hash"))).alias("first"), F.max_by("record_hash", "place").alias("last"))
    chain = Window.partitionBy("log_id").orderBy("block")
    start = F.lit(GENESIS)
    if after is not None:
        blocks = blocks.join(after.select(F.col("log_id").alias("_of"), "head_hash"), F.col("log_id").eqNullSafe(F.col("_of")), "left").drop("_of")
        start = F.coalesce("head_hash", start)
    blocks = blocks.withColumn("past", F.coalesce(F.sum("n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("link", F.coalesce(F.lag("last").over(chain), start))
    apart = F.when(F.col("first.prev_hash") != F.col("link"), F.struct(F.col("past").alias("place"), F.col("first.record_id").alias("record_id"), F.lit(True).alias("unlinked")))
    inside = F.when(F.col("bad").isNotNull(), F.struct((F.col("past") + F.col("bad.place")).alias("place"), F.col("bad.record_id").alias("record_id"), F.col("bad.unlinked").alias("unlinked")))
    found = blocks.groupBy("log_id").agg(F.min(F.coalesce(apart, inside)).alias("b"), F.sum("n").alias("n"))
    ok = F.col("b").isNull()
    reason = F.when(~ok, F.when(F.col("b.unlinked"), F.lit("prev_hash mismatch")).otherwise(F.lit("record_hash mismatch")))
    return found.select("log_id", ok.alias("ok"), F.coalesce("b.place", "n").alias("checked"), F.col("b.record_id").alias("broken_at"), reason.alias("reason"))
