"""Secret scans with multipart credential linking, with DataFrame operations only.

Spans are whole matches, as code points from 0 with the end exclusive. Base kinds:

* `assign`: a name such as password or api_key, an equals sign or colon, and a value of 12 or more characters;
* `access`: AKIA and capitals or digits, 18 or more characters;
* `hex`: 16 or more lower-case hexadecimal digits.

Weak kinds are reported only where complementary parts co-occur in the scope, that is within `reach` characters:

* `ident`: a client, account, user or access id or name with its value - needs a secret nearby;
* `endpoint`: an address with a scheme, or a host or endpoint setting - needs an identifier and a secret nearby;
* `weak`: an assigned value of 6 to 11 characters, a value of 6 or more of a name that ends in key (secret_access_key),
  or 20 or more characters of base64 without a name - needs an identifier or an endpoint nearby. A client, account, user
  or access key may be the identifier of another secret as well, and needs any other part nearby.

Names stand in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import piece, text_blocks
from .common import Scratch

#: Fixed pattern of an assignment; group 2 is the value. Letters of the names stand in either case, ASCII only.
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Runs of allowed characters are maximal, so a least length in the pattern equals dropping short matches afterwards.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"


def _either(name: str) -> str:
    """A pattern of a name's letters in either case, ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_IS = "[\"']?\\x20*[:=]\\x20*[\"']?"
_WHO = f"(?:{_either('client')}|{_either('account')}|{_either('user')}|{_either('access')})"
IDENT = f"{_WHO}[_-]?(?:{_either('id')}|{_either('name')}|{_either('key')}[_-]?{_either('id')}){_IS}([A-Za-z0-9@._-]{{4,}})"
ENDPOINT = f"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{{4,}}|(?:{_either('host')}|{_either('endpoint')}){_IS}[A-Za-z0-9.-]{{4,}}"
#: A setting whose name ends in key, such as secret_access_key, from the last parts of the name on. No part of the pattern
#: looks around or backtracks far, so that matching stays linear in any text.
KEY = f"(?:(?:(?:{_either('secret')}[_-])?{_WHO}|{_either('secret')})[_-]?{_either('key')}|[_-]{_either('key')}|[a-z0-9]Key){_IS}[A-Za-z0-9+/_.=-]{{6,}}"
#: The beginning of a key that may also be an identifier.
MAY_BE_ID = f"^{_WHO}[_-]?{_either('key')}"
#: An unnamed value: a run of base64, with letters of either case and a digit or sign; it counts where its letters and
#: digits change their class as often as random ones do.
OPAQUE = "[A-Za-z0-9+/]{20,}={0,2}"
TURNS = "[A-Z]+|[a-z]+|[0-9]+"

KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
REACH = 400
#: How sure a kind of match is: base spans, named parts, names in key, unnamed values. What overlaps a surer match says
#: nothing new.
_BASE, _NAMED, _KEYS, _UNNAMED = range(4)
_FOUND = "array<struct<s:int,k:int,e:int,p:int>>"


def _matches(text: Column, pattern: str, group: int, tier: Column, kind: Column) -> Column:
    """Array of (t, k, i, g, m): tier and kind, number, gap before it and length, of the leftmost matches that don't overlap;
    tier and kind are functions of x["m"], the match, and x["v"], its group. A null tier drops the match, not its length."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("m"), values.alias("v"))
    numbered = F.transform(parts, lambda x, i: F.struct(tier(x).cast("int").alias("t"), kind(x).cast("int").alias("k"), i.cast("int").alias("i"), F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m")))
    # the last gap has no match behind it
    return F.when(text.rlike(pattern), F.filter(numbered, lambda x: x["m"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<t:int,k:int,i:int,g:int,m:int>>)"))


def _opaque(x: Column) -> Column:
    """Whether an unnamed value looks random."""
    turns = F.regexp_count(F.regexp_replace(x, "[+/=]", ""), F.lit(TURNS))
    return x.rlike("[0-9+/]") & x.rlike("[A-Z]") & x.rlike("[a-z]") & (turns * 10 >= F.length(x) * 3)


def _patterns(text: Column) -> list[Column]:
    size = lambda x: F.length(x["v"])
    always = lambda value: lambda x: F.lit(value)
    return [
        _matches(text, ASSIGN, 2, lambda x: F.when(size(x) >= 12, _BASE).when(size(x) >= 6, _NAMED), lambda x: F.when(size(x) >= 12, 0).otherwise(5)),
        _matches(text, ACCESS, 0, always(_BASE), always(1)),
        _matches(text, HEX, 0, always(_BASE), always(2)),
        _matches(text, IDENT, 0, always(_NAMED), always(3)),
        _matches(text, ENDPOINT, 0, always(_NAMED), always(4)),
        _matches(text, KEY, 0, always(_KEYS), lambda x: F.when(x["m"].rlike(MAY_BE_ID), 6).otherwise(5)),
        _matches(text, OPAQUE, 0, lambda x: F.when(_opaque(x["m"]), _UNNAMED), always(5)),
    ]


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found, n_linked and the kept columns.

    found is the array of spans (s, k, e, p) in order, k an index into KINDS and p the end of all that came before; spans
    says the same as text; n_linked counts the weak ones. Whole texts are read once; from then on only matches move: their
    places are running sums over (document, pattern), what overlaps a surer match goes by running ends over the document,
    and weak candidates meet other parts in an interval join: equality on document and on bins of `reach` characters,
    then the distance. All of that is linear in a text's matches, and a bin holds few parts however long a text is.

    A null text counts as empty; a null doc_id is kept; repeated rows are each reported; other columns are ignored, but
    those named in `keep`, which are passed through. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("_own_id"), *[docs[c].alias(f"_keep_{c}") for c in keep], F.coalesce(docs[text_col], F.lit("")).alias("_text")).withColumn("_rid", F.monotonically_increasing_id())
    with_pattern = lambda n: lambda x: F.struct(F.lit(n).alias("p"), x.alias("x"))
    numbered = [F.transform(p, with_pattern(n)) for n, p in enumerate(_patterns(F.col("_text")))]
    rows = scratch.put(rows.withColumn("_raw", F.concat(*numbered)).drop("_text"))

    raw = rows.where(F.size("_raw") > 0).select("_rid", F.explode("_raw").alias("r")).select("_rid", "r.p", "r.x.*")
    upto = Window.partitionBy("_rid", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = raw.withColumn("e", F.sum(F.col("g") + F.col("m")).over(upto)).where("t is not null").select("_rid", "t", "k", (F.col("e") - F.col("m")).alias("s"), "e")
    # what begins later comes earlier in the opposite order: a frame up to the end would be gone through for every row
    before = lambda *order: Window.partitionBy("_rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier, later = before("s", "t", "e"), before(F.desc("s"), F.desc("t"), F.desc("e"))
    hidden = F.lit(False)
    for tier in (_NAMED, _KEYS, _UNNAMED):
        surer = F.col("t") < tier
        clash = (F.coalesce(F.max(F.when(surer, F.col("e"))).over(earlier), F.lit(-1)) > F.col("s")) | (F.coalesce(F.min(F.when(surer, F.col("s"))).over(later), F.col("e")) < F.col("e"))
        hidden = F.when(F.col("t") == tier, clash).otherwise(hidden)
    parts = spans.withColumn("hidden", hidden).where("not hidden").select("_rid", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "k", (F.col("t") == _BASE).alias("firm"))
    # identifiers: access and ident; secrets: assign, hex and weak; endpoints; keys that may be either of the first two
    parts = scratch.put(parts.withColumn("role", F.when(F.col("k").isin(1, 3), 1).when(F.col("k") == 4, 4).when(F.col("k") == 6, 3).otherwise(2)).withColumn("bin", F.floor(F.col("s") / reach)))

    weak = parts.where("not firm").select("_rid", F.col("s").alias("ws"), F.col("e").alias("we"), F.col("k").alias("wk"), F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])).alias("bin"))
    near = weak.join(parts, ["_rid", "bin"]).where((F.abs(F.col("s") - F.col("ws")) <= reach) & ((F.col("s") != F.col("ws")) | (F.col("k") != F.col("wk"))))
    met = near.groupBy("_rid", "ws", "we", "wk").agg(F.bit_or("role").alias("met"))
    wanted = ((F.col("wk") == 3) & (F.col("met").bitwiseAND(2) > 0)) | ((F.col("wk") == 4) & (F.col("met").bitwiseAND(3) == 3)) | ((F.col("wk") == 5) & (F.col("met").bitwiseAND(5) > 0)) | (F.col("wk") == 6)
    linked = met.where(wanted).select("_rid", F.col("ws").alias("s"), F.least("wk", F.lit(5)).alias("k"), F.col("we").alias("e"))
    every = parts.where("firm").select("_rid", "s", "k", "e").union(linked)
    order = Window.partitionBy("_rid").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("p", F.coalesce(F.max("e").over(order), F.lit(0)))
    every = scratch.put(every.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "p"))).alias("found")))

    # Only rows with spans are joined; the others, texts that are passed through with them, stay where they are.
    have = rows.where(F.size("_raw") > 0).drop("_raw").join(every, "_rid", "left")
    out = have.unionByName(rows.where(F.size("_raw") == 0).drop("_raw").withColumn("found", F.lit(None).cast(_FOUND)))
    out = out.withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {_FOUND})")))
    firm = F.filter("found", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return out.select(
        F.col("_own_id").alias("doc_id"),
        *[F.col(f"`_keep_{c}`").alias(c) for c in keep],
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(firm), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        "found",
        F.size(F.filter("found", lambda x: x["k"] > 2)).cast("long").alias("n_linked"),
    )


def redact(rows: DataFrame, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """The rows, with every span found replaced in the text by its kind in brackets; spans that overlap an earlier one are
    cut to their rest. A null text stays null.

    A text is cut into blocks once, and pieces come from their blocks, so that the work is linear in the text and its
    spans, however many there are.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = rows.withColumn("_blocks", F.when(F.size(found_col) > 0, text_blocks(F.col(text_col))))
    blocks = F.col("_blocks")
    marked = F.transform(found_col, lambda x: F.concat(piece(blocks, x["p"], x["s"]), F.lit("["), F.element_at(names, x["k"] + 1), F.lit("]")))
    end = F.aggregate(found_col, F.lit(0), lambda at, x: F.greatest(at, x["e"]))
    length = F.length(text_col)
    redacted = F.concat(F.array_join(marked, ""), piece(blocks, end, length))
    return rows.withColumn(text_col, F.when(F.size(found_col) > 0, redacted).otherwise(F.col(text_col))).drop("_blocks")
