"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings (kept as they are):
  assign  a credential word, `:` or `=`, and a value of 6 characters or more
  access  `AKIA` and capitals or digits, 20 characters or more
  hex     a run of 24 or more of 0-9a-f
Weak candidates (parts that mean little on their own):
  ident     an id assignment or a run of capitals and digits
  opaque    a run of 32 or more of A-Za-z0-9+/ with a digit, a capital and a small letter
  endpoint  an http(s), ftp or jdbc-like address
Parts play roles: access and ident identify, assign, hex and opaque are secret,
endpoint is where to use them. A part's scope is its span widened by `reach`
code points on both sides. A weak candidate is reported if complementary parts
reach into its scope: ident needs a secret, opaque an identifier, endpoint
both. Weak candidates that overlap a base finding say nothing new and are left out.

Positions come from cutting the text at the matches: pieces and matches
alternate, and a running sum of their lengths over the matches of one document
gives each start. The interval join of parts and scopes is made with two
running windows per document in order of position (the farthest end of a role
so far, the nearest start still to come), so no pairs are made. A window holds
the matches of one document and kind, or the parts of one document.

Defined results: a null text is an empty one; documents without findings have
zeros, the SHA-256 of the empty string and an empty string; rows that repeat a
doc_id with the same text get the same result each, with other texts their own;
a null doc_id is kept; an empty table gives no rows; other columns are ignored.
Positions count code points, ends are exclusive.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockboard.llm.common import id_and_text

REACH = 200
#: Fixed patterns of the base findings. For access and hex the least length is
#: part of the pattern: a run too short holds no shorter or later match either.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": r"""(?i:(?:access|account|client|user)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
             r"""|(?<![A-Z0-9])[A-Z][A-Z0-9]{15,}(?![A-Z0-9a-z])""",
    "opaque": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+""",
}
BASE = ("assign", "access", "hex")
NAMES = tuple(KINDS)
IDENTIFIES, SECRET, PLACE = ("access", "ident"), ("assign", "hex", "opaque"), ("endpoint",)
LEAST_VALUE = 6


def cuts(text: Column, kind: int, pattern: str) -> Column:
    """For each match in order: its kind, number, the length of the text before it, of itself and of its value."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if NAMES[kind] == "assign" else None
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gap"),
                          (found if value is None else value).alias("value"))
    return F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"),
        F.length(x["found"]).cast("long").alias("size"), F.length(x["value"]).alias("value")))


def scoped(docs: DataFrame) -> DataFrame:
    d = id_and_text(docs)
    text = F.coalesce(d["text"], F.lit(""))
    return d.select(d["doc_id"], F.xxhash64(text).alias("h"), text.alias("text"))


def parts(docs: DataFrame) -> DataFrame:
    """Base findings and weak candidates alike: doc_id, h (hash of the text), kind (number), start, end."""
    d = scoped(docs)
    any_kind = "|".join(f"(?:{p})" for p in KINDS.values())
    arrays = [cuts(F.col("text"), k, p) for k, p in enumerate(KINDS.values())]
    rows = d.where(F.col("text").rlike(any_kind)).select("doc_id", "h", F.inline(F.concat(*arrays)))
    rows = rows.dropDuplicates(["doc_id", "h", "kind", "i"])          # of rows that are there twice
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.select("doc_id", "h", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value") \
        .where((F.col("kind") != NAMES.index("assign")) | (F.col("value") >= LEAST_VALUE)).drop("value")


def numbers(*names: str) -> list[int]:
    return [NAMES.index(n) for n in names]


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The base findings, and the weak candidates whose scope complementary parts reach into."""
    doc = Window.partitionBy("doc_id", "h")
    before = doc.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = doc.orderBy(F.col("start").desc(), F.col("kind").desc(), F.col("end").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")

    def within(names: tuple[str, ...], distance: int) -> Column:
        role = kind.isin(numbers(*names))
        left = F.max(F.when(role, F.col("end"))).over(before)
        right = F.min(F.when(role, F.col("start"))).over(behind)
        return F.coalesce(left + distance > F.col("start"), F.lit(False)) \
            | F.coalesce(right < F.col("end") + distance, F.lit(False))

    seen = found.select("*", within(IDENTIFIES, reach).alias("identified"), within(SECRET, reach).alias("secret"),
                        within(BASE, 0).alias("covered"))
    id_, secret = F.col("identified"), F.col("secret")
    weak = (~F.col("covered")) & (((kind == NAMES.index("ident")) & secret) | ((kind == NAMES.index("opaque")) & id_)
                                  | ((kind == NAMES.index("endpoint")) & id_ & secret))
    return seen.where(kind.isin(numbers(*BASE)) | weak).select("doc_id", "h", "kind", "start", "end")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    def name(kind: Column) -> Column:
        return reduce(lambda c, k: c.when(kind == k, NAMES[k]), range(1, len(NAMES)), F.when(kind == 0, NAMES[0]))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, findings (array of kind number, start, end; by start, then kind)."""
    rows = linked(parts(docs), reach).groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("findings"))
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "findings")
    d = scoped(docs).drop("text")
    return d.join(rows, d["doc_id"].eqNullSafe(rows["__id"]) & (d["h"] == rows["__h"]), "left").select(
        "doc_id", F.coalesce("findings", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
        .alias("findings"))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(name: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == NAMES.index(name))).cast("long")

    base = F.filter("findings", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))
