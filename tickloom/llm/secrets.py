"""Secret scans over an incremental ledger of content-addressed blobs.

A path (document, or a version of a file) points to a blob, the SHA-256 of its text. Only pairs of blob and rule version
that the ledger lacks are scanned, each once; findings are joined back to all paths of the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, slices

RULE_VERSION = 1
LEDGER = "blob binary, rule_version int, spans array<struct<kind:string, start:int, end:int>>"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules, in the order in which kinds are listed.
_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
#: Further kinds that the method adds, after the base ones.
ADDED = {
    # To its end, or, where the next such mark is none, as far as the lines after it look like the body of a key.
    "private_key": re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:(?:(?!-----(?:BEGIN|END) ).)*+)-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:\s*\n(?:[A-Za-z-]+: [^\n]*+|[A-Za-z0-9+/]{24,}+={0,2}|[A-Za-z0-9+/]+={1,2})[\x20\t\r]*(?=\n|\Z))*)"
    ),
    # Of a run of token characters only the first eyJ can begin a match, so a run is passed once; "at" is where it begins.
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(?P<at>)eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "vendor": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{20,})"),
    "url_login": re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@"),
}
#: What a text must hold for a rule to have a match at all: plain substring searches are much cheaper than the rules.
HINTS = {
    "private_key": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "vendor": ("gho_", "ghp_", "ghu_", "ghs_", "ghr_", "xox", "k_live_"),
    "url_login": ("://",),
}
KINDS = ("assign", "access", "hex", *ADDED)
BASE = KINDS[:3]


def find(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of all findings of a text, by start, then kind as listed."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, rule in ADDED.items():
        if any(h in text for h in HINTS[kind]):
            found += [(kind, m.start("at") if "at" in rule.groupindex else m.start(), m.end()) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def blob() -> Column:
    """The address of a row's text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger rows to add for the texts of docs: blob, rule_version, spans (empty if nothing is found).

    docs: column text, any number of versions and copies; nulls count as empty texts, an empty table gives no rows.
    Copies meet after a partial aggregation, so a text that a third of all rows share is shuffled once per task. Blobs that
    the ledger has for this rule version aren't scanned. Rules pass a text once, whatever its length.
    """
    # A blob's text is any of its copies; they are equal.
    blobs = docs.select(blob().alias("blob"), F.col("text").cast("string").alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([rule_version] * len(texts), pa.int32()), pa.array(spans, kind)],
                ["blob", "rule_version", "spans"],
            )

    return blobs.mapInArrow(work, LEDGER)


def update(docs: DataFrame, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Bring the ledger in the folder path up to date with the texts of docs, and give all of it.

    The folder is made if need be and should be one that outlives the job: what earlier runs scanned, of any version of any
    document, isn't scanned again, and a new rule version scans all blobs that are still there once more.
    """
    spark = docs.sparkSession
    try:
        seen = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a ledger that can't be read is no empty one
            raise
        seen = None
    scan(docs, seen, rule_version).write.mode("append").partitionBy("rule_version").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, name: str = "spans", rule_version: int = RULE_VERSION) -> DataFrame:
    """docs (with all their columns) and the array of findings in the column name (an earlier one is replaced).

    The array is empty where the blob has no findings. Only blobs with findings join, so clean texts cost nothing; equal
    texts all get their blob's findings, and a ledger that has a blob twice changes nothing.
    """
    key, spans = fresh(docs, "blob_", "spans_")
    some = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    some = some.groupBy(F.col("blob").alias(key)).agg(F.first("spans").alias(spans))
    joined = docs.withColumn(key, blob()).join(some, key, "left")
    none = F.array().cast("array<struct<kind:string, start:int, end:int>>")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return joined.select(*kept, F.coalesce(spans, none).alias(name))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from doc_id and spans."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )


def _covered(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["end"] > at:
            parts += [text[at : max(at, s["start"])], f"[{s['kind']}]" if s["start"] >= at else ""]
            at = s["end"]
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with every finding in the text replaced by its kind in brackets; other texts, nulls too, stay as they are.

    All columns stay, whatever their names. Only texts with findings reach Python.
    """

    @F.arrow_udf("string")
    def covered(texts: pa.Array, spans: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else _covered(t, s) for t, s in both], pa.string())

    (name,) = fresh(docs, "found_")
    found = findings(docs, scan(docs), name)
    some = F.size(name) > 0
    hidden = covered(F.when(some, F.col("text")), F.when(some, F.col(name)))
    return found.withColumn("text", F.when(some, hidden).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def document_findings(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, counts and digests of each row of documents; with a ledger, only what it lacks is scanned.

    A null text is empty; repeated rows and null ids give a row each, an empty table none; other columns aren't returned.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    new = scan(rows, ledger)
    return digest(findings(rows, new if ledger is None else new.unionByName(ledger)).select("doc_id", "spans"))


def ledger_findings(docs: DataFrame, path: str) -> DataFrame:
    """document_findings() in two runs over a ledger in the folder path, as a nightly job would have it: the first run sees
    some half of the documents, the second one all of them and scans the blobs that are new to it."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    update(rows.where(F.coalesce(F.xxhash64("doc_id") > 0, F.lit(False))), path)
    return digest(findings(rows, update(rows, path)).select("doc_id", "spans"))


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()
