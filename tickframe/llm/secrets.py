"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. A ledger says which blobs were
scanned under which rule version; only unseen pairs of blob and rule version are scanned, each content
once however many paths or versions hold it, and findings are joined back to all paths. The ledger is stored
as Parquet by rule version: a later run over grown or changed tables scans their new contents only.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` give them in order,
and their lengths in code points add up to starts and ends.

Defined cases: a null text is the empty text; repeated rows and copies share one blob and each get its
findings; a null path id is kept; an empty table gives an empty result; extra columns are ignored.

Scale: texts are shuffled once, by content hash, after each task has dropped its own repeats, so a content
that a third of all rows hold arrives once from each task. Findings go back over (path, hash) rows only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators.audit import exists


@dataclass(frozen=True)
class Rule:
    """A kind, its Java pattern, and the least length of a group of a match (0: all of it) that keeps the match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    #: A string that any match contains, which is tested first.
    needs: str | None = None


#: Fixed values of the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # a run is either long enough as a whole or dropped as a whole
)
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Parts into which the rows of one content are dealt when findings go back; findings are copied to each.
SALTS = 16


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, kind number, end) of the matches of one rule that its test keeps, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        m, start = x["m"], acc["at"] + x["gap"]
        end = start + F.length(m)
        kept = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, zero, add)["out"]
    present = text.contains(rule.needs) if rule.needs else text.rlike(rule.pattern)
    return F.when(present, spans).otherwise(F.array().cast(SPANS))


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then kind."""
    return F.array_sort(F.concat(*(rule_spans(text, i, r) for i, r in enumerate(rules))))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, spans {SPANS}")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the contents that the ledger lacks under these rules."""
    version = rule_version(rules)
    blobs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return blobs.select("blob", F.lit(version).alias("rule_version"), scan_text(F.col("text"), rules).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger, empty if there is none yet."""
    if not exists(spark, path):
        return empty_ledger(spark)
    return spark.read.schema(f"blob string, spans {SPANS}, rule_version string").parquet(path)


def extend_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan the pairs of content and rule version that the ledger at ``path`` lacks, append them, and return it.

    Rule versions are folders, so only the current one is read. An append is committed as a whole: a run that was
    broken off leaves the ledger as it was. One writer at a time.
    """
    spark = docs.sparkSession
    scan_unseen(docs, read_ledger(spark, path), rules, text_col).write.mode("append").partitionBy("rule_version").parquet(path, compression="zstd")
    return read_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The path columns, blob and spans of every row of ``docs``; seen blobs take theirs from the ledger."""
    known = scan_unseen(docs, ledger, rules, text_col)
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == rule_version(rules)))
    return joined_back(docs, known, path_cols, text_col)


def ledger_findings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``findings`` of every row, by way of the ledger stored at ``path``, which is brought up to date first."""
    ledger = extend_ledger(docs, path, rules, text_col)
    return joined_back(docs, ledger.where(F.col("rule_version") == rule_version(rules)), path_cols, text_col)


def joined_back(docs: DataFrame, known: DataFrame, path_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """Findings of contents, at every path that holds them."""
    paths = docs.select(*path_cols, blob_id(F.col(text_col)).alias("blob"), salt_of(docs).alias("salt"))
    return paths.join(salted_hits(known), ["blob", "salt"], "left").select(*path_cols, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def salt_of(docs: DataFrame) -> Column:
    """A part for each row, by its columns other than texts."""
    plain = [docs[f"`{c}`"] for c, kind in docs.dtypes if kind in ("bigint", "int")]
    return F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int") if plain else F.lit(0)


def salted_hits(known: DataFrame) -> DataFrame:
    """Findings (of contents that have any), once for each part: paths of a common content meet them in SALTS tasks."""
    return known.where(F.size("spans") > 0).select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every covered stretch (overlapping spans as one) replaced by the mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, zero, add)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def redacted(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked.

    Only contents with findings are joined back, by their hash, so texts are shuffled once for the scan
    and once to meet the findings.
    """
    version = rule_version(rules)
    known = scan_unseen(docs, ledger, rules, text_col)
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == version))
    hits = salted_hits(known).alias("hits")
    rows = docs.alias("rows")
    text = F.col(f"rows.`{text_col}`")
    masked = F.when(F.col("hits.spans").isNotNull(), redact(text, F.col("hits.spans"), mask)).otherwise(text)
    columns = [masked.alias(c) if c == text_col else F.col(f"rows.`{c}`") for c in docs.columns]
    same = (blob_id(text) == F.col("hits.blob")) & (salt_of(docs) == F.col("hits.salt"))
    return rows.join(hits, same, "left").select(*columns)
