"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds, for each blob, the
rules (with their versions) that were run on it and what each version found. A scan reads only blobs with rules
that the ledger lacks, each content once however many paths hold it, appends the new findings and joins
them back to all paths.

Defined results: a NULL text is the empty blob; repeated rows and ids each get their content's findings;
texts of any length are scanned whole; an empty table gives an empty result; input columns stay in ``row``.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.llm.arrays import lists
from cohortlens.llm.bits import flagged, narrowed
from cohortlens.session import stage, stage_dir

LEDGER = ("blob binary, rules array<string>, "
          "findings array<struct<start:int,kind:int,rule:string,stop:int>>")


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The first three are the base; the rest are well-known forms of credentials.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2,
         re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("repository", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat", 1, r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", 1, r"\bAIza[A-Za-z0-9_-]{35}"),
)
BASE = 3


def _finder(rule: Rule):
    """Spans of a rule in a text."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        # runs of one class: those long enough are the same runs
        find = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", rule.flags).finditer
        return lambda text: [m.span() for m in find(text)]
    find, group, least = re.compile(rule.pattern, rule.flags).finditer, rule.group, rule.least
    return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """LEDGER rows of blobs (``blob``, ``text``, ``todo``: the keys of the rules to run)."""
    def run(batches):
        finders = [(k, r.key, _finder(r)) for k, r in enumerate(rules)]
        for batch in batches:
            starts, kinds, names, stops, counts = [], [], [], [], []
            for text, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                before = len(starts)
                for k, key, find in finders:
                    if key in todo:
                        for a, b in find(text):
                            starts.append(a)
                            kinds.append(k)
                            names.append(key)
                            stops.append(b)
                counts.append(len(starts) - before)
            found = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(names, pa.string()),
                 pa.array(stops, pa.int32())], ["start", "kind", "rule", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists(found, counts)],
                                             ["blob", "rules", "findings"])

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(StructType.fromDDL(LEDGER)).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _once(contents: DataFrame) -> DataFrame:
    """One row of each ``blob``. Only digests are shuffled, and the texts of those that occur again."""
    again = stage(contents.groupBy("blob").count().where("count > 1").select("blob"))
    told = flagged(contents, again, "blob", "again")
    shared = told.where("again").groupBy("blob").agg(F.first("text").alias("text"))
    return told.where("NOT again").select("blob", "text").unionByName(shared)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the ledger."""
    spark = versions.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules))
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    contents = versions.select(F.unhex(F.sha2(value, 256)).alias("blob"), value.alias("text"))
    known = read_ledger(spark, path)
    if known is None:
        todo = _once(contents).withColumn("todo", keys)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = stage(contents.select("blob").distinct().join(seen, "blob", "left")
                       .select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                       .where(F.size("todo") > 0))
        todo = _once(narrowed(contents, unseen, "blob")).join(unseen, "blob")
    scan_blobs(todo, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def scan_versions(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns of every path and version) and ``findings``, sorted by start and rule."""
    keep = list(versions.columns) if keep is None else keep
    current = F.array(*(F.lit(r.key) for r in rules))
    ledger = update_ledger(versions, path, rules, text)

    def shown(f):
        """A finding with its rule's place in ``rules`` and plain name, whatever order it was scanned in."""
        return F.struct(f["start"], (F.array_position(current, f["rule"]) - 1).cast("int").alias("kind"),
                        F.regexp_replace(f["rule"], "@[0-9]+$", "").alias("rule"), f["stop"])

    # only what the asked versions of the rules found: findings of older versions stay in the ledger, unseen
    asked = F.filter("findings", lambda f: F.array_contains(current, f["rule"]))
    hits = (ledger.select("blob", F.transform(asked, shown).alias("findings")).where(F.size("findings") > 0)
            .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings")))
    blob = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    rows = versions.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), blob.alias("blob"))
    none = F.array().cast("array<struct<start:int,kind:int,rule:string,stop:int>>")
    # rows whose content has no finding stay where they are
    hits = stage(hits)
    told = flagged(rows, hits, "blob", "hit")
    clear = told.where("NOT hit").select("row", none.alias("findings"))
    return clear.unionByName(told.where("hit").join(hits, "blob", "left").select("row", F.coalesce("findings", none).alias("findings")))


def new_ledger(spark: SparkSession) -> str:
    """A path below the shared folder for a ledger that begins empty."""
    return f"{stage_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"


def spans_of(findings, rules: tuple[Rule, ...] | None = None):
    """``kind:start:stop`` of findings, joined by commas."""
    kept = findings if rules is None else F.filter(findings, lambda f: f["rule"].isin([r.name for r in rules]))
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["rule"], f["start"], f["stop"])), ",")


def redact(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``scan_versions`` with each stretch of findings in ``text`` replaced by ``mark``."""
    columns = found.schema["row"].dataType
    at = columns.names.index(text)

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            values = rows.field(at).to_pylist()
            for k, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    out, reach = [], 0
                    for s in spans:
                        if s["start"] > reach or not out:
                            out += [values[k][reach:s["start"]], mark]
                        reach = max(reach, s["stop"])
                    values[k] = "".join(out) + values[k][reach:]
            fields = [rows.field(i) for i in range(len(columns.names))]
            fields[at] = pa.array(values, fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, columns.names)

    return found.select("row", "findings").mapInArrow(run, columns)
