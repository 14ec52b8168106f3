"""Secret scans with a ledger: every distinct text is scanned once by each version of each rule.

A document row is a version at a path (its id); its text is a blob, addressed by SHA-256. The
ledger holds, by run, the marks (blob and the rule versions that have read it) and the findings (blob,
rule version, start, end). A scan

1. writes the versions (id and blob) of its rows and takes what the ledger lacks: pairs of blob and rule version;
2. fetches one text for each such blob, and runs only the missing rules on it;
3. writes the findings, then the marks: a run counts once its marks are whole, so a scan that dies leaves nothing;
4. joins findings back to all versions that hold the blob.

Texts are shuffled only where the rows to leave out (or to read) are too many to be broadcast. The
places of matches are running sums of the lengths of what lies between (``split``) and of the matches
themselves, so all is done by Spark's own functions.

Defined results: a null text counts as empty; null and repeated ids are versions like any other, and each
row gets its own result; empty tables give no rows and leave the ledger as it is. Only doc_id and
text are read. Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Rows of the table of exceptions that are broadcast at most (about 100 bytes each); more of them are joined by shuffle.
BROADCAST_ROWS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """A pattern and what a match needs besides; a text that lacks all ``literals`` is not tried."""

    kind: str
    version: int
    pattern: str
    least: int = 0  # characters of the match, or of its group
    group: int = 0
    literals: tuple[str, ...] = ()
    any_case: bool = False  # of the literals; these are given in lower case

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The forms of well-known credentials.
_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # maximal runs either way, so short ones need not be met and dropped
)
RULES = (
    *BASE,
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]+", 40, 0, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 15, 0, ("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]+", 39, 0, ("AIza",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, ("eyJ",)),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("-----BEGIN ",)),
    Rule("url_login", 1, r"(https?|ftps?|ssh|postgres(ql)?|mysql|mongodb|rediss?|amqps?)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", 0, 0, ("://",)),
)


class Ledger:
    """Marks and findings of earlier scans, a folder a run, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> list[str]:
        """Folders of the runs whose marks are whole."""
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        home = jvm(self.path)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        found = [f"{self.path}/{s.getPath().getName()}" for s in fs.listStatus(home)]
        return sorted(run for run in found if fs.exists(jvm(f"{run}/marks/_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        runs = self.runs()
        return self.spark.read.schema(schema).parquet(*[f"{run}/{table}" for run in runs]) if runs else self.spark.createDataFrame([], schema)

    def marks(self) -> DataFrame:
        return self._read("marks", "blob binary, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob binary, rule string, start long, end long")

    def append(self, findings: DataFrame, marks: DataFrame) -> None:
        run = f"{self.path}/{uuid.uuid4().hex}"
        findings.write.parquet(f"{run}/findings")
        marks.write.parquet(f"{run}/marks")  # last: this is what commits the run


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")


def versions(docs: DataFrame) -> DataFrame:
    """doc_id and blob of every row."""
    return docs.select("doc_id", _blob())


def _bits(names: Column, rules: tuple[Rule, ...]) -> Column:
    """Bit k is set where the array ``names`` holds the name of rule k."""
    total = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        total = total + F.when(F.array_contains(names, rule.name), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def unseen(found: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob and id of ``found``: blob, doc_id, copies, missing.

    missing: bits of the rules to run on the text of that row: for one id of each blob (the smallest; null
    if it has no other) those that the ledger lacks, else 0.
    """
    every = F.lit((1 << len(rules)) - 1).cast("long")
    seen = ledger.marks().groupBy("blob").agg(F.bit_or(_bits(F.col("rules"), rules)).alias("seen"))
    pairs = materialize(found.groupBy("blob", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
    first = pairs.groupBy(F.col("blob").alias("its")).agg(F.min("doc_id").alias("of"))
    chosen = first.join(seen, F.col("its") == F.col("blob"), "left").select("its", "of", every.bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))).alias("missing"))
    # by blob and id: a blob of many ids is dealt over all tasks
    joined = pairs.join(chosen, (F.col("blob") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select("blob", "doc_id", "copies", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))


def _texts(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """blob, text, missing: one row per blob that has rules to run.

    Most rows share one value of ``missing`` (all rules at first, none later); only the others are joined.
    """
    usual = todo.groupBy("missing").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "missing").first()
    usual = usual["missing"] if usual else 0
    other = materialize(todo.filter((F.col("missing") != usual) | (F.col("copies") > 1)).withColumnRenamed("doc_id", "of"))
    few = other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", _blob())
    joined = rows.join(F.broadcast(other) if few else other, (rows["blob"] == other["blob"]) & rows["doc_id"].eqNullSafe(other["of"]), "left")
    joined = joined.select(rows["blob"], "text", F.coalesce("missing", F.lit(usual)).alias("missing"), F.coalesce("copies", F.lit(1)).alias("copies")).filter("missing != 0")
    out = joined.filter("copies = 1").drop("copies")
    if not other.filter("missing != 0 AND copies > 1").isEmpty():  # rows equal in id and text: nothing tells them apart
        out = out.unionByName(joined.filter("copies > 1").drop("copies").dropDuplicates(["blob"]))
    return out


def _hits(rule: Rule, k: int) -> Column:
    """Matches of one rule in text order: array of (rule, at, gap, size, kept); gap is what lies between it and the match before."""
    tried = F.col("missing").bitwiseAND(F.lit(1 << k)) != 0
    if rule.literals:
        within = F.col("low" if rule.any_case else "text")
        found = within.contains(rule.literals[0])
        for literal in rule.literals[1:]:
            found = found | within.contains(literal)
        tried = tried & found
    tried = tried & F.col("text").rlike(rule.pattern)
    both = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("match"))
    part = lambda m: F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m

    def hit(z, i):
        kept = F.char_length(part(z["match"])) >= rule.least
        return F.struct(F.lit(rule.name).alias("rule"), i.alias("at"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["match"]).alias("size"), kept.alias("kept"))

    some = F.filter(both, lambda z: z["match"].isNotNull())
    none = F.array().cast("array<struct<rule:string,at:int,gap:int,size:int,kept:boolean>>")
    return F.when(tried, F.transform(some, hit)).otherwise(none)


def match(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``texts`` (blob, text, missing): blob, rule, start, end; leftmost matches of a rule do not overlap."""
    cased = texts.withColumn("low", F.lower("text"))
    rows = cased.select("blob", F.explode(F.concat(*[_hits(rule, k) for k, rule in enumerate(rules)])).alias("hit")).select("blob", "hit.*")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("at"))
    placed = rows.withColumn("end", end).filter("kept")
    return placed.select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs``; gives the versions (doc_id, blob), written once."""
    found = materialize(versions(docs))
    todo = materialize(unseen(found, ledger, rules))
    marks = todo.filter("missing != 0")
    if not marks.isEmpty():
        run = F.array_compact(F.array(*[F.when(F.col("missing").bitwiseAND(F.lit(1 << k)) != 0, F.lit(rule.name)) for k, rule in enumerate(rules)]))
        ledger.append(match(_texts(docs, todo), rules), marks.select("blob", run.alias("rules")))
    return found


def current(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rules' present versions: blob, k (the rule's number), kind, start, end."""
    order = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.name, k)])
    found = ledger.findings().withColumn("k", order[F.col("rule")]).filter("k IS NOT NULL")
    return found.select("blob", "k", F.substring_index("rule", "@", 1).alias("kind"), "start", "end")


def paths(found: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings at every path: doc_id, kind, start, end; ``found`` are versions."""
    return found.join(current(ledger, rules), "blob").select("doc_id", "kind", "start", "end")


def digests(found: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans: kind:start:end of all findings by start, then rule; base_sha256: SHA-256 of that of the base kinds alone.
    """
    text = lambda hits: F.array_join(F.transform(hits, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    hits = current(ledger, rules).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "k", "end", "kind"))).alias("hits"))
    base = [rule.kind for rule in BASE]
    of = lambda kinds: F.filter("hits", lambda x: x["kind"].isin(kinds))
    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in base]
    each = hits.select("blob", *counts, F.sha2(text(of(base)), 256).alias("base_sha256"), text(F.col("hits")).alias("spans"))
    none = {f"n_{kind}": F.lit(0).cast("long") for kind in base} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return found.join(each, "blob", "left").select("doc_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def findings(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``digests`` of ``docs`` after a scan with ``ledger`` (None: a new one)."""
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex}")
    return digests(scan(docs, ledger), ledger)
