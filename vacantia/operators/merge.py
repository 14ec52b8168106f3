"""Snapshot writes: each takes a target and gives the new target, to be written in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import lookup, materialize
from .grams import candidates


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, insert: list[str] | None = None) -> DataFrame:
    """Insert source rows, or overwrite ``update`` columns (default: all it supplies) of equal keys.

    ``insert``: columns that new rows get (default: all supplied); the others are null there. Columns
    of the target that the source lacks are untouched. Source keys must be unique. Full outer
    join: one shuffle of each side on the keys.
    """
    supplied = [c for c in source.columns if c not in keys]
    update = supplied if update is None else update
    insert = supplied if insert is None else insert
    s = source.select(*keys, *(F.col(c).alias(f"__s_{c}") for c in supplied), F.lit(True).alias("__s"))
    joined = target.withColumn("__t", F.lit(True)).join(s, keys, "full")
    old, new = F.col("__t").isNotNull(), F.col("__s").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh = F.col(f"__s_{c}") if c in supplied else F.lit(None)
        updated = F.when(new, fresh).otherwise(F.col(c)) if c in update else F.col(c)
        return F.when(old, updated).otherwise(fresh if c in insert else F.lit(None)).alias(c)

    return joined.select(*map(column, target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source whose keys the target lacks are appended; a repeat is no error."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def toggle(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are present after each event has inserted or deleted them: those of odd count."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n % 2 = 1").select(*keys)


def get_or_create(target: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """target and a new row for each unknown name; new ids follow the largest."""
    fresh = names.select(name_col).distinct().join(target.select(name_col), name_col, "left_anti")
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = with_sequence(fresh, id_col, [name_col]).crossJoin(F.broadcast(top)).withColumn(id_col, (F.col(id_col) + F.col("__top")).cast(target.schema[id_col].dataType)).drop("__top")
    return target.unionByName(numbered, allowMissingColumns=True)


def with_sequence(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """1..n by ``order``, without one task for all rows: ranges are sorted, counted, and offset.

    The ranges are written once: their bounds come from a sample, which another pass might take otherwise.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__r", local).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__r") + F.col("__o")).drop("__p", "__r", "__o")


def stale_by_url(target: DataFrame, current: DataFrame, group: str, url: str) -> DataFrame:
    """Target rows but those of groups in ``current`` whose url is not in it."""
    seen = current.select(group, url).distinct().withColumn("__seen", F.lit(True))
    groups = current.select(group).distinct().withColumn("__group", F.lit(True))
    return target.join(groups, group, "left").join(seen, [group, url], "left").filter(F.col("__group").isNull() | F.col("__seen").isNotNull()).select(*target.columns)


def stale_by_run(target: DataFrame, run_id: str, column: str = "sync_run_id") -> DataFrame:
    """Rows of another run go; a null run id compares to nothing and survives."""
    return target.filter(F.coalesce(F.col(column) == run_id, F.lit(True)))


def expire(target: DataFrame, now: Column, hours: int = 48, column: str = "last_seen_at") -> DataFrame:
    """Rows seen within ``hours`` before ``now``."""
    return target.filter(F.col(column) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def cascade(parents: DataFrame, parent_key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Children whose parent is gone go too; a null reference stays."""
    alive = parents.select(F.col(parent_key).alias("__k")).distinct()
    out = []
    for child, ref in children:
        kept = child.join(alive, F.col(ref) == F.col("__k"), "left")
        out.append(kept.filter(F.col("__k").isNotNull() | F.col(ref).isNull()).drop("__k"))
    return out


def recount(companies: DataFrame, jobs: DataFrame, key: str = "id", ref: str = "company_id", name: str = "active_jobs_count") -> DataFrame:
    counts = jobs.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias("__n"))
    return companies.drop(name).join(counts, key, "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")


def update_by_rules(companies: DataFrame, rules: DataFrame, name: str = "trading_name") -> DataFrame:
    """Bulk updates by name patterns, the last matching rule wins.

    rules: rule_no (distinct), pattern, alt_pattern, not_pattern, max_length, ats_provider, ats_board_token (null
    where a rule has none). Names meet only the rules that share a gram with them (``grams.candidates``),
    so the work follows the names' length and not names times rules.
    """
    n = F.col(name)
    like = F.ilike(n, F.col("pattern")) | F.coalesce(F.ilike(n, F.col("alt_pattern")), F.lit(False))
    on = like & ~F.coalesce(F.ilike(n, F.col("not_pattern")), F.lit(False)) & F.coalesce(F.length(n) < F.col("max_length"), F.lit(True))
    positive = rules.select(F.col("rule_no").alias("rule"), F.explode(F.array("pattern", "alt_pattern")).alias("pattern"))
    pairs = candidates(companies.select("id", n.alias("text")), positive).select("id", F.col("text").alias(name), F.col("rule").alias("rule_no"))
    r = rules.select("rule_no", "pattern", "alt_pattern", "not_pattern", "max_length", F.struct("rule_no", F.col("ats_provider").alias("p"), F.col("ats_board_token").alias("t")).alias("__rule"))
    hits = pairs.join(lookup(r), "rule_no").filter(on).groupBy("id").agg(F.max("__rule").alias("__rule"))
    joined = companies.join(hits, "id", "left")
    hit = F.col("__rule").isNotNull()
    out = {"ats_provider": F.when(hit, F.col("__rule.p")).otherwise(F.col("ats_provider")), "ats_board_token": F.when(hit, F.col("__rule.t")).otherwise(F.col("ats_board_token"))}
    return joined.withColumns(out).drop("__rule")


def overlay(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join of overrides: a non-empty override wins over the base value."""
    o = overrides.select(key, *(F.when(F.col(c) != "", F.col(c)).alias(f"__o_{c}") for c in columns))
    joined = base.join(o, key, "left")
    return joined.withColumns({c: F.coalesce(f"__o_{c}", c) for c in columns}).select(*base.columns)


def backfill(df: DataFrame, column: str, *sources: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), *sources))


def widen(target: DataFrame, source: DataFrame) -> DataFrame:
    """``target`` with the columns that only ``source`` has, null in all its rows."""
    return target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in source.schema if f.name not in target.columns})


def narrow(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source`` without the columns that ``target`` lacks, for a target whose schema must not change."""
    return source.select(*(c for c in source.columns if c in target.columns))


def checked(rows: DataFrame, allowed: Column) -> DataFrame:
    """Rows to be written, each held against a row-level rule: one that it does not allow fails the write."""
    return rows.filter(F.when(F.coalesce(allowed, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row violates the row-level rule")).cast("boolean")))
