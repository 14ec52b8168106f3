"""What the n-gram join leaves on the disk while it runs."""

from __future__ import annotations

import glob
import random
import time

from pyspark.sql import functions as F

from vacantia import tables
from vacantia.llm import jaccard
from vacantia.tables import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}


def borderline(spark):
    """Copies of one text of which about half of the pairs link."""
    rng, rows = random.Random(12), []
    for i in range(40):
        now = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 1 + i % 3):
            now[k] = f"x{i}-{k}"
        rows.append((i, " ".join(now)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_shuffles_of_a_table_go_when_it_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    frame = spark.range(0, 100_000, 1, 4).groupBy((F.col("id") % 977).alias("k")).count()
    kept = materialize(frame)
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP, "false") == setting
    assert kept.count() == kept.count() == materialize(frame).count() == frame.count() == 977  # the frame can be run again
    files = [f.removeprefix("file:") for f in kept.inputFiles()]
    assert all(map(glob.glob, files))
    tables.drop_table(kept)
    assert not any(map(glob.glob, files))


def test_sets_are_narrowed_without_a_shuffle(spark, monkeypatch):
    """The sets of open lists are told by a filter, and what nothing reads any more is dropped at once."""
    monkeypatch.setattr(jaccard, "SMALL_LIST", 2)
    made, plain = [], jaccard.materialize

    def noted(df):
        made.append((df.columns, df._jdf.queryExecution().executedPlan().toString(), kept := plain(df)))
        return kept

    monkeypatch.setattr(jaccard, "materialize", noted)
    nodes, comp, links = jaccard.node_components(borderline(spark))
    sets = [(plan, kept) for columns, plan, kept in made if "grams" in columns]
    assert len(sets) == 2  # all candidates, and those of open lists
    assert not any("Exchange" in plan for plan, _ in sets)
    near = [kept for columns, _, kept in made if "kind" in columns]
    gone = lambda t: not any(glob.glob(f.removeprefix("file:")) for f in t.inputFiles())
    assert gone(near[0]) and gone(sets[0][1]) and not gone(sets[1][1])
    assert nodes.count() == 40 and comp.count() and links.count()


def test_narrowed_sets_lack_none(spark, monkeypatch):
    grams = jaccard.Grams()
    docs = borderline(spark)
    sets = materialize(jaccard.candidate_sets(docs, docs.select("doc_id"), grams))
    some = sets.select("node").orderBy("node").limit(9)
    want = {r.node for r in some.collect()}
    assert {r.node for r in jaccard.sets_of(sets, some).collect()} >= want
    assert jaccard.sets_of(sets, some.limit(0)).count() == 0
    monkeypatch.setattr(jaccard, "_bloom", lambda nodes: ~jaccard.np.zeros(1 << jaccard.BLOOM_BITS - 3, "u1"))
    assert jaccard.sets_of(sets, some).count() == 40  # a full filter lets all pass
