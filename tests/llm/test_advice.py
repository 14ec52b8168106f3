
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vacantia.llm import language, mixing, queries
from vacantia.llm.common import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, source="s0"):
    return (i, text, "en", source, len(text))


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(n)]


def stage(k, spark, rows):
    return sorted(map(tuple, corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, DOCS), "").collect()), key=str)


def test_exact_stage_keeps_one_of_repeated_rows_and_null_ids(spark):
    a, b, c, d = texts(4)
    rows = [row(1, a)] * 3 + [row(2, a), row(3, b), row(3, b + " "), row(None, b), row(None, c + "  "), row(None, c + "  "), row(None, c), row(4, c), row(5, d)]
    assert stage(1, spark, rows) == sorted([row(1, a), row(3, b + " "), row(None, c + "  "), row(5, d)], key=str)


def test_near_stage_keeps_one_of_repeated_rows_and_null_ids(spark):
    a, b, c, d = texts(4)
    rows = [row(1, a), row(1, a), row(1, a + " tail"), row(7, a + " end"), row(None, a + " last"), row(7, b), row(None, c), row(None, c + " x"), row(8, d)]
    got = stage(2, spark, rows)
    assert len(got) == 4 and {r[1] for r in got} & {a, a + " tail"} and {r[1] for r in got} & {c, c + " x"}
    assert row(7, b) in got and row(8, d) in got and Counter(r[0] for r in got) == Counter([1, 7, None, 8])


def test_mixture_takes_each_row_once_a_pass(spark):
    some = texts(12)
    rows = [row(k, t, f"s{k % 3}") for k, t in enumerate(some[:8])] + [row(0, some[0])] * 3 + [row(1, some[8], "s1"), row(None, some[9]), row(None, some[10], "s2"), row(None, some[10], "s2")]
    docs = spark.createDataFrame(rows, DOCS)
    planned, got = defaultdict(int), defaultdict(int)
    for r in mixing.assign(docs).collect():
        planned[r.doc_id] += r.taken
    for r in mixing.mixture(docs).collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {i: n for i, n in planned.items() if n} and got[None]


def test_pipeline_result_has_the_training_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [row(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 50, 2000]))), f"s{i % 3}") for i in range(200)]
    mixed = mixing.mixture(spark.createDataFrame(rows, DOCS)).select(*DOCS.replace(",", "").split()[::2])
    order = [r.doc_id for r in mixed.collect()]
    for k, n in enumerate((150, 3, 40, len(order) - 193)):  # files of unlike sizes, as range partitions may be
        lo = (0, 150, 153, 193)[k]
        one = spark.createDataFrame([(*rows[i], lo + j) for j, i in enumerate(order[lo : lo + n])], DOCS + ", at int").coalesce(1).sortWithinPartitions("at").drop("at")
        one.write.parquet(f"{tmp_path}/one{k}")
        part = next((tmp_path / f"one{k}").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / part.name.replace("part-00000", f"part-{k:05d}"))
    back = spark.read.parquet(f"{tmp_path}/all")
    assert [r.doc_id for r in back.collect()] != order
    got = corpus_pipeline.STAGES[-1][1](spark, back, "").collect()
    assert len({r.position for r in got}) == len(order)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == order


def test_op8_is_sorted_and_has_all_positions(spark, tmp_path):
    rows = [row(i, t, f"s{min(i, 3)}") for i, t in enumerate(texts(40))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_mixing(spark, str(tmp_path)).collect()
    takes = {r.doc_id: sorted(t.position for t in r.takes) for r in mixing.assign(spark.createDataFrame(rows, DOCS)).collect()}
    assert {r.doc_id: r.positions for r in got} == takes and max(map(len, takes.values())) > 1
    first = [(r.first_position is None, r.first_position or 0.0, r.doc_id) for r in got]
    assert first == sorted(first) and all((r.first_position is None) == (not r.positions) for r in got)


def languages(n, seed=1):
    """n languages of disjoint letters: a word maker for each, and their model."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = [lambda a=letters[4 * k : 4 * k + 4]: "".join(rng.choices(a, k=5)) for k in range(n)]
    logs = np.zeros((n, 1 << language.BITS), np.float32)
    for k in range(n):
        code, _, _ = language.word_trigrams(*utf8(pa.array([" ".join(make[k]() for _ in range(400))])))
        count = np.bincount(code, minlength=1 << language.BITS) + 0.5
        logs[k] = np.log(count / count.sum())
    return make, language.Model([f"l{k}" for k in range(n)], logs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_language_sets_have_any_size(n):
    make, model = languages(6)
    long = " ".join(make[k]() for k in range(n) for _ in range(40))
    share, _ = model.mixtures(*utf8(pa.array([long, make[5](), "", long])))
    for s in (share[0], share[3]):
        assert np.flatnonzero(s > 0.0005).tolist() == list(range(n)) and np.abs(s[:n] - 1 / n).max() < 0.05
    assert share[1].tolist() == [0, 0, 0, 0, 0, 1] and not share[2].any()
