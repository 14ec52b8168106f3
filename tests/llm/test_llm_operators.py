"""The operators on Spark: brute force on small tables, and the edge cases of every one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from vacantia.llm import exact_dedup, graph, jaccard, language, licenses, mixing, pieces, queries, sharding, suffixes, tiff, toxicity
from vacantia.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, size int, ids string, comp int"


def edge_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    base = [word() for _ in range(120)]
    near = [*base[:60], "zzz", *base[61:]]
    long = " ".join(word() for _ in range(30000))
    texts = [" ".join(base), " ".join(near), " ".join(base), "  ".join(base).upper(), "", None, " \t\n", "a", "x y", "x  y", long, long + " tail", "1234 !!", "x" * 5000, "Über é ñ 日本 🤖 \x00 ▁ end", " ".join(base[:50] * 3)]
    rows = [(i, t, "de" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None, 0.5, "k", 3, "z", 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, "null id " + texts[0], None, None, 1, None, None, None, None, None), (99, " ".join(base[5:115]), "en", "s1", 2, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, int(i % 2 == 0)) for i in range(16)] + [(3, 0, None), (None, 1, 1), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda d, l: language.identify(d),
    "exact": lambda d, l: exact_dedup.dedup(d),
    "tiff": lambda d, l: tiff.round_trip(d),
    "sharding": lambda d, l: sharding.placements(d),
    "toxicity": lambda d, l: toxicity.score_documents(d, l),
    "pieces": lambda d, l: pieces.digests(d),
    "licenses": lambda d, l: licenses.scan(d),
    "mixing": lambda d, l: mixing.assign(d),
    "suffixes": lambda d, l: suffixes.dedup(d),
    "jaccard": lambda d, l: jaccard.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(name, edge, labels):
    got = OPERATORS[name](edge, labels).collect()
    ids = lambda rows: sorted((r is None, r or 0) for r in rows)
    assert ids(r.doc_id for r in got) == ids(r[0] for r in edge_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark, edge, labels):
    empty = OPERATORS[name](spark.createDataFrame([], SCHEMA), labels.limit(0))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](edge, labels).columns


def test_exact_dedup_against_brute_force(edge):
    groups = defaultdict(list)
    rows = [r[:2] for r in edge_rows()]
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    got = {}
    for r in exact_dedup.dedup(edge).collect():
        got[r.doc_id] = (r.keep_id, r.group_size, r.kept, r.text_sha256)
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[key])[2]
        assert got[i] == (keep, len(groups[key]), keep == i, hashlib.sha256(key.encode()).hexdigest())


def test_history_split_never_changes_the_result(edge):
    from pyspark.sql import functions as F

    runs = [exact_dedup.dedup(edge, split).collect() for split in (F.lit(True), F.lit(False), F.col("doc_id") < 7)]
    key = lambda rows: sorted(map(str, rows))
    assert key(runs[0]) == key(runs[1])


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def chains(n_groups=6, seed=0):
    """Groups of near copies around the threshold, chains of them, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(n_groups):
        now = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, 25)):
            rows.append((len(rows), " ".join([*now, *passage] if rng.random() < 0.4 else now)))
            now = list(now)
            for _ in range(rng.randrange(1, 8)):
                now[rng.randrange(len(now))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_LIST", 3)
    monkeypatch.setattr(jaccard, "BUCKET_DOCS", 7)
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", 4)
    rows = chains(seed=seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = sets_of(rows)
    expected = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_jaccard_edge_rows_against_brute_force(edge):
    rows = [r[:2] for r in edge_rows() if r[0] is not None]
    sets, got = sets_of(rows), {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(edge.filter("doc_id is not null")).collect()}
    expected = brute_components(sets)
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def brute_repeats(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                hit[p : p + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh ": "".join(rng.choices(letters, k=n))
    shared = [text(rng.randrange(45, 300)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 400)) for _ in range(4)]
        for k in range(3):
            p = rng.choice(shared)
            cut = rng.randrange(0, 20)
            parts.insert(k * 2, p[cut : len(p) - rng.randrange(0, 20)])
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, "ab" * 300), (102, "ab" * 80), (103, "é" * 70), (104, "é" * 60), (105, ""), (106, None), (107, "a" * 49), (108, "ab" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_against_brute_force(spark, seed, monkeypatch):
    for name, value in (("BUCKET_BYTES", 2000), ("FLUSH", 300), ("FLUSH_PIECES", 50), ("SORT_BYTES", 4000)):
        monkeypatch.setattr(suffixes, name, value)
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs).collect()}
    assert got == brute_repeats(rows)


def test_suffixes_edge_rows(edge):
    rows = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(edge.filter("doc_id is not null")).collect()}
    assert got == brute_repeats(list(rows.items()))


def test_mixing_takes(edge):
    rows = mixing.assign(edge).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(t.words for t in r.takes)
        assert all(0 <= t.position <= 1 for t in r.takes)
        by[r.source_size, r.target][0] += r.taken
    for (_, target), (taken, _) in by.items():
        assert abs(taken - target) <= 1
    assert abs(sum(t for _, t in {(r.source_size, r.target) for r in rows}) - sum(r["size"] for r in rows)) < 1e-6


def test_positions_follow_the_integral():
    for slope in (0.6, 0.0, -0.6):
        for k in range(11):
            t = k / 10
            place = 50 * (t + slope * (t * t - t))
            root = ((1 - slope) ** 2 + 4 * slope * place / 50) ** 0.5
            assert abs((place / 50 if not slope else (root - (1 - slope)) / (2 * slope)) - t) < 1e-9


def test_mixture_repeats_and_cuts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(10 + i)), f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: sorted(t.words for t in r.takes) for r in mixing.assign(docs).collect()}
    got = defaultdict(list)
    for r in mixing.mixture(docs).collect():
        assert rows[r.doc_id][1].startswith(r.text)
        got[r.doc_id].append(len(r.text.split()))
    assert {i: sorted(n) for i, n in got.items()} == {i: n for i, n in plan.items() if n}


def test_sharding_slots(edge):
    names = [f"shard-{i:04d}" for i in range(sharding.SHARDS)]
    full, rest = sharding.fill(names), sharding.fill(names[:-1])
    for r in sharding.placements(edge).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard, r.shard_without_last) == (slot, full[slot], rest[slot])


def test_tiff_contract(edge):
    by_text = {}
    rows = {r[0]: r[1] for r in edge_rows()}
    for r in tiff.round_trip(edge).collect():
        payload, n = tiff.payload_of(rows[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by_text.setdefault(payload, r[5:8]) == r[5:8]


def test_tiff_pages(spark):
    good = tiff.write_tiff(b"0123456789abcdef" * 4 * 5000)
    files = spark.createDataFrame([(1, good), (2, b"no"), (3, None), (4, good[: len(good) // 2])], "file_id long, content binary")
    rows = tiff.pages(files).collect()
    assert [r.page for r in rows if r.file_id == 1] == [0, 1] and sum(r.width * r.height for r in rows if r.file_id == 1) == 64 * 5000
    assert {r.file_id for r in rows if r.error} == {2, 3, 4}


def test_pieces_round_trip(edge):
    rows = {r[0]: r[1] or "" for r in edge_rows()}
    for r in pieces.digests(edge).collect():
        assert r.round_trip == (pieces.SPACE not in rows[r.doc_id])
    ids = pieces.encode(edge.filter("doc_id is not null"))
    for r in pieces.decode(ids).collect():
        assert r.text == rows[r.doc_id].replace(pieces.SPACE, " ")


def test_language_on_held_out_rows(spark, tiny):
    docs = table(spark, tiny, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_no_letters_is_und(edge):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(edge).collect()}
    assert got[4] == got[5] == got[12] == ("und", 0.0)


def toxic_rows(n=1500, seed=2):
    """Label 1: an insult with a group, or one strong word; insult or group alone: label 0."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfghklmn", k=4))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["rotten"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_toxicity_learns_the_interaction(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    held = [r for r in toxicity.score_documents(docs, marks).collect() if r.held_out]
    assert len(held) > 300 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


def test_toxicity_never_sees_held_out_labels(spark):
    rows, labels = toxic_rows(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    runs = [sorted(toxicity.score_documents(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned)]
    assert runs[0] == runs[1]


def test_queries_and_sql_go_together():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()} == set(range(1, 14))
    assert set(queries.SQL) <= set(queries.queries())


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_on_edge_rows(spark, tmp_path, edge, labels, step):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    _, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, docs, str(tmp_path))
    assert step + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, marks = toxic_rows(600, 9)
    text = [[i, t, "en", f"s{i % 3}"] for i, t in rows]
    for i in range(0, 200, 5):
        text[i + 1][1] = text[i][1].replace(" ", "  ")  # exact copies
        text[i + 2][1] = text[i][1] + " tail"  # near copies
        marks[i + 1] = marks[i + 2] = (i + 1, 1, marks[i][2])
    marks = [(k, 1, m[2]) for k, m in enumerate(marks)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in text], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = {r[0]: r for r in text if not scores[r[0]]}
    best = {}
    for i, t, *_ in left.values():
        key = re.sub(r"\s", "", t)
        best[key] = min(best.get(key, (0, 10**9)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    comp = brute_components(sets_of([(i, r[1]) for i, r in left.items()]))
    left = {i: r for i, r in left.items() if comp[i] == i}
    kept = spark.createDataFrame([(*r, 0) for r in left.values()], docs.schema)
    takes = {r.doc_id: sorted(t.words for t in r.takes) for r in mixing.assign(kept).collect() if r.takes}
    out = defaultdict(list)
    c = pieces.codec()
    for r in got:
        assert r.n_pieces == len(r.ids)
        out[r.doc_id].append(len(c.decode(__import__("numpy").array(r.ids)).split()))
    assert {i: sorted(n) for i, n in out.items()} == takes


@pytest.mark.parametrize("block", [5, 2048])
def test_jaccard_of_borderline_copies(spark, monkeypatch, block):
    """Copies of one text that differ so much from each other that about half of the pairs link."""
    monkeypatch.setattr(jaccard, "SMALL_LIST", 2)
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", block)
    used, plain = [], jaccard.cross_links
    monkeypatch.setattr(jaccard, "cross_links", lambda *a: used.append(1) or plain(*a))
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):
        now = list(base)
        for k in rng.sample(range(120), 1 + i % 3):
            now[k] = f"x{i}-{k}"
        rows.append((i, " ".join(now)))
    sets = sets_of(rows)
    expected = brute_components(sets)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and used and 1 < len(set(expected.values())) < 70
