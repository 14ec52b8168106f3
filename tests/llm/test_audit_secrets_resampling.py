"""The filter audit, the secret ledger and the resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import permutations

import pytest

from pyspark.sql import functions as F

from vacantia.llm import audit, resampling, secret_scan
from vacantia.llm.secret_scan import Ledger

ROWS = "doc_id long, text string, lang string"
rng = random.Random(11)
LONG = "Lorem ipsum DOLOR sit amet, token: abcdef123456 " * 4000
PROSE = [" ".join(rng.choices(["alpha", "Beta", "GAMMA", "delta%", "épée", "日本", "x1"], k=n)) for n in (1, 19, 20, 21, 199, 200, 201, 900)]
SECRETS = [
    "password = 'hunter22'", "PassWord:short", "token: token=abcdef", "secret:secret=abcdef api_key=\"zzzzzz\" apikey = q/w+e=", "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 15, "xAKIA1 AKIA" + "9" * 16,
    "é日" + "0123456789abcdef" * 2 + "g" + "f" * 23 + "é" + "a" * 24, "ghp_" + "A1" * 20 + " and xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----\nMII", "https://bob:pa55@host/x eyJab.eyJcd.sig-1",
    "password=\n", "token=", "ſecret=abcdefg toKen=abcdefg",
]
EDGE = (
    [(None, None, None), (None, "", ""), (None, "a b c", "en"), (None, "a b c", None), (5, None, "de"), (5, None, "de"), (4, "", "de"), (-9, "a b c", "en"), (7, "a b c", "fr"), (7, "a b c", "fr"), (1 << 62, "A B#", "en")]
    + [(100 + k, t, ["en", "fr", None][k % 3]) for k, t in enumerate(PROSE * 3)]
    + [(200 + k, t, "en") for k, t in enumerate(SECRETS * 2)]
    + [(300, LONG, "en"), (301, LONG, "de"), (302, " \t\n\x0b\x0c\r", "en"), (303, "\x00\x1f", "en")]
    + [(400 + k, "one hot text of many copies", "en") for k in range(150)]
)


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names inside the operators
    return spark.createDataFrame(EDGE, ROWS).withColumns({c: F.lit("clash") for c in ("blob", "digest", "mask", "rank", "row", "bucket", "words", "least", "place", "missing")}).repartition(5)


def edges(spark):
    return spark.createDataFrame([(7, 1, 1), (7, None, 0), (100, 1, 0), (101, 0, 1), (400, 1, None), (5, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


# ------------------------------------------------------------------ filter audit


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    found = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            letter
            for letter, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]))
            if bad
        )
        found[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, each in found.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = each
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                fails = sum(letter in x[0] for x in each)
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(x[0] == letter for x in each), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_against_brute_force(spark, docs):
    labels = [tuple(r) for r in edges(spark).collect()]
    found = audit.interactions(docs, edges(spark)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found} == brute_audit(EDGE, labels)
    assert len(found) == 600 * len({lang or "" for _, _, lang in EDGE})


def test_audit_of_empty_tables(spark, docs):
    assert audit.interactions(docs.limit(0), edges(spark)).count() == 0
    assert audit.interactions(docs.filter("lang = 'fr'"), edges(spark).limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_masks_stay_native(docs):
    plan = audit.masks(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ secrets


def brute_spans(text, rules=secret_scan.RULES):
    plain = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "hex": "[0-9a-f]+"}
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(plain.get(rule.kind, rule.pattern), text or "", re.ASCII):
            if len(m[rule.group]) >= (24 if rule.kind == "hex" else rule.least):
                out.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def brute_digest(i, text):
    spans = brute_spans(text)
    base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
    count = Counter(s.split(":")[0] for s in base)
    return (i, count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans))


@pytest.mark.parametrize("bound", [secret_scan.BROADCAST_ROWS, 0])
def test_secrets_against_brute_force(docs, monkeypatch, bound):
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", bound)
    found = [tuple(r) for r in secret_scan.findings(docs).collect()]
    assert sorted(found, key=str) == sorted((brute_digest(i, t) for i, t, _ in EDGE), key=str)
    assert sum(bool(x[-1]) for x in found) > 20 and any("assign" in x[-1] and "access" not in x[-1] for x in found)


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, tmp_path, docs, monkeypatch):
    read = []
    texts = secret_scan._texts
    monkeypatch.setattr(secret_scan, "_texts", lambda *a: read.append(texts(*a)) or read[-1])
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.runs() == [] and secret_scan.scan(docs.limit(0), ledger).count() == 0 and ledger.runs() == []
    half = docs.filter("doc_id % 2 = 0")
    secret_scan.scan(half, ledger)
    blobs = {hashlib.sha256((t or "").encode()).digest() for i, t, _ in EDGE if i is not None and i % 2 == 0}
    assert {bytes(r.blob) for r in read[0].collect()} == blobs and read[0].count() == len(blobs)

    found = secret_scan.scan(docs, ledger)
    every = {hashlib.sha256((t or "").encode()).digest() for _, t, _ in EDGE}
    assert ledger.marks().count() == len(every) and len(ledger.runs()) == 2  # a mark a blob: the second run read the rest alone
    assert sorted(map(str, secret_scan.digests(found, ledger).collect())) == sorted(map(str, secret_scan.findings(docs).collect()))
    secret_scan.scan(docs, ledger)
    assert len(ledger.runs()) == 2  # nothing left to do

    wider = tuple(replace(r, version=2, pattern=r"[0-9a-f]{16,}") if r.kind == "hex" else r for r in secret_scan.RULES)
    again = secret_scan.scan(docs, ledger, wider)
    marks = [tuple(r.rules) for r in ledger.marks().filter(F.array_contains("rules", "hex@2")).collect()]
    assert marks == [("hex@2",)] * len(every)  # one rule was run, on every blob
    got = {(r.doc_id, r.start, r.end) for r in secret_scan.paths(again, ledger, wider).filter("kind = 'hex'").collect()}
    assert got == {(i, m.start(), m.end()) for i, t, _ in EDGE for m in re.finditer("[0-9a-f]{16,}", t or "")}


def test_a_run_without_marks_does_not_count(spark, tmp_path, docs):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    spark.createDataFrame([(b"x", "hex@1", 0, 1)], "blob binary, rule string, start long, end long").write.parquet(f"file://{tmp_path}/ledger/dead/findings")
    assert ledger.runs() == [] and ledger.findings().count() == 0
    secret_scan.scan(docs, ledger)
    assert len(ledger.runs()) == 1 and ledger.findings().filter(F.col("blob") == b"x").count() == 0


def test_rows_equal_in_id_and_text_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(None, "token=abcdefgh")] * 300 + [(1, "token=abcdefgh")] * 300 + [(2, "b")], "doc_id long, text string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    todo = secret_scan.unseen(secret_scan.versions(docs), ledger)
    assert secret_scan._texts(docs, todo).count() == 2
    assert secret_scan.digests(secret_scan.scan(docs, ledger), ledger).filter("n_assign = 1").count() == 600 and ledger.findings().count() == 1


def test_secret_scans_stay_native(spark, docs):
    plan = secret_scan.findings(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ resampling


def brute_features(text, grams=1):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + g]).encode()) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute_resample(rows, target, grams=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    each = [(i, *brute_features(t, grams)) for i, t, *_ in rows]
    s, t = Counter(f % buckets for _, _, fs in each for f in fs), Counter(f % buckets for x in target for f in brute_features(x, grams)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, fs in each:
        weight = sum(gain(f % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    fit = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = rank
    return sorted((str((*x[:4], x[5])) for x in out))


TARGET = ["Alpha alpha BETA", None, "", "x1 日本 épée gamma", "gamma of many copies"]


@pytest.mark.parametrize("parts", [1, 7])
def test_resampling_against_brute_force(spark, docs, parts):
    more = EDGE + [(1000 + k, " ".join(rng.choices(["alpha", "Beta", "GAMMA", "omega"], k=30)), "en") for k in range(400)]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    found = resampling.resample(spark.createDataFrame(more, ROWS).repartition(parts), target).collect()
    assert sorted(str(tuple(r)) for r in found) == brute_resample(more, TARGET)
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in found))) and len(found) == len(more)


def test_longer_runs_and_other_parameters(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    scored = resampling.scores(docs, target, grams=3, buckets=97, seed=7)
    found = resampling.ranked(scored, min_words=2, percent=55).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(tuple(r)) for r in found) == brute_resample(EDGE, TARGET, 3, 97, 2, 55, 7)


def test_drawn_documents_keep_their_columns(spark, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    drawn = resampling.draw(docs, target, min_words=3, percent=50)
    assert set(drawn.columns) == set(docs.columns)  # the clashing column rank holds the rank now
    ranks = sorted(r["rank"] for r in drawn.collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(brute_features(t)[0] >= 3 for _, t, _ in EDGE) // 2
    assert drawn.filter(F.col("text").isNull()).count() == 0 and drawn.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert sorted(str(tuple(r)) for r in resampling.resample(docs, none).collect()) == brute_resample(EDGE, [])


def test_resampling_stays_native(spark, docs):
    plan = resampling.resample(docs, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
