"""Rows that are hard on every operator: least ids, shared and null ids, long blank runs, many copies."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from test_advice import languages
from vacantia.llm import exact_dedup, jaccard, language, licenses, mixing, pieces, sharding, suffixes, tiff, toxicity
from vacantia.llm.common import blocks, materialize, row_key, utf8

LEAST, MOST = -(1 << 63), (1 << 63) - 1
DOCS = "doc_id long, text string"


def test_exact_dedup_with_the_extreme_ids_and_one_hot_text(spark):
    rows = [(LEAST, "a b"), (MOST, "ab"), (None, "a\tb"), (None, None), (7, ""), (7, "c"), (7, "d"), *[(k, None) for k in range(100, 400)]]
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    ab, empty = (hashlib.sha256(x).hexdigest() for x in (b"ab", b""))
    assert {found[i, ab].keep_id for i in (LEAST, None)} == {LEAST} and found[MOST, ab].group_size == 3  # the longest texts tie, the id decides
    assert found[150, empty].keep_id == 7 and found[None, empty].group_size == 302 and found[7, empty].kept
    assert len(found) == len(rows)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_blank_runs_go_through_matching(library):
    codec, rng = pieces.Codec(), random.Random(3)
    texts = [" " * n + tail for n in range(70) for tail in ("", "foo", "9 x", "\n")]
    texts += ["".join(rng.choice([" " * rng.randrange(1, 40), "foo", "the", "é", "日", "=", "\n", "ing"]) for _ in range(20)) for _ in range(300)]
    texts += [" " * 100_000, "abcdefgh" * 20_000]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t) for t in texts]


def test_slices_of_the_index_meet(library, monkeypatch):
    monkeypatch.setattr(pieces, "INDEX_BYTES", 64)
    texts = ["the quick  brown fox" * 20, " " * 300, "internationalisation" * 9, "x", ""]
    assert [x.tolist() for x in pieces.Codec().encode(texts)] == [library.encode(t) for t in texts]


def test_a_unit_without_a_chain_is_merged(library, monkeypatch):
    codec = pieces.Codec()
    monkeypatch.setattr(codec.vocab, "may_follow", lambda a, b: a < 0)
    monkeypatch.setattr(codec.vocab, "follows", lambda a, b: False)
    assert codec.encode(["unmatched words"])[0].tolist() == library.encode("unmatched words")


def test_every_text_is_stored_in_all_codings_and_layouts(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "x" * 64, "lorem ipsum " * 30, "".join(rng.choices("abcdef \n", k=30_000)), "é日" * 5000, "\0" * 700]
    for r in tiff.round_trip(spark.createDataFrame([(7, t) for t in texts], DOCS)).collect():
        kinds = [x.split(":")[0].split("-") for x in r.kinds.split(",")]
        assert [{k[i] for k in kinds} for i in range(3)] == [{"lzw", "packbits", "deflate"}, {"strips", "tiles"}, {"1", "2"}] and r.n_pages >= 4
    found = {r.payload_sha256 for r in tiff.round_trip(spark.createDataFrame([(7, t) for t in texts], DOCS)).collect()}
    assert found == {hashlib.sha256(tiff.payload_of(t)[0]).hexdigest() for t in texts}


def test_pages_behind_a_bad_one_are_read(spark):
    good = tiff.write_tiff(bytes(range(64)) * 64, page_rows=8)
    numbers = [p.number for p in tiff.read_pages(good)]
    bad = bytearray(good)
    for tag, value in ((tiff.LENGTH, 0), (tiff.TILE_WIDTH, 0), (tiff.ROWS_PER_STRIP, 0)):
        at = good.index(tag.to_bytes(2, "little") + b"\x04\x00\x01\x00\x00\x00")
        bad[at + 8 : at + 12] = value.to_bytes(4, "little")
    rows = tiff.pages(spark.createDataFrame([(1, bytes(bad)), (2, good)], "file_id long, content binary")).collect()
    assert [r.page for r in rows if r.file_id == 1] == numbers == [r.page for r in rows if r.file_id == 2]
    errors = [r.page for r in rows if r.error]
    assert 1 <= len(errors) <= 3 and len(numbers) == 8


def test_takes_and_positions_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 4)
    rng = random.Random(2)
    rows = [(rng.randrange(40) if k % 9 else None, " ".join("w" * rng.randrange(1, 60)), rng.choice(["b", "a", "é", None, "", "a" * 9, *("h" * 5)])) for k in range(150)]
    rows += [(7, None, "b"), (8, "", "zero"), (500, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mine = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce("doc_id", F.lit(-1))).alias("h"), row_key(docs).alias("key")).collect()
    names = sorted({r.source for r in mine}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((r.text or "").split()) for r in mine if r.source == s) for s in names}
    share = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    expected = []
    for i, s in enumerate(names):
        slope, before, quota = mixing.SLOPES[i % 3], 0, int(share[s] + 0.5)
        none_first = lambda x: (x is not None, x or 0)
        for r in sorted((r for r in mine if r.source == s), key=lambda r: (r.h, none_first(r.doc_id), len((r.text or "").split()), r.key)):
            n, takes = len((r.text or "").split()), []
            for k in range(mixing.MAX_PASSES):
                start = k * size[s] + before
                words = max(0, min(n, quota - start))
                if words:  # the place in time at which the integral of the weights reaches this demand
                    lo, hi, y = 0.0, 1.0, min(1.0, (start + words / 2) / share[s])
                    for _ in range(60):
                        t = (lo + hi) / 2
                        lo, hi = (t, hi) if t + slope * (t * t - t) < y else (lo, t)
                    takes.append((words, lo))
            before += n
            expected.append((r.doc_id, n, size[s], share[s], takes))
    got = [(r.doc_id, r["size"], r.source_size, r.target, [(t.words, t.position) for t in r.takes]) for r in mixing.assign(docs).collect()]
    order = lambda x: (str(x[0]), x[1], x[2], str([w for w, _ in x[4]]), [p for _, p in x[4]])
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and [w for w, _ in a[4]] == [w for w, _ in b[4]]
        assert all(abs(p - q) < 1e-9 for (_, p), (_, q) in zip(a[4], b[4]))


def test_mixture_keeps_null_ids_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "s", 1, 2, 3, 4.0)] * 3 + [(None, text + " a", "s", 1, 2, 3, 4.0), (None, text + " b", "s", 1, 2, 3, 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, take int, take_id int, position double")
    got = mixing.mixture(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", text)] * 3 + [("None", text + " a"), ("None", text + " b")])


def brute_repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row; a null id is the greatest long."""
    first, out = {}, []
    number = lambda i: MOST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, MOST), number(i))
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < number(i):
                hit[p : p + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((str(i), len(b), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and (not k or not hit[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeating_rows(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh ": "".join(rng.choices(letters, k=n))
    a, b, shared = text(200), text(200), [text(rng.randrange(45, 300)) for _ in range(5)]
    rows = [(5, a), (5, a), (5, b), (None, a), (None, b), (None, text(30) + b), (MOST, b), (LEAST, b[:60]), (None, None), (9, None), (9, ""), (None, "x" * 300), (3, "x" * 90)]
    for _ in range(60):
        i = rng.choice([None, rng.randrange(20), rng.randrange(1000)])
        rows.append((i, "".join(rng.choice([text(rng.randrange(200)), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(5))))
    return rows


@pytest.mark.parametrize(("seed", "small"), [(0, {}), (1, {"HOT": 3}), (2, {"CHUNK": 64, "FLAGS": 3}), (3, {"BUCKET_BYTES": 1024, "FLUSH": 50, "FLUSH_PIECES": 40, "SORT_BYTES": 1000, "SUFFIX_BUCKET": 16, "HOT": 5})])
def test_suffixes_with_shared_and_null_ids_against_brute_force(spark, monkeypatch, seed, small):
    for name, value in small.items():
        monkeypatch.setattr(suffixes, name, value)
    rows = repeating_rows(seed)
    got = suffixes.dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_cover_ranks_order_the_sample():
    rng = random.Random(6)
    text = np.frombuffer(bytes(rng.choices(b"ab", k=3000)), np.uint8)
    ranks = suffixes.CoverRanks(text, 50)
    places = [p for p in range(len(text) - 38) if p % suffixes.COVER in suffixes.RESIDUES]
    got = ranks.at(np.array(places))
    order = sorted(set(text[p : p + 38].tobytes() for p in places))
    assert [order.index(text[p : p + 38].tobytes()) for p in places[:400]] == [sorted(set(got.tolist())).index(x) for x in got[:400].tolist()]


def test_suffix_buckets_are_whole_and_in_order():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    window = np.arange(4900)
    for most in (1, 10, 700, 10**6):
        found = suffixes.suffix_buckets(text, window, most)
        assert sorted(np.concatenate(found).tolist()) == window.tolist()
        leads = [{bytes(text[w : w + 2]) for w in b} for b in found]
        assert all(not x & y and max(x) < min(y) for x, y in zip(leads, leads[1:]))
        assert all(len(b) <= most or len(x) == 1 for b, x in zip(found, leads))


def pair_rows(n=1600):
    """Label 1: a group word and an insult, or neither; one of them alone: label 0. Neither word tells anything by itself."""
    rng, rows = random.Random(5), []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 40))]
        kind = i % 4
        words += [[], ["groupies", "blockhead"], ["groupies"], ["blockhead"]][kind]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind < 2)))
    return rows


def as_features(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["doc_id", "toxic", "text"])
    return pa.Table.from_batches(list(toxicity._features(iter([batch])))).to_pandas()


def test_a_pair_without_marginal_signal_is_learnt():
    rows = pair_rows()
    machine = toxicity.train(as_features(rows[:1200]))
    (_, data, offsets), = blocks([pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows[1200:]])], ["text"])], limit=1 << 30)
    predicted = machine.scores(data, offsets) >= 0.5
    assert np.mean(predicted == np.array([r[2] > 0 for r in rows[1200:]])) > 0.97


def test_machine_scores_against_all_pairs():
    rng = np.random.default_rng(4)
    texts = ["one two three", "", "two insulting words two", "naïve wordy texts 12 ab_c"]
    used = 1 << toxicity.BITS
    machine = toxicity.Machine(-0.3, np.arange(used, dtype=np.int32) % 5000, rng.normal(0, 0.3, 5000), rng.normal(0, 0.3, (5000, toxicity.FACTORS)))
    (_, data, offsets), = blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], limit=1 << 30)
    doc, term = toxicity.terms(data, offsets)
    for i, got in enumerate(machine.scores(data, offsets)):
        mine = [k for k in machine.row[term[doc == i]] if k]
        z = machine.bias + sum(machine.w[a] for a in mine) + sum(machine.v[a] @ machine.v[b] for x, a in enumerate(mine) for b in mine[x + 1 :])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_sample_bound_on_terms_and_labels_without_documents(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(20)) + f" x{i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (3, "other text of id three")], DOCS)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(k, 1) for k in range(1000, 3000)] + [(None, 1)], "doc_id long, toxic int")
    found = toxicity.training_rows(docs, labels, 10).collect()
    assert sum(r.toxic for r in found) >= 10 and {r.doc_id for r in found} <= set(range(60))
    features = spark.createDataFrame([(i, i % 2, b"\0" * 400) for i in range(40)], "doc_id long, toxic int, terms binary")
    assert {tuple(r) for r in toxicity.bounded(features, 500).groupBy("toxic").count().collect()} == {(0, 5), (1, 5)}


def word_likelihoods(model, text):
    """Each word's likelihoods, relative to the best, one letter at a time."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    folded = bytes(map(fold, text.encode()))
    out = []
    for word in folded.split():
        padded, logs = b" " + word + b" ", np.zeros(len(model.names))
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            logs += model.logs[:, ((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> (32 - language.BITS)]
        out.append(np.exp(np.maximum(logs - logs.max(), -language.WORD_RANGE)))
    return np.array(out)


def brute_mixture(model, text):
    """Nested sets of the full fit's languages, each fitted by EM, the best penalised one; in double precision."""
    p = word_likelihoods(model, text)
    k, n = len(model.names), len(p)

    def em(pi, steps):
        for _ in range(steps):
            pi = np.mean([x * pi / (x @ pi) for x in p], 0)
        return pi

    full = em(np.full(k, 1 / k), language.EM_STEPS)
    order, best = np.argsort(-full, kind="stable"), (-np.inf, None)
    for size in range(1, k + 1):
        fit = np.where(np.isin(np.arange(k), order[:size]), full, 0)
        fit = em(fit / fit.sum(), language.SET_STEPS) if size > 1 else fit / fit.sum()
        value = sum(np.log(max(x @ fit, 1e-30)) for x in p) - size * 0.5 * np.log(n)
        best = max(best, (value, tuple(fit)))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_mixtures_against_brute_force_and_long_texts_in_runs(seed, monkeypatch):
    make, model = languages(5, seed)
    rng = random.Random(seed)
    texts = [" ".join(make[rng.choice(own)]() for _ in range(rng.randrange(3, 120))) for own in ([0], [0, 1], [2, 3, 4], [0, 1, 2, 3, 4], [4, 4, 4, 4, 1]) for _ in range(4)]
    texts += ["", " 12 !", "Ünïcode ABC abcd", "x"]
    (rows, data, offsets), = blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], limit=1 << 30)
    share, words = model.mixtures(data, offsets)
    monkeypatch.setattr(language, "LONG_BYTES", 64)
    for i, text in enumerate(texts):
        assert words[i] == len(word_likelihoods(model, text))
        if words[i]:
            value, fit = brute_mixture(model, text)
            p = word_likelihoods(model, text)
            mine = share[i]
            size = np.count_nonzero(mine)
            assert abs(sum(np.log(np.maximum(p @ mine, 1e-30))) - size * 0.5 * np.log(len(p)) - value) < 0.05
        else:
            assert not share[i].any()
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > 64:
            run, n = model.mixtures(raw, np.array([0, len(raw)]))
            assert n[0] == words[i] and np.abs(run[0] - share[i]).max() < 2e-3


def test_labels_that_are_no_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD_LABELS", 2)
    docs = spark.createDataFrame([(i, f"text of {i}", f"l{i}") for i in range(20)], DOCS + ", lang string")
    assert len(language.fit(docs).names) == 20 and language.fit(docs).logs.shape == (20, 1 << language.BITS)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 5)
    with pytest.raises(ValueError, match="labels"):
        language.fit(docs)


def brute_anchors(text, template):
    """All runs of MIN_MATCH words or more that text and template share and that go on on neither side."""
    out = set()
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= licenses.MIN_MATCH:
                    out.add((i, j, n))
    return out


def brute_cover(anchors):
    """Most words of a template that one chain of anchors covers."""
    anchors, best = sorted(anchors), {}
    for x, p, n in anchors:
        best[x, p, n] = max([n] + [
            best[y, r, m] + n - max(0, y + m - x, r + m - p)
            for y, r, m in best if y < x and r < p and y + m < x + n and r + m < p + n and x - y - m <= licenses.MAX_GAP and p - r - m <= licenses.MAX_GAP
        ])
    return max(best.values(), default=0)


def test_anchors_chains_and_labels_against_brute_force(monkeypatch):
    rng = random.Random(9)
    templates = {f"t{k}": [" ".join(rng.choices("abcde", k=rng.randrange(8, 25)))] for k in range(6)}
    m = licenses.automaton(templates, {"a b": "ab"})
    monkeypatch.setattr(licenses, "MAX_GAP", 3)
    for _ in range(150):
        text = rng.choices("abcdez", k=20)
        for _ in range(3):
            parts = rng.choice(list(templates.values()))[0].split()
            text += rng.choices("abz", k=rng.randrange(3)) + parts[: rng.randrange(3, len(parts) + 1)]
            if rng.random() < 0.7:
                del text[rng.randrange(len(text))]
        tokens = [w.encode() for w in text]
        found = {}
        for i, state, held in m.statistics(tokens):
            if held >= licenses.MIN_MATCH:
                m._anchor(found, i, state, held, tokens[i + 1] if i + 1 < len(tokens) else None)
        spans = m.scan(tokens)[1]
        for t, (label, template) in enumerate(m.templates):
            expected = brute_anchors(tokens, template)
            assert set(found.get(t, [])) == expected
            cover, mine = brute_cover(expected), [s for s in spans if s[1] == t]
            assert bool(mine) == (cover >= licenses.MIN_COVER * len(template))
            assert not mine or mine[0][4] == cover / len(template)
            assert all(a[3] < b[2] or b[3] < a[2] for x, a in enumerate(mine) for b in mine[x + 1 :])


def test_licence_rows_against_brute_force(spark):
    rng = random.Random(1)
    mit = " ".join(licenses.TEMPLATES["mit"][2].split())
    lgpl = "public licence as published by the free software foundation either version 3 of the licence".replace("licence", "license")
    rows = [(1, None), (1, "no licence"), (None, "MIT License, mit-license MIT  license general public license"), (3, mit.replace("merge, publish, distribute, sublicense", "sell").upper())]
    rows += [(4, "x " * 500 + mit + " y" * 20), (5, mit[: len(mit) // 3]), (6, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General " + lgpl)]
    rows += [(10 + k, " ".join(rng.choices(["mit", "license", "apache", "general", "public", "é", "x-1"], k=60))) for k in range(30)]
    labels = {}
    for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect():
        text = next(t for i, t in rows if i == r.doc_id and (i != 1 or len(t or "") == (10 if r.n_words else 0)))
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
        places = [(i, name) for phrase, name in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({n for _, n in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        labels[r.doc_id] = r.labels
    assert (labels[3], labels[4], labels[5]) == ("mit", "mit", "mit") and "lgpl" in labels[6]


CLASHING = "key string, n int, kept boolean, size long, takes string, words int, position double, score double, ids string, n_pieces int, component_id long, node long, digest binary, comp long, source_size long, rank int, of_source string"


def test_pipeline_stages_keep_clashing_columns_null_ids_and_repeats(spark):
    rng = random.Random(4)
    text = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    a, b = text(60), text(60)
    base = [(1, a), (1, a), (2, a + " "), (None, b), (None, text(40)), (None, text(40)), (5, b + " more"), (6, None), (7, ""), (8, text(4)), (9, " " * 3000 + text(9))]
    rows = [(i, t, "en", f"s{k % 2}" if k % 5 else None, k, *([None] * 17)) for k, (i, t) in enumerate(base)]
    rows += rows[:1]  # a row that is equal in every column
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    kept = materialize(exact_stage := corpus_pipeline.STAGES[1][1](spark, docs, ""))
    assert exact_stage.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, None, None, None, 5, 6, 8, 9]))
    near = materialize(corpus_pipeline.STAGES[2][1](spark, kept, ""))
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == sorted(map(str, [2, None, None, 5, 6, 8, 9]))
    mixed = materialize(corpus_pipeline.STAGES[3][1](spark, near, ""))
    assert mixed.columns == docs.columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()
    assert len(last) == mixed.count() and len({r.position for r in last}) == len(last)
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(mixed) - words(near)) <= 3


def test_answers_are_derived_rightly():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 4000, 300))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(200, len(base) + 1)], rng.integers(0, 4000, rng.integers(0, 60))])) for _ in range(70)]
    sets += [np.zeros(0, np.int64), np.array([3999]), base]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    count = np.array([len(s) for s in sets])
    answers = jaccard.Answers(flat, np.cumsum(count) - count, count)
    for x in [*range(len(sets)), 3, 0]:
        assert answers.of(x).tolist() == [len(np.intersect1d(sets[x], s)) for s in sets]
    assert len(answers.known) <= jaccard.ANSWERS


def test_sets_that_share_an_id_are_told_apart(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:7], "", None])], DOCS)
    grams = jaccard.Grams()
    grams.shared = frozenset({jaccard.node_id(grams.sets(*utf8(pa.array([texts[0]])))[0])})
    nodes = {r.doc_id: r.node for r in jaccard.document_nodes(docs, grams).collect()}
    assert nodes[0] == nodes[40] not in grams.shared and len(set(nodes.values())) == 41
    plain = jaccard._digest
    try:
        jaccard._digest = lambda raw, seed: plain(raw, seed) % 4096  # in this process: the loop itself
        known = frozenset()
        for _ in range(50):
            ids = [jaccard.node_id(grams.sets(*utf8(pa.array([t])))[0], known) for t in texts]
            twice = frozenset(i for i in ids if ids.count(i) > 1)
            if not twice:
                break
            known |= twice
        else:
            ids = []
        assert not ids or len(set(ids)) == len(texts)
    finally:
        jaccard._digest = plain


def test_one_id_with_two_texts_and_null_ids_in_the_join(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " x"), (None, b + " x"), (None, a), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("5", 36, 5), ("5", 36, 5), ("7", 37, 5), ("None", 37, 5), ("None", 36, 5), ("9", 0, 9)])


def test_placing_keeps_clashing_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "mine", 7), (1, "mine", 7), (None, None, None)], "slot long, shard string, x int")
    got = sharding.place(docs, "slot", ["a", "b", "c"], 101).collect()
    assert sorted((str(r.input_slot), str(r.input_shard), str(r.x)) for r in got) == [("1", "mine", "7"), ("1", "mine", "7"), ("None", "None", "None")]
    assert len({r.slot for r in got if r.input_slot}) == 1 and all(r.shard_name in "abc" for r in got)


def test_placing_finds_free_names(spark):
    docs = spark.createDataFrame([(1, 2, "x")], "slot long, input_slot long, shard_name string")
    got = sharding.place(docs, "slot", ["a", "b"], 101).first().asDict()
    assert (got["input_input_slot"], got["input_slot"], got["input_shard_name"]) == (1, 2, "x") and got["shard_name"] in "ab"


def test_rows_of_one_id_are_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 500)
    seen = []
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df: seen.append(keep(df)) or seen[-1])
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("w "), F.greatest(F.lit(0), F.col("id") % 40 - 20).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 7 % 2).alias("source"))
    got = mixing.assign(docs).agg(F.sum("taken").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    largest = next(df for df in seen if "slice" in df.columns).groupBy("rank", "slice").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * mixing.SLICE_ROWS and got.rows == 20_000  # of 20,000 rows with the null id
    assert abs(got.n - 500 * sum(range(20))) <= 2


def test_many_labels_in_bounded_memory(spark):
    import resource

    rng, names = random.Random(6), [f"l{k:03d}" for k in range(300)]
    letters = {name: rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for name in names}
    words = lambda name, n: " ".join("".join(rng.choices(letters[name], k=6)) for _ in range(n))
    model = language.fit(spark.createDataFrame([(words(name, 200), name) for name in names], "text string, lang string"))
    assert model.names == names and model.logs.shape == (300, 1 << language.BITS) and model.bytes_of(1 << 20) == (1 << 20) * 8 // 300
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = words("l007", 40_000).encode()  # 280 KB: run by run with this many labels
    share, n = model.mixtures(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert names[int(share[0].argmax())] == "l007" and n.tolist() == [40_000]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB; all words at once took 96 MB an array
