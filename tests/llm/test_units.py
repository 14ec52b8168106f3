"""Parts that need no session: hashing, perfect hash, TIFF, automaton, suffix ranks, pieces."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vacantia.llm import exact_dedup, jaccard, language, licenses, mixing, pieces, sharding, suffixes, tiff
from vacantia.llm.common import Hasher, blocks, edges_of, pack, unpack


def block(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return list(blocks([batch], limit=1 << 30))[0] if texts else None


def test_blocks_cover_all_rows_with_nulls_and_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ab", None, "", "é" * 9, "x", "yz"])], ["doc_id", "text"]).slice(1, 5)
    found = [(rows.column(0).to_pylist(), data.tobytes().decode()) for rows, data, _ in blocks([batch], limit=4)]
    assert [i for ids, _ in found for i in ids] == [1, 2, 3, 4, 5]
    assert "".join(t for _, t in found) == "é" * 9 + "xyz"


def test_equal_runs_hash_equally_and_case_folds():
    _, data, offsets = block(["One two ONE", "one"])
    starts, ends, row = edges_of(data != 32, offsets)
    h = Hasher().runs(Hasher().sums(data), starts, ends)
    assert row.tolist() == [0, 0, 0, 1] and h[0] == h[2] == h[3] != h[1]


def test_packed_records_come_back():
    rows = np.zeros(7, np.dtype([("a", "<u8"), ("b", "<i4")]))
    rows["a"], rows["b"] = np.arange(7) * 10**15, -np.arange(7)
    assert (unpack(pack(rows), rows.dtype) == rows).all()
    assert (unpack(pack(rows, {"a": 5}), rows.dtype, {"a": 5})["a"] == rows["a"] % 2**40).all()


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4000])
def test_perfect_hash_is_minimal_and_checks_bytes(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    keys = np.frombuffer(keys.tobytes(), exact_dedup._DIGEST)
    pilots, slots = exact_dedup.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(n))
    by_slot = keys[np.argsort(slots)]
    assert (exact_dedup.lookup_mph(pilots, by_slot, keys) == slots).all()
    strangers = np.frombuffer(rng.integers(0, 256, (500, 32), dtype=np.uint8).tobytes(), exact_dedup._DIGEST)
    assert (exact_dedup.lookup_mph(pilots, by_slot, strangers) == -1).all()


@pytest.mark.parametrize("make", [lambda n: bytes(random.Random(n).choices(range(256), k=n)), lambda n: bytes(random.Random(n).choices(b"ab", k=n)), lambda n: b"z" * n])
@pytest.mark.parametrize("n", [0, 1, 2, 129, 255, 256, 5000, 70000])
def test_codings_round_trip(make, n):
    data = make(n)
    assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


@pytest.mark.parametrize("n", [64, 512, 576, 64 * 513, 64 * 4096, 64 * 4097, 64 * 9000])
def test_tiff_round_trip(n):
    data = bytes(random.Random(n).choices(b"abcdef \n", k=n))
    assert b"".join(p.pixels.tobytes() for p in tiff.read_pages(tiff.write_tiff(data))) == data


def big_endian_page(pixels: np.ndarray, how: int, predictor: int, tile: int | None) -> bytes:
    """A file of one 16-bit RGB page as another program might write it."""
    height, width, samples = pixels.shape
    parts = []
    if tile:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                part = np.zeros((tile, tile, samples), np.uint16)
                cut = pixels[y : y + tile, x : x + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(part)
    else:
        parts = [pixels[y : y + 3] for y in range(0, height, 3)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros((p.shape[0], 1, samples), np.uint16)) for p in parts]
    coded = [tiff.compress(p.astype(">u2").tobytes(), how) for p in parts]
    n, body = len(coded), b"".join(coded)
    starts = np.cumsum([8, *map(len, coded)])[:-1]
    at = 8 + len(body)
    extra_at = at + 2 + 12 * 11 + 4
    arrays = struct.pack(">3H", 16, 16, 16) + b"\0\0" + struct.pack(f">{n}I", *starts) + struct.pack(f">{n}I", *map(len, coded))
    where = (324, 325) if tile else (273, 279)
    shape = [(322, 4, 1, tile), (323, 4, 1, tile)] if tile else [(278, 4, 1, 3), (284, 3, 1, 1)]
    fields = sorted([(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, extra_at), (259, 3, 1, how), (262, 3, 1, 2), (277, 3, 1, 3), (317, 3, 1, predictor), *shape, (where[0], 4, n, extra_at + 8), (where[1], 4, n, extra_at + 8 + 4 * n)])
    out = struct.pack(">H", len(fields))
    for tag, kind, count, value in fields:
        out += struct.pack(">HHI", tag, kind, count) + (struct.pack(">HH", value, 0) if kind == 3 and count == 1 else struct.pack(">I", value))
    return struct.pack(">2sHI", b"MM", 42, at) + body + out + struct.pack(">I", 0) + arrays


@pytest.mark.parametrize("how", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_foreign_files(how, predictor, tile):
    pixels = np.random.default_rng(how).integers(0, 1 << 16, (20, 37, 3)).astype(np.uint16)
    (page,) = tiff.read_pages(big_endian_page(pixels, how, predictor, tile))
    assert (page.pixels == pixels).all() and page.layout == ("tiles" if tile else "strips")


@pytest.mark.parametrize("data", [b"", b"II*\0", b"nothing at all", tiff.write_tiff(b"a" * 640)[:90], tiff.write_tiff(b"a" * 640).replace(b"\x08\x00\x00\x00", b"\xff\xff\xff\x00", 1)])
def test_damaged_files(data):
    with pytest.raises((tiff.BadTiff, struct.error)):
        list(tiff.read_pages(data))


def test_automaton_statistics_against_brute_force():
    rng = random.Random(5)
    templates = {f"t{k}": [" ".join(rng.choices("abcd", k=9))] for k in range(4)}
    m = licenses.automaton(templates, {"a b": "ab", "b": "b"})
    texts = [t for ts in templates.values() for t in ts] + ["a b", "b"]
    for _ in range(60):
        words = rng.choices("abcdx", k=30)
        found = {i: held for i, _, held in m.statistics([w.encode() for w in words])}
        for i in range(30):
            best = max((n for n in range(1, i + 2) if any(f" {' '.join(words[i - n + 1 : i + 1])} " in f" {t} " for t in texts)), default=0)
            assert found.get(i, 0) == best
        base, _ = m.scan([w.encode() for w in words])
        expected = [(i, 0) for i in range(29) if words[i : i + 2] == ["a", "b"]] + [(i, 1) for i in range(30) if words[i] == "b"]
        assert sorted(base) == sorted(expected)


def test_licence_labels():
    m = licenses.automaton()
    base, spans = m.scan(licenses.words("x y\nLicensed under CC BY-NC 4.0. z"))
    assert not base and {s[0] for s in spans} == {"cc-by-nc"}
    base, spans = m.scan(licenses.words("Licensed under the Apache License, Version 2.0. MIT license"))
    assert {m.base[k][0] for _, k in base} == {"apache", "mit"}


def test_least_documents_against_brute_force():
    rng = random.Random(3)
    text = bytes(rng.choices(b"ab", k=40)) * 3 + bytes(rng.choices(b"abc", k=300))
    text = np.frombuffer(text + b"\0" * 50, np.uint8)
    window = np.arange(len(text) - 50)
    doc = np.array([rng.randrange(9) for _ in window])
    raw = text.tobytes()
    best: dict[bytes, int] = {}
    for w, d in zip(window, doc):
        best[raw[w : w + 50]] = min(best.get(raw[w : w + 50], 99), d)
    got = suffixes.least_documents(text, window, doc, np.zeros(len(window), np.int64))
    assert got.tolist() == [best[raw[w : w + 50]] for w in window]


def test_every_residue_is_a_difference_of_the_cover():
    d = suffixes.RESIDUES
    assert {(a - b) % suffixes.COVER for a in d for b in d} == set(range(suffixes.COVER))


@pytest.mark.parametrize("text", ["hello  world", " a\tb\nc", "", "   ", "x\x00y", "日本語 test 🤖", "a" * 300, " " * 40 + "x", "The quick brown fox... jumps!!! over_the dog(){}", "naïve Straße größer ﬁne", "a b  c   d"])
def test_pieces_equal_the_library(text):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    c = pieces.codec()
    (ids,) = c.encode([text])
    assert ids.tolist() == sp.encode(text)
    assert c.decode(ids) == text


def test_pieces_of_random_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    texts = ["".join(rng.choices("aeinorst lmcdAE.,é-\n", k=rng.randrange(400))) for _ in range(300)]
    assert [x.tolist() for x in pieces.codec().encode(texts)] == [sp.encode(t) for t in texts]


def test_suffix_array_against_sorting():
    data = bytes(random.Random(2).choices(b"ab", k=600)) + b"\0" * 8
    order = pieces.suffix_array(np.frombuffer(data, np.uint8), 48)
    keys = [data[i : i + 48].ljust(48, b"\0") for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(600))


def test_targets_fill_up():
    t = mixing.targets([10, 1000, 20, 0], [5, 2, 1, 5])
    assert t[0] == 30 and t[2] == 60 and t[3] == 0 and abs(sum(t) - 1030) < 1e-6


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    counts = np.bincount(table, minlength=10)
    assert counts.max() - counts.min() <= 1
    moved = (sharding.fill(names[:-1], 1009) != table) & (table != 9)
    assert moved.mean() < 0.1
    # brute force: by turns, each shard its first free slot in its own order
    owner = {}
    at = {k: 0 for k in range(10)}
    order = {k: [(sharding._hash(n, "start") + j * (sharding._hash(n, "step") % 1008 + 1)) % 1009 for j in range(1009)] for k, n in enumerate(names)}
    while len(owner) < 1009:
        for k in range(10):
            if len(owner) == 1009:
                break
            while order[k][at[k]] in owner:
                at[k] += 1
            owner[order[k][at[k]]] = k
    assert table.tolist() == [owner[s] for s in range(1009)]


def test_mixture_finds_both_languages():
    rng = random.Random(1)
    a, b = (lambda: "".join(rng.choices("abcde", k=5))), (lambda: "".join(rng.choices("vwxyz", k=5)))
    docs = [(0, " ".join(a() for _ in range(300))), (1, " ".join(b() for _ in range(300)))]
    logs = np.zeros((2, 1 << language.BITS), np.float32)
    for k, t in docs:
        _, data, offsets = block([t])
        code, _, _ = language.word_trigrams(data, offsets)
        count = np.bincount(code, minlength=1 << language.BITS) + 0.5
        logs[k] = np.log(count / count.sum())
    m = language.Model(["a", "b"], logs)
    _, data, offsets = block([" ".join([a() for _ in range(60)] + [b() for _ in range(20)]), "abcde edcba", "1234 !"])
    share, words = m.mixtures(data, offsets)
    assert abs(share[0, 0] - 0.75) < 0.05 and share[1].tolist() == [1.0, 0.0] and words.tolist() == [80, 2, 0]


def test_letters():
    _, data, offsets = block(["", "1 2", "¿ 🤖 …", "é", "日", "x"])
    assert language._has_letter(data, offsets).tolist() == [False, False, False, True, True, True]


def test_shingle_sets():
    g = jaccard.Grams()
    _, data, offsets = block(["a b c d e f", "A  B\tc d e", "a b c d e a b c d e", "a b", "a c", "", "a\nb"])
    gram, cuts = g.sets(data, offsets)
    assert np.diff(cuts).tolist() == [2, 1, 5, 1, 1, 0, 1]
    row = lambda i: set(gram[cuts[i] : cuts[i + 1]].tolist())
    assert row(1) < row(0) and row(1) < row(2) and row(3) == row(6) != row(4)


def test_prefix_and_need():
    g = jaccard.Grams()
    for n in range(1, 60):
        for m in range(n, 60):
            need = min(k for k in range(0, n + m) if 100 * k >= 75 * (n + m - k))
            assert g.need(n, m) == need
            if 100 * n >= 75 * m:  # a link must leave a shared n-gram in both prefixes
                assert g.prefix(n) >= n - need + 1 and g.prefix(m) >= m - need + 1


def test_words_follow_the_contract():
    text = "Ab-cÉ9 _x\x7fy[Z` 12"
    expected = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [w.decode() for w in licenses.words(text)] == expected


def test_payload():
    assert tiff.payload_of(None) == (b"\0" * 64, 0)
    assert tiff.payload_of("é" * 32) == ("é".encode() * 32, 64)
    assert zlib.crc32(tiff.payload_of("a")[0]) == zlib.crc32(b"a" + b"\0" * 63)
