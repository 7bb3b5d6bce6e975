"""Kernels against plain versions: words, windows, media files, merging, segmenting, budgets."""

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.bpe import ChunkTable, pieces
from lodestone.llm.media import MediaError, box, full_box, pad, read_tracks, samples_of, walk, write_track
from lodestone.llm.minhash import Holders, MinHashParams, linked, links_in, shingle_sets, signatures
from lodestone.llm.substrings import SubstringParams, anchors_of
from lodestone.llm.urls import PLAIN, SEEDS, Segmenter
from lodestone.llm.words import shapes_of, windows, words_of

TEXT = st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\r\x1c é日9.!")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.booleans())
def test_words_are_bytes_split(texts, fold):
    found = words_of(pa.array(texts, pa.string()), fold)
    known = {}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        words = (raw.lower() if fold else raw).split()
        assert found.counts[d] == len(words)
        for w, h in zip(words, found.hash[found.first[d] : found.first[d + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert len(shapes_of(found)) == len(found.hash)


def test_words_longer_than_a_block():
    found = words_of(pa.array(["x" * 700_000 + " y", "y", "x" * 700_000]))
    assert found.counts.tolist() == [2, 1, 1]
    assert found.hash[0] == found.hash[3] and found.hash[1] == found.hash[2]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 35, 50])
def test_windows_depend_on_their_words_alone(size):
    h = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    got, known = windows(h, size), {}
    for i in range(len(h) - size + 1):
        assert known.setdefault(tuple(h[i : i + size].tolist()), got[i]) == got[i]
    assert len(set(known.values())) == len(known)
    assert len(windows(h[: size - 1], size)) == 0


def test_shapes():
    a, b, c = (shapes_of(words_of(pa.array([t]))).tolist() for t in ("Ends!! AB1", "Starts!!! XYZ22", "ends! AB1"))
    assert a == b and a != c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=30), min_size=2, max_size=10), st.integers(2, 5))
def test_links_join_what_brute_force_joins(docs, size):
    params = MinHashParams(shingle=size, percent=50)
    sets = shingle_sets(words_of(pa.array([" ".join(d) for d in docs])), size)
    plain = []
    for d in docs:
        plain.append({tuple(d[i : i + size]) for i in range(len(d) - size + 1)} or ({tuple(d)} if d else set()))
    assert [len(s) for s in sets] == [len(s) for s in plain]
    true = {(i, j) for i in range(len(docs)) for j in range(i) if plain[i] and plain[j] and 100 * len(plain[i] & plain[j]) >= 50 * len(plain[i] | plain[j])}
    ids = [i for i in range(len(docs)) if plain[i]]
    loose = MinHashParams(shingle=size, percent=50, miss=1e-30)  # many hashes: signatures are sure on tiny sets
    got = set(links_in(np.array(ids), signatures([sets[i] for i in ids], loose), [sets[i] for i in ids], loose))
    assert all((j, i) in true for i, j in got)
    assert classes(got, ids) == classes(true, ids)


@pytest.mark.parametrize("keep", [0.85, 0.93, 0.97])
def test_links_of_a_large_group_are_those_of_all_pairs(keep):
    """Many near copies around the threshold: counting over holders gives what merging pairs gives."""
    rng = np.random.default_rng(int(100 * keep))
    base, params = rng.integers(0, 1 << 63, 120).astype(np.uint64), MinHashParams(shingle=3, percent=85)
    sets = [np.empty(0, np.uint64)] * 20
    for _ in range(150):
        changed, own = rng.random(len(base)) > keep, base.copy()
        own[changed] = rng.integers(0, 1 << 63, changed.sum())
        sets.append(np.unique(own))
    signs, ids = signatures(sets, params), np.arange(len(sets))
    holders = Holders(sets)
    for i in (0, 19, 20, 169):
        assert holders.shared(i).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]
    alike = lambda i, j: (signs[i] == signs[j]).mean() >= params.least_agreement
    true = {(j, i) for i in range(len(sets)) for j in range(i) if linked(sets[j], sets[i], params) and alike(i, j)}
    got = set(links_in(ids, signs, sets, params))
    assert got <= true
    assert classes(got, ids.tolist()) == classes(true, ids.tolist())


def classes(links, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_bands_follow_the_allowed_miss():
    assert MinHashParams(percent=85).bands == 25
    for p in (70, 80, 85, 95):
        params = MinHashParams(percent=p)
        assert (1 - (p / 100) ** params.rows) ** params.bands <= params.miss


def test_anchor_is_a_matter_of_the_window():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("abc"), 300)), " ".join(rng.choice(list("abc"), 40)), "a " * 100, "a b", ""]
    texts.append("x " + texts[0][50:400] + " y")
    params = SubstringParams(35, 8)
    found = anchors_of(words_of(pa.array(texts)), params)
    known = {}
    for start, own in zip(found.valid.tolist(), found.own.tolist()):
        offset = int(found.at[own]) - start
        assert 0 <= offset <= 27
        key = tuple(found.words.hash[start : start + 35].tolist())
        assert known.setdefault(key, offset) == offset


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2047, 2048, 2049, 4096, 70_001])
def test_media_round_trip(n):
    raw = os.urandom(n)
    payload = pad(raw)
    assert len(payload) % 64 == 0 and payload and payload[:n] == raw and not any(payload[n:])
    media = write_track(payload)
    (track,) = read_tracks(media)
    assert samples_of(media, track) == payload
    assert (track.codec, track.handler, track.samples) == ("raw ", "soun", len(payload) // 64)
    assert track.seconds == len(payload) / 8000
    at = media.index(b"mdat") + 4
    keys = [(at + 64 * k, at + 64 * k + 64) for k in range(0, track.samples, 16)]
    assert track.key_ranges == keys
    names = [path[-1] for path, _, _ in walk(memoryview(media))]
    assert names[:3] == [b"ftyp", b"mdat", b"moov"] and b"stss" in names


def test_media_of_other_writers():
    """Several tracks, compact sizes, wide offsets, a 64-bit box and a last box that runs to the end."""
    data = b"AABBBCCCC"
    head = box(b"ftyp", b"isom", struct.pack(">I", 1))
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    at = len(head) + 16

    def trak(sizes, chunks, runs, sync=None, bits=8):
        packed = bytes(sizes) if bits == 8 else bytes((a << 4) | b for a, b in zip(sizes[::2], [*sizes[1::2], 0]))
        parts = [
            full_box(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))),
            full_box(b"stz2", bytes([0, 0, 0, bits]), struct.pack(">I", len(sizes)), packed),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box(b"co64", struct.pack(">I", len(chunks)), *(struct.pack(">Q", c) for c in chunks)),
        ]
        if sync is not None:
            parts.append(full_box(b"stss", struct.pack(">I", len(sync)), *(struct.pack(">I", s) for s in sync)))
        media = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, 1200), bytes(4), version=1), full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide")), box(b"minf", box(b"stbl", *parts)))
        return box(b"trak", media)

    moov = b"".join([trak([2, 3], [at], [(1, 2, 1)], [2]), trak([4], [at + 5], [(1, 1, 1)], bits=4)])
    file = head + wide + struct.pack(">I4s", 0, b"moov") + moov
    one, two = read_tracks(file)
    assert (one.codec, one.seconds, one.key_ranges) == ("avc1", 2.0, [(at + 2, at + 5)])
    assert samples_of(file, one) == b"AABBB" and samples_of(file, two) == b"CCCC" and two.key_ranges == [(at + 5, at + 9)]
    assert read_tracks(head) == [] and read_tracks(b"") == []


def test_broken_media():
    media = write_track(pad(b"x" * 200))
    at = media.index(b"stsz") + 12
    for broken in (
        media[:-3],
        media[:at] + struct.pack(">I", 99) + media[at + 4 :],
        media.replace(b"stco", b"xxxx"),
        media.replace(b"stsz", b"free"),
    ):
        with pytest.raises((MediaError, struct.error)):
            read_tracks(broken)


TRICKY = [
    "", " ", "  ", "   a", " a ", "a\nb", "\n", "\t \n", "▁", "▁a ▁▁b", "a▁", "日本語テキスト", "emoji 😀 👨‍👩‍👧 x", "<s></s><unk> <0x0A>",
    "a" * 600, "ab " * 700, "x" * 513 + " " * 40 + "y", " " * 100, "\x00a\x00", "é combining", " nb", "\ufeffx", "\r\n\r\n", "𝔘𝔫𝔦",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def own_ids(texts):
    model = pieces("piece_bpe_32k.model")
    table = ChunkTable(model, lambda ids: ids)
    chunked = [model.chunks(t) for t in texts]
    table.add(chunked)
    return [[i for c in chunks for i in table[c]] for chunks in chunked]


def test_ids_equal_the_library_on_tricky_texts(library):
    for text, ids in zip(TRICKY, own_ids(TRICKY)):
        assert ids == library.encode(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("etaoin shr▁\n<0x>", max_size=80)), max_size=5))
def test_ids_equal_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert own_ids(texts) == [library.encode(t) for t in texts]


def test_long_sequences_equal_the_library(library):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("etaoinshr"), n)) for n in (511, 512, 513, 3000)]
    assert own_ids(texts) == library.encode(texts)


@pytest.mark.parametrize("letters", ["ab", "a", "abc", "etaoinshrdlu", "0123456789", "日本語中文a", "-=_.", "héllöß"])
def test_rounds_of_long_sequences_equal_the_library(library, letters):
    """All places of the lowest rank at once are the library's one merge at a time, overlaps and all."""
    rng = np.random.default_rng(len(letters))
    model = pieces("piece_bpe_32k.model")
    for size in (513, 1024, 1025, 3001):
        text = "".join(rng.choice(list(letters), size))
        assert [i for ids in model.segment(model.chunks(text)) for i in ids] == library.encode(text)
    for size in range(2, 12):  # short ones by the rounds of long ones, too
        text = "".join(rng.choice(list(letters), size))
        assert model._ids(model._merge_long(model._symbols(" " + text))) == library.encode(text)


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_keep_pairs_at_the_threshold(percent):
    """The exact binomial tail of dropping a true pair is under a fifth of that of missing every band."""
    import math

    params = MinHashParams(percent=percent)
    p, n = percent / 100, params.hashes
    dropped = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if k / n < params.least_agreement)
    assert dropped < 1e-7 and dropped + (1 - p**params.rows) ** params.bands < 5e-7


def test_tables_are_emptied_when_full():
    model = pieces("piece_bpe_32k.model")
    table = ChunkTable(model, len, limit=3)
    for text in ("a b c d e", "f g"):
        chunks = model.chunks(text)
        table.add([chunks])
        assert all(c in table for c in chunks)


def test_segmentation_against_all_splits():
    counts = {"cheap": 50, "pills": 40, "pill": 5, "s": 3, "che": 2, "ap": 2, "free": 9, "bets": 8}
    own = Segmenter(counts, 20)

    def cost(words):
        return sum(own.cost.get(w, own.unknown[len(w)]) for w in words)

    def splits(name):
        if not name:
            yield []
        for k in range(1, len(name) + 1):
            for rest in splits(name[k:]):
                yield [name[:k], *rest]

    for name in ("cheappills", "freebets", "xcheap", "pillss", "zq", ""):
        assert cost(own.split(name)) == pytest.approx(min(map(cost, splits(name))))
    assert own.split("cheappills") == ["cheap", "pills"] and own.host_words("www.free-bets.com") == own.split("www") + ["free", "bets"] + own.split("com")
    assert Segmenter({}, 20).split("abc") and "spam" in SEEDS and "com" in PLAIN
