import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytegrain.config import MODE_TABLE, Profile
from bytegrain.functions.kernels import bucket_hash, class_counts
from bytegrain.operators import codec
from bytegrain.operators.blocks import cut_entry
from bytegrain.operators.codec import compress_entry
from bytegrain.operators.deflate import Bits, build_code, deflate_bytes, distance_symbols, encode_blocks, inflate, length_symbols, limited_lengths, packed
from bytegrain.operators.lz import LAZY_BELOW, LONGEST, WINDOW, Task, Tokens, indexed_positions, tokenize, tokenize_all, tokenize_searches
from bytegrain.operators.plan_entry import Model, model_of
from bytegrain.sources.corpus import noise, recipes

MODES = dict(MODE_TABLE)


def restored(t: Tokens) -> bytes:
    out = bytearray()
    for n, v in zip(t.length.tolist(), t.value.tolist(), strict=True):
        out += out[-v:][:n] if n else bytes([v])
    return bytes(out)


def test_package_merge():
    assert limited_lengths([1, 32, 16, 4, 8, 2, 1], 8) == [6, 1, 2, 4, 3, 5, 6]
    assert max(limited_lengths([1] + [3] * 18, 7)) <= 7


@given(st.lists(st.integers(1, 1000), min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_complete(counts):
    assert sum(2.0**-n for n in limited_lengths(counts, 15)) == 1


def test_symbol_tables():
    symbol, bits, extra = length_symbols()
    assert [symbol[n] for n in (3, 10, 11, 12, 13, 257, 258)] == [257, 264, 265, 265, 266, 284, 285] and bits[257] == 5 and bits[258] == 0 and extra[12] == 1
    symbol, bits, extra = distance_symbols()
    assert [symbol[d] for d in (1, 4, 5, 6, 7, 24577, 32768)] == [0, 3, 4, 4, 5, 29, 29] and extra[32768] == 8191 and bits[32768] == 13


def test_literals_only():
    t = tokenize(bytes(range(200)), 0, 128, 128)
    assert not t.length.any() and len(t) == 200


def test_run_has_a_match_and_matches_do_not_overlap():
    t = tokenize(b"x" * 512, 0, 128, 128)
    assert t.from_window > 0 and (t.length <= t.value)[t.length > 0].all() and restored(t) == b"x" * 512


@given(st.lists(st.sampled_from([b"ab", b"abc", b"x", b"hello ", bytes(5)]), max_size=120), st.integers(1, 32), st.integers(3, 64))
@settings(max_examples=60, deadline=None)
def test_tokens_restore_the_data(parts, chain, nice):
    data = b"".join(parts)
    assert restored(tokenize(data, 0, chain, nice)) == data
    assert inflate(deflate_bytes(data, chain, nice)) == data


def plain_tokens(data, start, chain, nice):
    """A walk over the block that tries the latest `chain` positions of a bucket one by one."""
    buckets = [bucket_hash(*data[i : i + 3]) for i in range(len(data) - 2)]

    def search(at, passed):
        best, far = 2, 0
        if at >= len(buckets):
            return 0, 0
        room = min(LONGEST, len(data) - at)
        for j in [j for j in range(passed - 1, -1, -1) if buckets[j] == buckets[at]][:chain]:
            if at - j > WINDOW or best >= min(nice, room):
                break
            n = 0
            while n < min(room, at - j) and data[j + n] == data[at + n]:
                n += 1
            if n > best:
                best, far = n, at - j
        return (best, far) if far else (0, 0)

    out, at = [], start
    while at < len(data):
        n, far = search(at, at)
        if n and (n >= min(nice, LAZY_BELOW) or search(at + 1, at)[0] <= n):
            out.append((n, far))
            at += n
        else:
            out.append((0, data[at]))
            at += 1
    return out


def listed(t):
    return list(zip(t.length.tolist(), t.value.tolist(), strict=True))


_pieces = st.lists(st.sampled_from([b"a", b"b", b"ab", b"abc", b"\x80bc", b"zbc", b"abcabcd", b"the cat ", b"a\xe2c" * 5]), max_size=60).map(b"".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(_pieces, st.integers(0, 30), st.sampled_from([1, 2, 3, 16, 200]), st.sampled_from([3, 5, 16, 258])), min_size=1, max_size=5))
def test_blocks_side_by_side_match_as_a_plain_walk_does(rows):
    rows = [(data, min(start, len(data)), chain, nice) for data, start, chain, nice in rows]
    got = tokenize_all([Task(*r) for r in rows])
    assert [listed(t) for t in got] == [plain_tokens(*r) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(_pieces, st.integers(1, 2), st.sampled_from([1, 4, 64]), st.booleans()), min_size=1, max_size=4))
def test_indexed_blocks_side_by_side(rows):
    tasks = [Task(data, 0, chain, 16, indexed_positions(np.frombuffer(data, np.uint8), stride) if index else None) for data, stride, chain, index in rows]
    assert [(listed(t), t.from_window, t.from_index) for t in tokenize_all(tasks)] == [(listed(t), t.from_window, t.from_index) for x in tasks for t in tokenize_all([x])]
    assert all(restored(t) == x.data for x, t in zip(tasks, tokenize_all(tasks), strict=True))


def test_encoder_against_zlib():
    data = bytes(i % 251 for i in range(6000))
    assert zlib.decompress(deflate_bytes(data), -15) == data


def test_global_code_over_two_blocks():
    blocks = [tokenize(b"x" * 2000, 0, 64, 64), tokenize(b"x" * 2000 + b"y" * 2000, 2000, 64, 64)]
    assert zlib.decompress(encode_blocks(blocks, global_huffman=True), -15) == b"x" * 2000 + b"y" * 2000
    assert zlib.decompress(encode_blocks(blocks, "Fixed"), -15) == b"x" * 2000 + b"y" * 2000


def test_bits_are_joined_without_padding():
    one, two = Bits(), Bits()
    one.put((1, 1), (0, 0), (2, 2))
    two.put((1, 1), (0x7FFFFFFF, 31), (0, 5), (1, 1))
    assert packed(one) == b"\x05" and packed(one, two) == (5 | 1 << 3 | 0x7FFFFFFF << 4 | 1 << 40).to_bytes(6, "little")


def test_one_distance_and_empty_stream():
    assert inflate(encode_blocks([])) == b""
    code = build_code(np.bincount([256], minlength=286), np.zeros(30, int))
    assert len(code.literal) == 257 and len(code.distance) == 1


def test_broken_streams():
    good = deflate_bytes(b"hello hello hello")
    for bad in (good[:-1], good + b"x", b"\xff\xff"):
        with pytest.raises(ValueError, match="inflate"):
            inflate(bad)
    with pytest.raises(ValueError, match="expected"):
        inflate(good, 3)


def test_cuts_cover_without_gaps():
    p = Profile()
    for data in (b"", b"a" * 32768, b"a" * 32769, noise(100_000, 7) + b"b" * 100_000):
        cuts = cut_entry(data, len(data), 65536, p)
        assert sum(n for _, n in cuts) == len(data) and [a for a, _ in cuts] == [sum(n for _, n in cuts[:i]) for i in range(len(cuts))]
    assert cut_entry(None, 200_000, 65536, p) == [(0, 65536), (65536, 65536), (131072, 65536), (196608, 3392)]
    assert cut_entry(None, 10, 1, p) == [(0, 10)]


def model(files, p):
    return model_of(len(files), sum(map(len, files)), *(sum(x) for x in zip(*(class_counts(f[: p.sample_cap]) for f in files), strict=True)), p, True)


# Payload bytes of a workload in modes m01, m02, m03, m05, m08, m09.
GOLDEN = {
    "wl_01_very_small_text": [4, 27, 4, 4, 4, 4],
    "wl_02_medium_text": [4667, 2996, 4667, 4667, 4667, 4667],
    "wl_04_highly_repetitive": [3555, 3582, 3542, 3555, 3563, 3568],
    "wl_05_mixed_text_numbers": [25851, 17122, 25660, 25887, 25851, 25851],
    "wl_07_csv_like": [19274, 13348, 19459, 19282, 19274, 19274],
    "wl_08_log_like": [24345, 25218, 23709, 25555, 24389, 24345],
    "wl_09_source_like": [2024, 1362, 2024, 2024, 2024, 2024],
    "wl_10_binary_like": [154200, 2076, 154200, 154200, 154200, 154200],
    "wl_12_duplicate_heavy": [26465, 13398, 26465, 26465, 26465, 15820],
    "wl_13_near_duplicate": [1402, 1402, 1402, 1402, 1440, 1402],
    "wl_14_nested_many_small": [935, 1317, 935, 935, 935, 935],
    "wl_16_mixed_combined": [46575, 44046, 46536, 46580, 46575, 46575],
}


@pytest.mark.parametrize("workload", GOLDEN)
def test_golden_sizes(workload):
    files = [c for p, c in sorted(recipes().items()) if p.startswith(workload)]
    got = []
    for prefix in ("m01", "m02", "m03", "m05", "m08", "m09"):
        p = next(x for n, x in MODE_TABLE if n.startswith(prefix))
        m = model(files, p)
        encoded = [compress_entry(f, m, p)[1] for f in files]
        assert all((inflate(e.payload) if e.method == "Deflate" else e.payload) == f and e.crc32 == zlib.crc32(f) for e, f in zip(encoded, files, strict=True))
        got.append(sum(len(e.payload) for e in encoded))
    assert got == GOLDEN[workload]


def test_plainer_method_after_a_failure(monkeypatch):
    from bytegrain.operators import codec

    def broken(*_):
        raise ValueError("no")

    monkeypatch.setattr(codec, "encode_blocks", broken)
    data = b"some text, some text, some text" * 20
    _, e = compress_entry(data, Model(1, len(data)), Profile())
    assert e.method == "Stored" and e.payload == data


@settings(max_examples=60, deadline=None)
@given(_pieces, st.integers(0, 30), st.sampled_from([1, 3, 64]), st.sampled_from([3, 16, 258]))
def test_nearest_by_sorts_finds_what_chains_find(data, start, chain, nice):
    from bytegrain.operators import lz

    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if n < 3:
        return
    eights, room, none, whole = lz._eights(raw), np.minimum(LONGEST, n - np.arange(n)), np.zeros(n, np.int64), np.ones(n - 2, bool)
    wanted, budget, enough = np.arange(n - 2) >= start, np.full(n, chain), np.full(n, nice)
    chains = lz._best(raw, eights, room, lz._candidates(raw, none.astype(np.uint16), whole), wanted, budget, enough)
    assert all((x == y).all() for x, y in zip(lz._nearest(raw, eights, room, none, whole, wanted, budget, enough), chains, strict=True))


def test_profiles_that_search_alike_share_their_matches(monkeypatch):
    """The same payloads as one by one, each block is sorted once, and searched once for its chain and length."""
    text = b"".join(b"line %d of some text, %d\n" % (i, i * i % 977) for i in range(9000))
    contents = [text[:150_000], b"", b"abc " * 100, text[9_000:10_000], bytes(5000)]
    profiles = [Profile(), Profile(global_huffman=True), Profile(adaptive=True), Profile(adaptive=True, global_huffman=True), Profile(mode="Off", strategy="Fixed")]
    model, seen, match = Model(5, sum(map(len, contents)), 200_000, block=32768, chain=64, nice=64, stride=2), [], codec.tokenize_searches
    wanted = [[codec.compress_entry(c, model, p)[1] for p in profiles] for c in contents]
    monkeypatch.setattr(codec, "tokenize_searches", lambda tasks, searches: (seen.extend((t.data, t.start, tuple(s)) for t, s in zip(tasks, searches, strict=True)), match(tasks, searches))[1])
    assert list(codec.compress_each(contents, [(p, model) for p in profiles])) == wanted
    assert len(seen) == len({s[:2] for s in seen}) and all(len(s) == len(set(s)) for _, _, s in seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"ab", b"abc", b"aaaa", b"xyz", b"a"]), max_size=200).map(b"".join)), st.integers(0, 60), st.lists(st.tuples(st.integers(1, 90), st.integers(3, 258)), min_size=1, max_size=4)), min_size=1, max_size=3))
def test_searches_side_by_side_find_what_each_finds(cases):
    found = tokenize_searches([Task(data, min(start, len(data)), 0, 0) for data, start, _ in cases], [s for _, _, s in cases])
    for (data, start, searches), each in zip(cases, found, strict=True):
        for (chain, nice), t in zip(searches, each, strict=True):
            alone = tokenize(data, min(start, len(data)), chain, nice)
            assert np.array_equal(t.length, alone.length) and np.array_equal(t.value, alone.value) and t.from_window == alone.from_window
