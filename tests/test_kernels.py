import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bytegrain.functions import kernels as K

settings.register_profile("quick", max_examples=60, deadline=None)
settings.load_profile("quick")


@given(st.binary(max_size=300))
def test_measures_by_definition(data):
    n = len(data)
    entropy = 0.0 if n < 16 else -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    assert abs(K.byte_entropy_bits(data) - entropy) < 1e-9
    assert K.repeat_density(data) == (0.0 if n < 2 else sum(a == b for a, b in zip(data, data[1:], strict=False)) / (n - 1))
    assert K.bigram_repeat_proxy(data) == (0.0 if n < 4 else sum(data[i - 1 : i + 1] == data[i - 3 : i - 1] for i in range(3, n)) / (n - 3))
    text = sum(0x21 <= b <= 0x7E or b in b"\t\r\n" for b in data)
    assert K.class_counts(data) == (data.count(0), text, n - text - data.count(0))


def test_floors():
    assert K.byte_entropy_bits(bytes(range(15))) == 0 and abs(K.byte_entropy_bits(bytes(range(16))) - 4) < 1e-12
    assert K.repeat_density(b"a") == 0 and K.repeat_density(b"aa") == 1 and K.bigram_repeat_proxy(b"aaa") == 0 and K.bigram_repeat_proxy(b"aaaa") == 1


def test_caps():
    data = b"a" * K.ENTROPY_CAP + bytes(range(256)) * 4
    assert K.byte_entropy_bits(data) == 0 and K.repeat_density(data) == 1 and K.bigram_repeat_proxy(data) == 1


def test_buckets_are_those_of_the_hash():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    keys = K.bucket(data).tolist()
    hashes = [K.bucket_hash(*data[i : i + 3].tolist()) for i in range(len(keys))]
    assert len(set(zip(keys, hashes, strict=True))) == len(set(keys)) == len(set(hashes))


def test_space_is_not_text_and_rounding():
    assert K.class_counts(b" \x00a\n") == (1, 2, 1)
    assert [K.half_up(x) for x in (0.5, 1.5, 2.4)] == [1, 2, 2]


def test_position_hashes_differ():
    assert len({K.position_hash(b, i) for b in range(64) for i in range(64)}) == 4096
