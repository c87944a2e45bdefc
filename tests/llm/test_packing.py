import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronopix.llm import packing
from chronopix.llm.queries import op3_packing, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokeniser(tokenizer, odd_rows):
    encode, r = packing.Encoder(tokenizer_path()), random.Random(1)
    parts = ["a", "b ", " ", "\n", "  ", "é", "'s", "1", "23", "!", "<|endoftext|>", "\t", " \n", "word", "日本", "\x00", "I'll", "\r\n", "😀", "ſ", " ", "'S", "don't"]
    texts = [t[1][:5000] for t in odd_rows if t[1]] + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    for t in texts:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_cut():
    assert packing.cut(1, 10) == [(0, 1)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(21, 10) == [(0, 1), (1, 10), (11, 10)] and packing.cut(0, 10) == []


def brute_price(prices, c):
    table = [0.0] * (c + 1)
    for at in range(1, c + 1):
        table[at] = max([table[at - 1], *(table[at - n] + v for n, v in enumerate(prices[:at], 1) if v > 0)])
    return table[c]


def test_knapsack_is_optimal():
    r = np.random.default_rng(2)
    for _ in range(30):
        prices = r.random(30) * (r.random(30) < 0.4)
        worth, got = packing.knapsack(prices, 30)
        assert sum(got) <= 30 and all(prices[n - 1] > 0 for n in got)
        assert sum(prices[n - 1] for n in got) == pytest.approx(worth) == pytest.approx(brute_price(prices.tolist(), 30))


def histogram(texts):
    encode = packing.Encoder(tokenizer_path())
    return Counter(n for t in texts for _, n in packing.cut(len(encode(t or "")) // 4 + 1, 1024))


def test_configurations_solve_the_program_and_place_nearly_all(spark, sf):
    counts = histogram(r["text"] for r in spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet").select("text").collect())
    need = np.array([counts.get(k, 0) for k in range(1, 1024)] + [0])
    got = packing.cover(need, 1024)
    covered = np.zeros(1024)
    for config, x in got.copies.items():
        assert sum(config) <= 1024
        for n in config:
            covered[n - 1] += x
    assert np.allclose(covered, need) and got.value <= 1.01 * got.bound
    plan, left = packing.rounded(got.copies, need, 1024)
    assert left.min() >= 0 and sum(len(c) * n for c, n in plan.items()) >= 0.9 * need.sum()
    n = sum(k for _, k in packing.solve(counts, 1024))
    assert n <= sum(packing.best_fit(need, 1024).values()) + counts[1024] and n >= got.bound + counts[1024]


def test_the_bound_sees_what_cannot_be_combined():
    need = np.zeros(100, np.int64)
    need[59], need[34] = 50, 10  # sixty and thirty-five go together, sixties do not
    got = packing.cover(need, 100)
    assert got.value == pytest.approx(50) and got.bound == pytest.approx(50, rel=0.01)


def test_grouped_best_fit_is_best_fit():
    from bisect import bisect_left, insort

    r = random.Random(7)
    for _ in range(20):
        need = np.zeros(50, np.int64)
        for _ in range(r.randint(1, 200)):
            need[r.randint(0, 49)] += 1
        gaps, n = [], 0
        for length in range(50, 0, -1):
            for _ in range(need[length - 1]):
                i = bisect_left(gaps, length)
                gap = gaps.pop(i) if i < len(gaps) else 50
                n += gap == 50
                if gap > length:
                    insort(gaps, gap - length)
        plan = packing.best_fit(need, 50)
        used = Counter(x for config, k in plan.items() for x in config for _ in range(k))
        assert used == {k + 1: int(c) for k, c in enumerate(need) if c} and abs(sum(plan.values()) - n) <= 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_exactly_and_closely(seed):
    r = random.Random(seed)
    counts = Counter(min(64, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(r.choice([1, 7, 400, 20_000])))
    plan = packing.solve(counts, 64)
    used = Counter()
    for config, copies in plan:
        assert sum(config) <= 64
        for n in config:
            used[n] += copies
    assert used == counts
    bound = -(-sum(n * k for n, k in counts.items()) // 64)
    assert sum(k for _, k in plan) <= bound * 1.02 + 1
    assert packing.solve({}, 64) == []


def check(rows, texts, tokenizer, capacity=1024):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == capacity or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_round_trip(spark, sf, tokenizer):
    rows = op3_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check(rows, texts, tokenizer)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1


def test_odd_rows_and_empty_table(odd, empty):
    rows = packing.pack(odd, tokenizer_path, bucket_rows=3).collect()
    assert sum(r["piece"] == 0 for r in rows) == 13
    assert len({(r["sequence"], r["offset"]) for r in rows}) == len(rows)
    ones = [r for r in rows if r["id"] in (1, 2)]
    assert all(r["length"] == 1 and r["crc"] == zlib.crc32(np.array([2], "<u4").tobytes()) for r in ones)
    assert packing.pack(empty, tokenizer_path).count() == 0
