from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from stratagrid.llm import mixing as M


def edf(shares):
    total, k, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        i = min((math.ceil((k[i] + 1) * total / s), i) for i, s in enumerate(shares) if math.floor(k[i] * total / s) <= t)[1]
        k[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("shares", [[1], [1, 1], [5, 3, 1], [7, 7, 2, 1, 1, 1], [97, 2, 1]])
def test_period_is_earliest_deadline_first_and_less_than_a_block_off(spark, shares):
    got = M.period_slots(spark, shares)
    assert got == edf(shares)
    for t in range(len(got) + 1):
        for i, s in enumerate(shares):
            assert abs(got[:t].count(i) - t * s / sum(shares)) < 1


def check(rows, shares, block, default=1):
    """rows: (source, mix_slot, mix_order)."""
    n = Counter(s for s, _, _ in rows)
    blocks = {s: -(-c // block) for s, c in n.items()}
    slots = {}
    for s, slot, order in rows:
        assert slots.setdefault(slot, s) == s and order // block == slot
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert len({o for _, _, o in rows}) == len(rows)
    seen, at, base = Counter(), 0, Counter()
    start = 0
    for t in range(len(slots) + 1):
        live = [s for s in blocks if seen[s] < blocks[s]]
        before = [s for s in blocks if base[s] < blocks[s]]
        total = sum(shares.get(s, default) for s in before)
        for s in before:
            assert abs(seen[s] - base[s] - (t - start) * shares.get(s, default) / total) < 1
        if len(live) < len(before):
            start, base = t, Counter(seen)
        if t < len(slots):
            seen[slots[t]] += 1
    del at


@pytest.mark.parametrize(("block", "per"), [(1, 7), (4, 50), (16, 20_000)])
def test_every_prefix_keeps_the_weights(spark, block, per):
    rng = random.Random(block)
    rows = [(i, rng.choice("aaaaabbbcd"), f"t{i}", "x", 7, 8, 9) for i in range(700)] + [(900, None, None, "y", 7, 8, 9), (None, "d", "z", "y", 7, 8, 9), (900, "a", "same", "z", 7, 8, 9), (900, "a", "same", "z", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _rank string, _block int, _before int, _of int").repartition(5)
    shares = {"a": 2, "b": 3, "c": 1}
    mixed = M.mix_sources(docs, shares, block_rows=block, rows_per_range=per, broadcast_slots=0 if block == 4 else 2_000_000)
    got = mixed.collect()
    assert len(got) == len(rows) and Counter(tuple(r)[:7] for r in got) == Counter(rows)
    check([(r["source"] or "", r["mix_slot"], r["mix_order"]) for r in got], shares, block)


def test_layout_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 5 == 0], f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    mixed = M.in_mixed_order(docs, {}, block_rows=2)
    assert mixed.columns == docs.columns
    order = {r["doc_id"]: r["mix_order"] for r in M.mix_sources(docs, {}, block_rows=2).collect()}
    got = [order[r["doc_id"]] for r in mixed.collect()]
    assert got == sorted(order.values())
    assert M.mix_sources(docs.limit(0), {}).collect() == []
    with pytest.raises(ValueError, match="sources"):
        M.mix_sources(docs, {}, max_sources=1)


def test_many_sources_run_out_one_after_the_other(spark):
    rows = [(i, f"s{k}", "w " * 5000 if i == 3 else None) for k in range(25) for i in range(3 + 2 * k)] + [(None, "s1", f"t{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix_sources(docs, {"s3": 5, "s20": 4}, block_rows=2).collect()
    assert len(got) == len(rows)
    check([(r["source"], r["mix_slot"], r["mix_order"]) for r in got], {"s3": 5, "s20": 4}, 2)


def test_shares_are_reduced_and_long_periods_are_quick(spark):
    assert M.period_slots(spark, [600, 400, 200]) == edf([3, 2, 1])
    shares = [3, 333, 1, 333, 997, 3]
    assert M.period_slots(spark, shares) == edf(shares)
    rows = [(i, f"s{i % 7 % 3}", f"t{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix_sources(docs, {"s0": 333_333, "s1": 666_667, "s2": 200_000}, block_rows=1).collect()
    check([(r["source"], r["mix_slot"], r["mix_order"]) for r in got], {"s0": 333_333, "s1": 666_667, "s2": 200_000}, 1)
