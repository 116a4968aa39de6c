"""Packing against item-by-item best fit; mixing against its targets and caps."""

import os
import random
import time
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing, packing, tokens


def best_fit(sizes, capacity):
    """Item by item: how many containers best fit decreasing opens."""
    free, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(free, s)
        if i < len(free):
            insort(free, free.pop(i) - s)
        else:
            n += 1
            insort(free, capacity - s)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randrange(1, 101), r.randrange(1, 20), 50]) for _ in range(r.randrange(1, 800))]
    moves, bins = packing.plan(Counter(sizes), [100])
    assert bins[:, 1].sum() == best_fit(sizes, 100)
    assert (bins[:, 1] * bins[:, 3]).sum() == sum(sizes) and bins[:, 3].max() <= 100
    # every position has one place: looked up item by item, no container holds more than it may
    order, held = sorted(sizes, reverse=True), Counter()
    for at, size in enumerate(order):
        m = moves[moves[:, 0] <= at][-1]
        held[m[1] + (at - m[0]) // m[2]] += size
    assert set(held) == set(range(bins[:, 1].sum())) and max(held.values()) <= 100


@pytest.mark.parametrize("histogram", [{300: 10**9}, {600: 10**9, 7: 3}, {s: 5_000_000 + s for s in range(1, 4097)}, {s: 1 + s * 7919 % 1000 for s in range(1, 1025)}, {s: 10**12 for s in (1, 2, 3, 500, 1023)}])
def test_moves_dont_grow_with_items(histogram):
    lengths = [256, 1024, 4096]
    began = time.perf_counter()
    moves, bins = packing.plan(histogram, lengths)
    assert time.perf_counter() - began < 1
    assert len(moves) <= len(histogram) * (len(lengths) + 4) * 14
    assert (bins[:, 1] * bins[:, 3]).sum() == sum(s * n for s, n in histogram.items())
    assert len(packing.plan({s: n * 1000 for s, n in histogram.items()}, lengths)[0]) <= len(moves) * 2 + 64


def test_profiles_in_one_pass_are_as_alone(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.randrange(0, 400)) for i in range(500)], "key bigint, tokens bigint")
    both = packing.pack_profiles(df, [("a", 64), ("b", 256)], [32, 64, 256])
    for name, capacity in (("a", 64), ("b", 256)):
        assert sorted(both.filter(F.col("profile") == name).drop("profile").collect()) == sorted(packing.pack(df, capacity, [32, 64, 256]).collect())


def packed(spark, rows, capacity, lengths=None):
    df = spark.createDataFrame(rows, "key bigint, tokens bigint, container string")
    return packing.pack(df.select("key", "tokens"), capacity, lengths).collect()


@pytest.mark.parametrize("lengths", [None, [16, 32, 64]])
def test_pack_is_whole_and_fits(spark, lengths):
    r = random.Random(1)
    sizes = {i: r.choice([0, 7, 7, 7, r.randrange(1, 64), r.randrange(64, 300), 64]) for i in range(300)}
    got = packed(spark, [(k, v, "x") for k, v in sizes.items()] + [(1000, None, "x")], 64, lengths)
    use, length, cover = Counter(), {}, defaultdict(list)
    for x in got:
        use[x.container] += x.n_tokens
        assert length.setdefault(x.container, x.container_tokens) == x.container_tokens
        cover[x.key].append((x.first_token, x.n_tokens, x.piece))
    assert all(use[c] <= length[c] <= 64 for c in use)
    assert set(cover) == {k for k, v in sizes.items() if v}
    for k, parts in cover.items():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == sizes[k]
        assert len(parts) == 1 or sizes[k] > 64
    assert sum(use.values()) / sum(length.values()) > 0.97


def test_pack_edges(spark):
    assert packed(spark, [], 10) == []
    assert [(x.container_tokens, x.n_tokens) for x in packed(spark, [(1, 10, "x")], 10)] == [(10, 10)]
    ties = packed(spark, [(i, 5, "x") for i in range(4)], 10)
    assert Counter(x.container for x in ties) == {0: 2, 1: 2}


SIZES = "key bigint, source string, language string, topic string, tokens bigint"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_mix_meets_shares(spark):
    r = random.Random(2)
    rows = [(i, r.choice("aaaab"), r.choice(["en", "de", None]), r.choice(["x", "y", None]), r.randrange(1, 200)) for i in range(3000)]
    rows += [(9000, None, "en", "x", 50), (9001, "a", "en", "x", 0), (9002, "a", "en", "x", None), (9003, "other", "en", "x", 50)]
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.4, 3), ("m", "gone", 0.1, 2), ("n", "b", 1.0, 2), ("n", "a", None, 2)]
    sizes, t = spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS)
    chosen = mixing.mix(sizes, t).cache()
    assert chosen.filter("key >= 9000").count() == 0
    assert chosen.groupBy("mix_name", "key").count().filter("count > 1").count() == 0
    caps = {(m, s): c for m, s, _, c in targets}
    assert all(x.repeats <= caps[(x.mix_name, x.source)] for x in chosen.collect())
    share = {(x.mix_name, x.source): x.share for x in mixing.shares(chosen, t).collect()}
    assert abs(share[("m", "a")] - 5 / 9) < 0.01 and abs(share[("m", "b")] - 4 / 9) < 0.01 and share[("m", "gone")] == 0 and share[("n", "b")] == 1
    # the scarcer source is used up to its cap
    b = sum(x[4] for x in rows if x[1] == "b")
    assert chosen.filter("mix_name = 'm' and source = 'b'").agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] >= 3 * b * 0.99


def test_rake_keeps_caps_and_sources():
    cells = {("a", "en", 0): 100.0, ("a", "de", 0): 900.0, ("b", "en", 1): 50.0, ("b", "de", 1): 50.0}
    weights, total = mixing.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4})
    by = Counter()
    for k, w in weights.items():
        by[k[0]] += w * cells[k]
        assert w <= {"a": 1, "b": 4}[k[0]] + 1e-9
    assert total == 800 and abs(by["a"] - 400) < 1e-3 and abs(by["b"] - 400) < 1e-3
    assert mixing.rake({}, {"a": 1.0}, {"a": 1}) == ({}, 0.0)


@pytest.mark.parametrize("on_driver", [20_000, 10])
def test_every_topic_keeps_its_share(spark, monkeypatch, on_driver):
    """More topics than 64, of unequal use by source; on the driver or as a table."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", on_driver)
    rows, key = [], 0
    for topic in range(90):
        for source, n in (("a", 8 + topic % 7 * 6), ("b", 8 + (90 - topic) % 5 * 8)):
            for _ in range(n):
                rows.append((key, source, ("en", "de", None)[key % 3], f"topic {topic}" if topic else None, 10 + key % 5))
                key += 1
    t = spark.createDataFrame([("m", "a", 0.7, 4), ("m", "b", 0.3, 4)], TARGETS)
    chosen = mixing.mix(spark.createDataFrame(rows, SIZES), t, size=2.0 * sum(r[4] for r in rows)).collect()
    topic_of, natural, got, by = {r[0]: r[3] for r in rows}, Counter(), Counter(), Counter()
    for r in rows:
        natural[r[3]] += r[4]
    for x in chosen:
        got[topic_of[x.key]] += x.tokens * x.repeats
        by[x.source] += x.tokens * x.repeats
    whole, used = sum(natural.values()), sum(got.values())
    off = [abs(got[k] / used / (natural[k] / whole) - 1) for k in natural]
    assert abs(by["a"] / used - 0.7) < 0.005 and max(x.repeats for x in chosen) <= 4
    assert sum(off) / len(off) < 0.06, sum(off) / len(off)


def test_table_is_raked_as_on_the_driver(spark):
    r = random.Random(5)
    cells = {(s, x, f"t{t}"): float(r.randrange(1, 100)) for s in "abc" for x in ("en", "de") for t in range(80)}
    share, cap = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 3, "c": 5}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, language string, topic string, t double")
    weights, total = mixing.rake(cells, share, cap, 12_000.0, 500)
    got, reached = mixing.rake_table(table, share, cap, 12_000.0)
    got = {(x.source, x.language, x.topic): x.weight for x in got.collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - w) < 0.01 * w for k, w in weights.items())
    assert abs(sum(reached.values()) - total) < 1e-6


def test_mix_edges(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert mixing.mix(spark.createDataFrame([], SIZES), t).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", None, None, 5)], SIZES), spark.createDataFrame([], TARGETS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", None, None, 5), (2, "a", None, None, 5)], SIZES), t).collect()
    assert sorted((x.key, x.repeats) for x in got) == [(1, 1), (2, 1)]


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no tokenizer here")
def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("hello world",), ("a b " * 20000,), ("漢" * 3000,)], "text string")
    got = [r[0] for r in df.select(tokens.token_count(F.col("text"))).collect()]
    assert got[:3] == [0, None, 2] and got[3] > 39000 and got[4] > 3000


@pytest.mark.parametrize("seed", range(20))
def test_changes_bring_nearer(seed):
    """Never worse than the best of no, one or two changes; every size at most once each way."""
    r = random.Random(seed)
    more, less = (sorted({r.randrange(1, 500) for _ in range(r.randrange(0, 9))}) for _ in range(2))
    off = r.uniform(-600, 600)
    got = mixing.best_changes(off, more, less)
    assert len(set(got)) == len(got) and all(t in (more if s > 0 else less) for s, t in got)
    left = abs(off - sum(s * t for s, t in got))
    assert left <= abs(off)
    for s, row in ((1, more), (-1, less)):
        assert all(left <= max(abs(off - s * t), 0.5 + 1e-6) + 1e-6 for t in row)


def test_changes_by_several_documents():
    assert mixing.best_changes(1875.0, [9315], [7000, 400, 41]) == [(1, 9315), (-1, 7000), (-1, 400), (-1, 41)]
    assert mixing.best_changes(0.3, [5], [5]) == []
    assert mixing.best_changes(100.0, [], []) == []


def test_marginals_are_reported(spark):
    rows = [(i, "a" if i % 3 else "b", ["en", "de", None][i % 5 % 3], "x" if i % 2 else "y", 10 + i % 7) for i in range(400)]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], TARGETS)
    got = mixing.marginals(mixing.mix(sizes, targets), sizes, targets).collect()
    assert {(r.marginal, r["class"]) for r in got} == {("language", "en"), ("language", "de"), ("language", None), ("topic", "x"), ("topic", "y")}
    for m in ("language", "topic"):
        assert abs(sum(r.wanted_share for r in got if r.marginal == m) - 1) < 1e-9 and abs(sum(r.share for r in got if r.marginal == m) - 1) < 1e-9
    assert max(abs(r.wanted_share - r.share) for r in got) < 0.06
    assert mixing.marginals(mixing.mix(sizes.limit(0), targets), sizes.limit(0), targets).count() == 0
