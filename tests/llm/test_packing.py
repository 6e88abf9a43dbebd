"""Packing: capacity, whole texts, tightness, balance and odd inputs."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.packing import TIERS, pack_documents, packing_plan, placed


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from([(8, 16, 32, 64), (64,), (4, 64), (32, 64)]))
def test_plan_places_every_part_once_and_fits(sizes, tiers):
    fill, placed = Counter(), Counter()
    for window, pattern, times, at in packing_plan(sizes, 64, tiers):
        assert window in tiers and sum(s * n for s, n in pattern) <= window
        for i in range(times):
            for size, n in pattern:
                fill[(at + i * window) // 64] += size * n
                placed[size] += n
    assert placed == Counter(sizes) and all(v <= 64 for v in fill.values()) and sorted(fill) == list(range(len(fill)))
    least = max(-(-sum(s * n for s, n in sizes.items()) // 64), sum(n for s, n in sizes.items() if s > 32))
    assert len(fill) <= 1.5 * least + 2


def test_tiers_make_the_plan():
    rng = random.Random(1)
    parts = pd.DataFrame({"n_tokens": [min(2048, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(5000)], "row_no": range(5000)})
    parts["n_tokens"] = parts["n_tokens"].clip(upper=2048)
    plans = {t: placed(parts, 2048, t, 16) for t in [TIERS, (2048,), (512, 2048)]}
    assert not plans[TIERS]["container"].equals(plans[(2048,)]["container"]) and not plans[TIERS]["container"].equals(plans[(512, 2048)]["container"])
    for tiers, got in plans.items():
        assert set(got["tier"]) == set(tiers)
        fill = parts["n_tokens"].groupby(got["container"]).sum()
        assert fill.max() <= 2048 and 1 - fill.sum() / (2048 * len(fill)) < 0.001
        steps = parts["n_tokens"].groupby(got["step"]).sum()
        assert steps.max() - steps.min() <= 2 * 2048
        windows = got.groupby("container")["tier"].max().groupby(got.groupby("container")["step"].first()).value_counts().unstack(fill_value=0)
        assert (windows.max() - windows.min() <= 3).all()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, key string, tier int")


def test_documents_are_packed_whole_and_tight(spark):
    texts = [f"word{i} " * (i % 97 + 1) for i in range(600)] + ["x " * 3000, None, "", "   "]
    got = pack_documents(frame(spark, texts).repartition(5), 256, tiers=(64, 128, 256), group_windows=4).collect()
    fill, parts = Counter(), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        if r.n_tokens:
            fill[r.container_id] += r.n_tokens
        else:
            assert r.container_id is None and r.tier is None and r.step_group is None
    assert set(parts) == set(range(len(texts))) and max(fill.values()) <= 256
    assert all(len(p) == 1 or sum(r.n_tokens for r in p) > 256 for p in parts.values())
    assert sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) / (256 * len(fill)) > 0.98
    steps = Counter()
    for r in got:
        if r.n_tokens:
            steps[r.step_group] += r.n_tokens
    assert max(steps.values()) < 1.5 * min(steps.values())
    sliced = pack_documents(frame(spark, texts), 256, tiers=(64, 128, 256), group_windows=4, slice_parts=100).collect()
    fill = Counter()
    for r in sliced:
        fill[r.container_id] += r.n_tokens if r.n_tokens else 0
    assert len(sliced) == len(got) and max(v for k, v in fill.items() if k is not None) <= 256 and sorted(k for k in fill if k is not None) == list(range(len(fill) - 1))


def test_long_text_is_divided_into_full_parts(spark):
    got = sorted(pack_documents(frame(spark, ["a b " * 2000]), 1024, tiers=(1024,)).collect(), key=lambda r: r.part_no)
    assert [r.n_tokens for r in got][:-1] == [1024] * (len(got) - 1) and len({r.container_id for r in got}) == len(got)


def test_empty_table_and_bad_tiers(spark):
    assert pack_documents(frame(spark, [])).count() == 0
    assert pack_documents(frame(spark, [None])).collect()[0].container_id is None
    with pytest.raises(ValueError):
        pack_documents(frame(spark, ["a"]), 4096, tiers=TIERS)


def test_repeated_rows_are_placed_each_time(spark):
    df = frame(spark, ["some text"])
    assert pack_documents(df.union(df)).count() == 2
