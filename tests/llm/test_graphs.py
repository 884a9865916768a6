import random

import pytest

from gleaner.llm import merge_groups, splits
from gleaner.llm.registry import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, name):
    check(spark, QUERIES[name], ORACLES[name], DATA)


def union_find(pairs):
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in at}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_groups_equal_union_find(spark, kind):
    r = random.Random(5)
    pairs = {"random": [(r.randrange(80), r.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 90)]}[kind]
    d = spark.createDataFrame([*pairs, *pairs[:5], (None, 1), (2, None)], "a long, b long")
    got = {x["node"]: x["group"] for x in merge_groups.group_links(d, "a", "b").collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_no_pairs_no_groups(spark):
    assert merge_groups.group_links(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_links_need_both_ends_in_the_image(spark):
    a, b, c = "a" * 32, "b" * 32, "c" * 32
    m = spark.createDataFrame([(a, 1, b.upper()), (b, 1, b), (c, 2, a), (b, None, c), ("None", 1, a), (a, 1, "null")], "iuid string, image_id long, merged_into string")
    assert [tuple(r) for r in merge_groups.merge_links(m).collect()] == [(a, b)]


def test_shared_entities_share_a_split(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "b", "y"), (3, "b", "z"), (4, "c", "x"), (None, "b", "n"), (None, None, "m"), (5, None, "q"), (5, None, "q")]
    d = spark.createDataFrame(rows, "image_id long, iuid string, u string")
    got = splits.assign_splits(d, "image_id", "iuid").collect()
    assert len(got) == len(rows) and all(r["split"] for r in got)
    assert len({r["group_id"] for r in got if r["image_id"] in (1, 2, 3) or r["u"] == "n"}) == 1
    assert splits.assign_splits(d.limit(0), "image_id", "iuid").count() == 0


def test_proportions_hold(spark):
    d = spark.range(20_000).selectExpr("id as image_id", "string(id) as iuid")
    n = {r["split"]: r["count"] for r in splits.assign_splits(d, "image_id", "iuid").groupBy("split").count().collect()}
    assert abs(n["train"] / 20_000 - 0.8) < 0.02 and abs(n["test"] / 20_000 - 0.1) < 0.02
