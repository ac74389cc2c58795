import itertools

import pytest

from millrace.functions.hashing import rank
from millrace.operators import arms, sampling, splits
from millrace.operators.allocation import allocate
from pyspark.sql import functions as F

#: Pools as sampled corpora have them: one large, one small, some between, ids that don't sort by pool.
POOLS = {"graph": 11, "string": 2, "greedy_search": 26, "geometry": 8}
SCHEMA = "problem_id string, primary_category string, prompt string, response string"
ROWS = [(f"{(i * 37 + n) % 101:03d}/{c}", c, f"task {i}", f"solution {i}") for n, c in enumerate(POOLS) for i in range(POOLS[c])]
SEEDS = (0, 41)
RECIPE = [
    {"name": "everything", "mode": "full"},
    {"name": "control", "mode": "random", "total": 30},
    {"name": "few", "mode": "random", "total": 1},
    {"name": "without_two", "mode": "leave_out", "categories": ["geometry", "string"]},
    {"name": "graph_small", "mode": "single", "categories": ["graph"], "per_category": "minimum"},
    {"name": "graph_five", "mode": "single", "categories": ["graph"], "per_category": 5},
    {"name": "graph_all", "mode": "single", "categories": ["graph"], "per_category": "all"},
    {"name": "pair", "mode": "mixture", "categories": ["graph", "greedy_search"], "per_category": 5},
    {"name": "spread", "mode": "mixture", "categories": ["geometry", "graph", "greedy_search"], "total": 16},
]


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["arm"], set()).add(r["problem_id"])
    return out


def by_category(ids):
    return {c: sum(i.endswith(f"/{c}") for i in ids) for c in POOLS}


@pytest.mark.parametrize("seed", SEEDS)
def test_arms_hold_what_their_recipe_says(pool, seed):
    got = members(arms.build(pool, RECIPE, seed))
    everything = {i for i, *_ in ROWS}
    assert got["everything"] == everything
    assert len(got["control"]) == 30 and len(got["few"]) == 1
    assert by_category(got["without_two"])["geometry"] == by_category(got["without_two"])["string"] == 0
    assert by_category(got["graph_small"]) == {"graph": 2, "string": 0, "greedy_search": 0, "geometry": 0}  # the smallest pool
    assert got["graph_all"] == {i for i in everything if i.endswith("/graph")}
    assert by_category(got["pair"]) == {"graph": 5, "string": 0, "greedy_search": 5, "geometry": 0}
    spread = by_category(got["spread"])
    assert sum(spread.values()) == 16 and spread["string"] == 0
    assert {spread[c] for c in ("geometry", "graph", "greedy_search")} == {5, 6}


def test_one_ranking_a_category_nests_the_arms(pool):
    got = members(arms.build(pool, RECIPE, SEEDS[0]))
    assert got["graph_small"] < got["graph_five"] < got["graph_all"] < got["everything"]
    assert {i for i in got["pair"] if i.endswith("/graph")} == got["graph_five"]


def test_only_the_rows_and_the_seed_decide(spark, pool):
    drawn = [members(arms.build(pool, RECIPE, s)) for s in SEEDS]
    assert drawn[0] != drawn[1]
    dealt = spark.createDataFrame(sorted(ROWS, key=lambda r: r[2]), SCHEMA).repartition(7, "response")
    assert members(arms.build(dealt, RECIPE, SEEDS[1])) == drawn[1]


def test_allocation_is_exact():
    for n in range(1, sum(POOLS.values()) + 1):
        taken = arms.allocation(POOLS, n, 5, True)
        assert sum(taken.values()) == n and all(taken[c] <= POOLS[c] for c in POOLS)
        # no category is further than one row from its share
        assert all(abs(taken[c] * sum(POOLS.values()) - n * POOLS[c]) < sum(POOLS.values()) for c in POOLS)
    even = arms.allocation({"x": 40, "y": 40, "z": 40}, 32, 5, False)
    assert sorted(even.values()) == [10, 11, 11]
    with pytest.raises(ValueError):
        arms.allocation(POOLS, 16, 5, False)  # four each, and one pool has two


def test_table_allocation_agrees_with_the_driver(spark):
    table = spark.createDataFrame(list(POOLS.items()), "category string, size long")
    for n, balanced in itertools.product((3, 8), (True, False)):
        got = {r["category"]: r["take"] for r in allocate(table, "category", n, 9, balanced).collect()}
        assert got == arms.allocation(POOLS, n, 9, not balanced)


BROKEN = {
    "a name that leaves its folder": {"name": "up/../out", "mode": "full"},
    "a reserved name": {"name": "base", "mode": "full"},
    "two categories in a single arm": {"name": "one", "mode": "single", "categories": ["graph", "string"]},
    "more of a category than there is": {"name": "one", "mode": "single", "categories": ["string"], "per_category": 3},
    "two sizes at once": {"name": "mix", "mode": "mixture", "categories": ["graph"], "per_category": 1, "total": 1},
    "an unknown category": {"name": "out", "mode": "leave_out", "categories": ["poetry"]},
    "more rows than the pool": {"name": "all", "mode": "random", "total": 48},
}


@pytest.mark.parametrize("why", list(BROKEN))
def test_bad_recipes(pool, why):
    with pytest.raises(ValueError):
        arms.build(pool, [BROKEN[why]], SEEDS[0])


def test_names_of_arms_are_unique(pool):
    with pytest.raises(ValueError):
        arms.build(pool, [RECIPE[0], RECIPE[0]], SEEDS[0])


def test_guards(spark, pool):
    double = ROWS[3][0]
    with pytest.raises(ValueError, match=double):
        arms.unique_or_raise(pool.union(pool.filter(F.col("problem_id") == double)), "problem_id")
    arms.unique_or_raise(pool, "problem_id")
    parts = [pool.filter(F.col("primary_category") == c) for c in POOLS]
    with pytest.raises(ValueError):
        arms.disjoint_or_raise(parts[0].union(parts[1]), parts[1].limit(1), "problem_id")
    arms.disjoint_or_raise(parts[0], parts[1].union(parts[2]), "problem_id")


def test_equal_size_arms_are_as_large_as_the_pool_without_its_largest_category(pool):
    got = members(arms.equal_size(pool, SEEDS[1], "problem_id", "primary_category"))
    want = sum(POOLS.values()) - max(POOLS.values())
    assert {len(v) for k, v in got.items() if k != "full"} == {want}


def test_stratified_sample_has_exact_size(pool):
    for n in (4, 23):
        got = [r["problem_id"] for r in sampling.stratified(pool, "problem_id", "primary_category", n, SEEDS[0], "check").collect()]
        assert len(got) == len(set(got)) == n


def test_holdout(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("k"))
    forced = spark.createDataFrame([(1,), (2,), (999,)], "id long")
    got = splits.holdout(rows, "id", ["k"], 50, 7, forced)
    split = {r["id"]: r["split"] for r in got.collect()}
    assert len(split) == 200 and sum(v == "validation" for v in split.values()) == 20
    assert split[1] == split[2] == "validation"
    assert {r["split"] for r in splits.holdout(rows.limit(9), "id", ["k"], 50, 7, forced).collect()} == {"train"}
    index = splits.reindexed(got, "split", "id", 7)
    for name, n in (("train", 180), ("validation", 20)):
        assert sorted(r["index"] for r in index.filter(F.col("split") == name).collect()) == list(range(n))


def test_rows_beyond_a_sample_are_not_shuffled(spark):
    df = spark.range(20_000, numPartitions=4).select(F.col("id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").otherwise("c").alias("stratum"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sampling.stratified(df, "id", "stratum", 900, 7, "lines")
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2  # what to take and the last bucket that is needed, a row a stratum
        assert {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()} == {"a": 600, "b": 150, "c": 150}
        bucketed = df.filter("stratum = 'c'").select("id", "stratum", rank(7, "lines", "x", "id").alias("r"), F.lit(150).alias("most"))
        whole, cut = sampling.placed(bucketed, ["stratum"], "r", "id"), sampling.placed(bucketed, ["stratum"], "r", "id", F.col("most"))
        first = [(i + 1, r["id"]) for i, r in enumerate(bucketed.orderBy("r").limit(150).collect())]
        for rows in (whole, cut):
            assert sorted((r["nth"], r["id"]) for r in rows.filter("nth <= most").collect()) == first
        assert cut.count() < 200 < whole.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
