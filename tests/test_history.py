import random

from cartograph.operators import history

SCHEMA = "ord long, author string, date string, path string, ins long, del long, binary boolean"


def test_churn_dates_and_binary(spark):
    rows = [
        (4, "Kim", "2024-07-09", "oven/bake.rs", 12, 4, False), (5, "Lee", "", "oven/bake.rs", 3, 3, False), (5, "Lee", "", "shop/till.rs", 8, 2, False),
        (6, "Kim", "2024-08-30", "oven/bake.rs", 20, 1, False), (6, "Kim", "2024-08-30", "shop/sign.png", 40, 6, True),
    ]
    c = spark.createDataFrame(rows, SCHEMA)
    got = {r.path: (r.commits, r.insertions, r.deletions, r.first, r.last) for r in history.path_history(c).collect()}
    assert got["oven/bake.rs"] == (3, 35, 8, "2024-08-30", "2024-07-09")
    assert got["shop/sign.png"][:3] == (1, 0, 0)
    dirs = {r.dir: (r.commits, r.insertions) for r in history.dir_history(c).collect()}
    assert dirs == {"oven": (3, 35), "shop": (2, 8)}
    top = {r.path: (r.author, r.share_percent) for r in history.top_author(c).collect()}
    assert top["oven/bake.rs"] == ("Kim", 67)


RENAME = "ord long, pos int, old string, new string"


def folded(spark, changes, renames):
    c = spark.createDataFrame([(o, "A", "", p, 1, 0, False) for o, p in changes], SCHEMA)
    return sorted((r.ord, r.path) for r in history.fold_renames(c, spark.createDataFrame(renames, RENAME)).collect())


def test_chained_renames_fold_onto_the_newest_name(spark):
    got = folded(spark, [(0, "z.rs"), (1, "z.rs"), (2, "y.rs"), (3, "x.rs"), (3, "x.rs")], [(1, 0, "y.rs", "z.rs"), (2, 0, "x.rs", "y.rs")])
    assert got == [(0, "z.rs"), (1, "z.rs"), (2, "z.rs"), (3, "z.rs"), (3, "z.rs")]


def test_a_rename_and_its_revert_end(spark):
    assert folded(spark, [(9, "p"), (4, "q"), (1, "p")], [(2, 0, "q", "p"), (5, 0, "p", "q")]) == [(1, "p"), (4, "p"), (9, "p")]


def test_a_name_used_again_keeps_files_apart(spark):
    renames = [(2, 0, "b", "c"), (5, 0, "a", "b"), (7, 0, "b", "d")]
    assert folded(spark, [(10, "a"), (10, "b"), (6, "b"), (3, "b"), (1, "b")], renames) == [(1, "b"), (3, "c"), (6, "c"), (10, "c"), (10, "d")]


def test_renames_against_a_walk(spark):
    rng = random.Random(8)
    for _ in range(4):
        names = [f"n{i}" for i in range(7)]
        renames = [(o, p, *rng.sample(names, 2)) for o in range(25) for p in range(rng.randrange(3))]
        changes = [(o, rng.choice(names)) for o in range(26) for _ in range(3)]
        to, want = {}, []
        for o in range(26):
            for p in [x for at, x in changes if at == o]:
                while p in to:
                    p = to[p]
                want.append((o, p))
            for _, _, old, new in sorted(r for r in renames if r[0] == o):
                while new in to:
                    new = to[new]
                if new != old:
                    to[old] = new
        assert folded(spark, changes, renames) == sorted(want)


def test_co_change_drops_single_pairs_and_bulk_commits(spark):
    rows = [(i, "A", "", f"{d}/f", 1, 0, False) for i, ds in enumerate((["a", "b"], ["a", "b"], ["a", "c"], ["d", "e", "f"], ["d", "e", "f"])) for d in ds]
    pairs, bulk = history.co_change(spark.createDataFrame(rows, SCHEMA), bulk=2)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2)]
    assert sorted(r.ord for r in bulk.collect()) == [3, 4]


def test_conventions(spark):
    subjects = ["feat(core)!: x #12", "fix: y", "Revert \"fix: y\"", "revert: z", "plain", " ", "feature"]
    r = history.conventions(spark.createDataFrame([(s,) for s in subjects], "subject string")).first()
    assert tuple(r) == (6, 3, 1, 1, 2, 1)
