"""Closure groups after rows were added, against a full run over all rows."""

import random

from benthos.operators import splits as P


def test_grown_groups_are_those_of_a_full_run(spark):
    rnd = random.Random(2)
    rows = [(i, f"s{rnd.randrange(150)}", [f"t{rnd.randrange(400)}" for _ in range(rnd.randint(0, 2))], "W") for i in range(300)]
    rows += [(900 + i, None, [], "W") for i in range(3)] + [(5 + 1000, "s1", [], "M")]
    rnd.shuffle(rows)
    schema = "r int, source string, tests array<string>, route string"
    full = {x.r: x.group_id for x in P.closure_groups(spark.createDataFrame(rows, schema), "r", ["source"], ["tests"], scope="route").collect()}
    old, new = spark.createDataFrame(rows[:220], schema), spark.createDataFrame(rows[220:], schema)
    keys = lambda df: P.shared_keys(df, "r", ["source"], ["tests"], scope="route")
    groups = P.closure_groups(old, "r", ["source"], ["tests"], scope="route")
    known = keys(old).join(groups, "r").select("x", "group_id").distinct()
    before = {x.r: x.group_id for x in groups.collect()}
    part = {g: ["train", "test"][g % 2] for g in set(before.values())}
    got = P.grow_groups(known, keys(new), new.select("r"), spark.createDataFrame(list(part.items()), "group_id int, part string"))
    renamed = {x.old_id: x.group_id for x in got["renamed"].collect()}
    after = {r: renamed.get(g, g) for r, g in before.items()} | {x.r: x.group_id for x in got["labels"].collect()}
    assert after == full
    # groups that no new row touches are not named anywhere
    touched = {before[r] for r in before} & {g for g in before.values() if full[g] != g}
    assert set(renamed) == touched and 0 < len(renamed) < len(set(before.values()))
    joined = {x.group_id: (x.old_ids, x.parts) for x in got["joined"].collect()}
    want = {}
    for r, g in before.items():
        want.setdefault(full[r], set()).add(g)
    want = {c: (sorted(g), ["test", "train"]) for c, g in want.items() if len({part[x] for x in g}) > 1}
    assert joined == want and joined
    # the keys that are added make the next step possible
    again = known.join(got["renamed"].withColumnRenamed("group_id", "to"), known["group_id"] == got["renamed"]["old_id"], "left").selectExpr("x", "coalesce(to, group_id) AS group_id").unionByName(got["keys"]).distinct()
    assert {(x.x, x.group_id) for x in again.collect()} == {(x.x, full[x.r]) for x in keys(spark.createDataFrame(rows, schema)).collect()}


def test_new_rows_that_touch_nothing(spark):
    schema = "r int, source string, tests array<string>"
    old, new = spark.createDataFrame([(1, "a", [])], schema), spark.createDataFrame([(2, "b", ["x"]), (3, None, ["x"]), (4, None, [])], schema)
    keys = lambda df: P.shared_keys(df, "r", ["source"], ["tests"])
    known = keys(old).selectExpr("x", "r AS group_id")
    got = P.grow_groups(known, keys(new), new.select("r"))
    assert {x.r: x.group_id for x in got["labels"].collect()} == {2: 2, 3: 2, 4: 4} and got["renamed"].count() == 0
    got = P.grow_groups(known, keys(new.where("false")), new.select("r").where("false"))
    assert got["labels"].count() == got["renamed"].count() == got["keys"].count() == 0
