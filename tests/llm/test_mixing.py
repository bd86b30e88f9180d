import math

from helpers import SCHEMA, clashing, empty, odd, odd_rows, prose, words

from sparkcomm.llm import mixing


def targets_by_rounds(sizes, weights, share, epochs):
    """Shares by weight; what is over a cap goes to the rest, again and again."""
    total, fixed = share * sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in rest)
        out = {i: left * weights[i] / w for i in rest}
        over = [i for i in rest if out[i] > epochs * sizes[i]]
        if not over:
            return [fixed.get(i, out.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: epochs * sizes[i] for i in over}


def test_targets_equal_resharing_in_rounds(spark):
    for sizes in ([10, 20, 30], [1000, 1, 1], [5] * 7, [0, 100, 3], [1, 2, 4, 8, 16, 32, 64], [7]):
        table = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = [r["target"] for r in mixing.targets(table).orderBy("source").collect()]
        want = targets_by_rounds(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True)), (sizes, got, want)


def test_odd_rows_meet_their_targets(spark):
    got = mixing.plan(clashing(odd(spark))).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in odd_rows())
    by: dict = {}
    for r in got:
        t = by.setdefault(r["source"], [r["target"], r["source_size"], 0])
        t[2] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert sum(x["words"] for x in r["takes"]) == r["taken"] and all(0 <= x["position"] <= 1 for x in r["takes"])
    assert set(by) == {"a", "b", "c", None}
    for target, size, taken in by.values():
        assert abs(taken - target) < 1 and taken <= 2 * size
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_order_does_not_depend_on_partitions(spark):
    docs = odd(spark)
    take = lambda d: sorted(map(repr, mixing.plan(d).collect()))
    assert take(docs) == take(docs.repartition(7))


def test_positions_follow_the_integrated_schedule(spark):
    """Up to any time, the words placed before it are the integral of the source's schedule."""
    docs = spark.createDataFrame([(i, "w " * 10, "en", s, 0) for s in ("a", "b", "c") for i in range(1000 * ord(s), 1000 * ord(s) + 400)], SCHEMA)
    got = mixing.plan(docs).collect()
    for source, (w0, w1) in {"a": (6, 4), "b": (2, 2), "c": (0.5, 1.5)}.items():
        takes = [t for r in got if r["source"] == source for t in r["takes"]]
        total = sum(t["words"] for t in takes)
        for time in (0.1, 0.37, 0.8):
            want = (w0 * time + (w1 - w0) * time**2 / 2) / ((w0 + w1) / 2)
            assert abs(sum(t["words"] for t in takes if t["position"] <= time) / total - want) < 0.01


def test_piecewise_schedules_invert(spark):
    schedule = ((0.0, 1.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))
    from pyspark.sql import functions as F

    got = spark.range(0, 101).select((F.col("id") / 100).alias("q"), mixing.time_of(F.col("id") / 100, schedule).alias("t")).collect()

    def area(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            x = min(max(t - t0, 0), t1 - t0)
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    assert all(abs(area(r["t"]) / area(1.0) - r["q"]) < 1e-6 for r in got)


def test_mixed_rows_come_in_training_order_and_repeat(spark):
    docs = clashing(odd(spark))
    plan = {}
    for r in mixing.plan(docs).collect():
        key = str(r["doc_id"])
        plan[key] = plan.get(key, 0) + sum(2 * t["words"] >= r["size"] for t in r["takes"])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    seen: dict = {}
    for r in out.collect():
        seen[str(r["doc_id"])] = seen.get(str(r["doc_id"]), 0) + 1
    assert seen == {k: n for k, n in plan.items() if n}


def test_curriculum_is_in_training_order(spark):
    docs = clashing(spark.createDataFrame(odd_rows() + [(100 + i, prose(i, 5 + i % 40), "en", "abcd"[i % 4], 0) for i in range(200)], SCHEMA)).drop("position", "take", "takes", "key")
    got = mixing.curriculum(docs).collect()
    assert len(got) == len(odd_rows()) + 200
    order = [(r["position"] is None, r["position"] or 0.0) for r in got]
    assert order == sorted(order) and all((r["position"] is None) == (r["taken"] == 0) for r in got)
    assert all(0 <= r["position"] <= 1 for r in got if r["taken"])
    fading = [r["position"] for r in got if r["source"] == "a" and r["taken"]]
    rising = [r["position"] for r in got if r["source"] == "c" and r["taken"]]
    assert sum(fading) / len(fading) < sum(rising) / len(rising)
