"""Operators against plain Python over many random small cases.

Each test packs its cases into one table, the case number being part of every key,
so one Spark job checks them all.
"""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from tidemark.functions.times import ntz
from tidemark.operators import dims, readiness, recon, sync
from tidemark.operators.dedupe import dedupe_latest

CASES = 150
T0 = datetime(2024, 1, 1)


def last_first(value, reverse):
    """Sort key: by value in the given direction, None last."""
    return (value is None, 0 if value is None else (-value if reverse else value))


def test_dedupe(spark):
    rng = random.Random(1)
    rows = [(case, rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]))
            for case in range(CASES) for _ in range(rng.randint(0, 8))]
    df = spark.createDataFrame(rows, "case INT, k STRING, ts INT, v INT").repartition(5)
    for ascending in (False, True):
        best = {}
        for row in rows:
            rank = (last_first(row[2], not ascending), last_first(row[3], False))
            if row[:2] not in best or rank < best[row[:2]][0]:
                best[row[:2]] = (rank, row)
        found = dedupe_latest(df, ["case", "k"], "ts", ascending=ascending).collect()
        assert Counter(map(tuple, found)) == Counter(row for _, row in best.values())


def test_upsert(spark):
    rng = random.Random(2)

    def side():
        return {(case, k): (rng.choice([None, "N", "A"]), rng.choice([None, "U", "E"]),
                            rng.randint(0, 9))
                for case in range(CASES) for k in "abcd" if rng.random() < 0.6}

    target, source = side(), side()
    expected = {}
    for key in target.keys() | source.keys():
        old, new = target.get(key), source.get(key)
        taken = old is None or (new is not None and old[:2] != new[:2])
        expected[key] = (*(new if taken else old), datetime(2024, 2, 1) if taken else T0)
    ddl = "case INT, k STRING, s STRING, c STRING, n INT"
    left = spark.createDataFrame([(*k, *v) for k, v in target.items()], ddl)
    right = spark.createDataFrame([(*k, *v) for k, v in source.items()], ddl)
    out = dims.upsert(left.withColumn("dw_updated_at", ntz(T0)), right, ["case", "k"],
                      ["s", "c"], ntz("2024-02-01"))
    assert {(r.case, r.k): (r.s, r.c, r.n, r.dw_updated_at) for r in out.collect()} == expected


def test_latest_wins_in_any_order_of_batches(spark):
    rng = random.Random(3)
    rows = [(case, rng.choice("ab"), rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 3))
            for case in range(CASES) for _ in range(rng.randint(1, 9))]
    ddl = "case INT, k STRING, ts INT, v INT, batch INT"
    df = spark.createDataFrame(rows, ddl)

    def through(batches):
        current = None
        for number in batches:
            batch = dedupe_latest(df.filter(f"batch = {number}").drop("batch"), ["case", "k"],
                                  "ts", ["v"])
            current = batch if current is None \
                else dims.upsert_latest(current, batch, ["case", "k"], "ts")
        return {(r.case, r.k): r.ts for r in current.collect()}

    latest = defaultdict(int)
    for case, k, ts, _, _ in rows:
        latest[case, k] = max(latest[case, k], ts)
    assert through([0, 1, 2, 3]) == through([3, 1, 0, 2, 1]) == latest


def test_differences(spark):
    rng = random.Random(4)

    def side():
        return [(case, rng.choice(["a", "b", None]), rng.choice([None, 1, 2]),
                 rng.choice([None, "x", "y"])) for case in range(CASES)
                for _ in range(rng.randint(0, 4))]

    legacy, target = side(), side()
    left, right = defaultdict(list), defaultdict(list)
    for rows, by_key in ((legacy, left), (target, right)):
        for row in rows:
            by_key[row[:2]].append(row[2:])
    expected = Counter()
    for key in left.keys() | right.keys():
        old, new = left[key], right[key]
        if len(old) > 1 or len(new) > 1:
            expected[(*key, "duplicate_key", str(len(old)), str(len(new)))] += 1
        elif not new:
            expected[(*key, "missing_in_target", "present", None)] += 1
        elif not old:
            expected[(*key, "missing_in_legacy", None, "present")] += 1
        else:
            for name, a, b in zip("vw", old[0], new[0]):
                if a != b:
                    expected[(*key, name, None if a is None else str(a),
                              None if b is None else str(b))] += 1
    ddl = "case INT, k STRING, v INT, w STRING"
    found = recon.differences(spark.createDataFrame(legacy, ddl),
                              spark.createDataFrame(target, ddl), ["case", "k"], ["v", "w"])
    assert Counter(map(tuple, found.collect())) == expected


def test_differences_of_fixed_width_values(spark):
    rng = random.Random(8)

    def side():
        return {(case, k): (rng.choice([None, 1, 2]), rng.choice([None, True, False]),
                            rng.choice([None, T0, T0 + timedelta(days=1)]))
                for case in range(CASES) for k in "abc" if rng.random() < 0.8}

    legacy, target = side(), side()
    expected = {(*key, name) for key in legacy.keys() & target.keys()
                for name, a, b in zip("vwt", legacy[key], target[key]) if a != b}
    expected |= {(*key, "missing_in_target") for key in legacy.keys() - target.keys()}
    expected |= {(*key, "missing_in_legacy") for key in target.keys() - legacy.keys()}
    ddl = "case INT, k STRING, v INT, w BOOLEAN, t TIMESTAMP_NTZ"
    found = recon.differences(
        *[spark.createDataFrame([(*k, *v) for k, v in rows.items()], ddl)
          for rows in (legacy, target)], ["case", "k"], ["v", "w", "t"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    out = [(r.case, r.k, r.check_name) for r in found.collect()]
    assert len(out) == len(set(out)) and set(out) == expected


def test_streaks_and_readiness(spark):
    rng = random.Random(5)
    rows, streaks, totals = [], {}, {}
    for case in range(CASES):
        history = []
        for day in range(rng.randint(1, 8)):
            outcome = [rng.choices(["PASSED", "FAILED", "SKIPPED"], [8, 1, 1])[0]
                       for _ in range(rng.randint(1, 3))]
            history.append(outcome)
            rows += [(f"c{case}", "prod", f"r{day}", T0 + timedelta(days=day), f"t{i}", status,
                      status == "PASSED") for i, status in enumerate(outcome)]
        clean = [set(outcome) == {"PASSED"} for outcome in history]
        streak = 0
        for ok in reversed(clean):
            if not ok:
                break
            streak += 1
        streaks[f"c{case}"] = streak
        totals[f"c{case}"] = (len(history), sum(clean),
                              sum("SKIPPED" in outcome for outcome in history), clean[-1],
                              len(history[-1]))
    log = spark.createDataFrame(rows, "use_case STRING, env STRING, recon_run_id STRING, "
                                      "started_at TIMESTAMP_NTZ, target_name STRING, "
                                      "status STRING, overall_passed BOOLEAN").repartition(4)
    found = readiness.clean_streak(log).collect()
    assert {r.use_case: r.clean_streak for r in found} == streaks
    found = readiness.readiness(log).collect()
    assert {r.use_case: (r.total_runs, r.clean_runs, r.skipped_runs, r.last_run_clean,
                         r.targets_in_last_run) for r in found} == totals


def test_sync(spark):
    rng = random.Random(6)
    want = {(case, k): rng.choice([None, "", "x", " x", "y"])
            for case in range(CASES) for k in "abc" if rng.random() < 0.6}
    have = {(case, k): (rng.choice([None, "x", "y"]), rng.random() < 0.7)
            for case in range(CASES) for k in "abc" if rng.random() < 0.6}
    expected = {}
    for key in want.keys() | have.keys():
        name = f"{key[0]}-{key[1]}"
        if key not in have:
            expected[name] = "insert"
        elif key in want:
            same = ((want[key] or "").strip() or None) == have[key][0] and have[key][1]
            expected[name] = "unchanged" if same else "update"
        else:
            expected[name] = "deactivate" if have[key][1] else "retired"
    desired = spark.createDataFrame([(f"{c}-{k}", v, True) for (c, k), v in want.items()],
                                    "id STRING, v STRING, is_active BOOLEAN")
    existing = spark.createDataFrame(
        [(f"{c}-{k}", v, on, T0, T0) for (c, k), (v, on) in have.items()],
        "id STRING, v STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ, "
        "updated_at TIMESTAMP_NTZ")
    plan = sync.plan(desired, existing, "id", ["v", "is_active"])
    assert {r.id: r.action for r in plan.collect()} == expected
    after = sync.apply(desired, existing, "id", ["v", "is_active"], ntz("2024-02-01"))
    settled = sync.plan(desired, after, "id", ["v", "is_active"])
    assert {r.action for r in settled.collect()} <= {"unchanged", "retired"}


def test_surrogate_keys(spark):
    rng = random.Random(7)
    names = [f"n{rng.randint(0, 10**6):07}" for _ in range(4000)]
    known = {name: 2 * i + 1 for i, name in enumerate(sorted(set(names[:1500])))}
    incoming = spark.createDataFrame([(n,) for n in names], "id STRING").repartition(7)
    existing = spark.createDataFrame(list(known.items()), "id STRING, k BIGINT")
    fresh = sorted(set(names) - set(known))
    expected = known | {n: max(known.values()) + i for i, n in enumerate(fresh, 1)}
    out = dims.assign_keys(existing, incoming, "id", "k").collect()
    assert Counter((r.id, r.k) for r in out) == Counter((n, expected[n]) for n in names)
