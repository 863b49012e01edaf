"""Operators over inputs beyond bounds they once had."""

import random

from tessera.operators import clones, findings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_look_at_every_known_name(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    known = sorted({word(rng.randrange(1, 13)) for _ in range(1500)} | {f"a{i:04}-padding-of-the-list" for i in range(1200)} | {"zebra-lint"})
    names = sorted({word(rng.randrange(0, 16)) for _ in range(60)} | {"zebra-lind", "zbr-lint", "far from any of the names"}) + [None, "zebra-lind"]
    got = findings.unknown(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in known], "name string")).collect()
    want = []
    for n in names:
        if n not in known:
            best = min((edits(n, x), x.encode(), x) for x in known) if n is not None else (9,)
            want.append((n, best[2] if best[0] <= 3 else None))
    assert sorted(((r.name, r.suggestion) for r in got), key=repr) == sorted(want, key=repr)
    assert ("zebra-lind", "zebra-lint") in want


def test_statement_runs_have_no_longest_run_of_their_own(spark):
    rows = spark.createDataFrame([("b", i, [f"t{i}"]) for i in range(5)], "block string, pos int, tokens array<string>")
    got = {(r.first, r.last) for r in clones.statement_runs(rows).collect()}
    assert got == {(i, j) for i in range(5) for j in range(i + 1, 5)}
    assert {(r.first, r.last) for r in clones.statement_runs(rows, 2).collect()} == {(i, i + 1) for i in range(4)}
    plan = clones.statement_runs(rows)._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedfollowing" in plan and "9999" not in plan
