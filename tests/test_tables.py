"""Schema versions of stored tables, the shell, and samples."""

from __future__ import annotations

import pytest

from epochlens import __main__ as shell
from epochlens.functions import extract
from epochlens.operators import stats
from epochlens.session import work_path
from epochlens.sources.tables import Table, load, save


def test_older_rows_are_brought_up_and_newer_ones_refused(spark):
    folder = work_path(spark, "tables-test")
    one = Table("t", {"k": "bigint", "v": "string"})
    two = Table("t", one.columns, [{"n": ("int", "length(v)")}])
    three = Table("t", one.columns, [*two.steps, {"m": ("int", "n + 1"), "f": ("boolean", "NULL")}])
    assert load(spark, folder, one).count() == 0 and load(spark, folder, three).columns == ["k", "v", "n", "m", "f"]
    save(spark.createDataFrame([(1, "ab", "extra")], "k long, v string, extra string"), folder, one)
    save(spark.createDataFrame([(2, None, 7)], "k long, v string, n int"), folder, two)
    save(spark.createDataFrame([(3, "c")], "k long, v string"), folder, one)
    assert sorted(map(tuple, load(spark, folder, three).collect())) == [(1, "ab", 2, 3, None), (2, None, 7, 8, None), (3, "c", 1, 2, None)]
    with pytest.raises(ValueError, match="schema version 2"):
        load(spark, folder, one)


def test_shell(spark, capsys):
    assert shell.main(["list"]) == 0
    assert "daily_study" in capsys.readouterr().out.split()
    assert shell.main(["show", "daily_study"]) == 0
    assert "WITH" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        shell.main(["run", "no such query", "/nowhere"])


def test_recent_trades(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate([9.0, -5.0, 3.0, -4.0, None, 1.0])] + [("b", 1, 2.0)], "k string, t int, net double")
    found = {r["k"]: (r["trades"], r["expectancy"], r["lowest"]) for r in stats.recent_expectancy(rows, ["k"], ["t"], "net", 4).collect()}
    assert found == {"a": (4, pytest.approx(-1.25), -6.0), "b": (1, None, 2.0)}


def test_a_run_is_guarded_by_its_registration():
    text = "window: 20\r\ncosts: 0.5\n"
    import hashlib

    digest = hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()
    document = f"study.yaml is registered with {digest} on 2024-01-01"
    extract.guarded(text, document, "study.yaml")
    for changed, doc in ((text + " ", document), (text, "study.yaml is registered later"), (text, document.replace("study", "other"))):
        with pytest.raises(PermissionError):
            extract.guarded(changed, doc, "study.yaml")
