"""SQL scripts, and SQL and Python in a run."""

import pytest

from baseloom.operators.measures import Measure
from baseloom.plans import script
from baseloom.plans.run import Run
from tests.counting import plain


def test_values_and_statements():
    texts = ("5", "-3", "0.5", "01", "1e3", "5.0", "true", "cell_1", "0.50", "1.")
    assert [script.typed(t) for t in texts] == [5, -3, 0.5, "01", "1e3", 5.0, True, "cell_1", "0.50", "1."]
    text = "SELECT ';' AS a; -- one; two\n\n/* ; */ SELECT 2\n;\n-- done;\n"
    assert [(n, s.splitlines()[-1]) for n, s in script.statements(text)] == [(1, "SELECT ';' AS a"), (1, "/* ; */ SELECT 2")]


def test_scripts(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "views.sql").write_text("CREATE OR REPLACE TEMP VIEW deep AS SELECT * FROM counts WHERE n >= least_depth;\n")
    (tmp_path / "note.py").write_text("import pathlib\npathlib.Path(var('out')).write_text(str(spark.table('deep').count()) + var('none', '!'))\n")
    (tmp_path / "main.sql").write_text("CREATE OR REPLACE TEMP VIEW counts AS SELECT * FROM VALUES ('a', 3), ('b', 9) AS t(k, n);\n.read views.sql\n.python note.py\nSELECT k FROM deep;\n")
    said = []
    out = script.run_script(spark, tmp_path / "main.sql", (tmp_path / "lib",), said.append, least_depth="5", out=str(tmp_path / "said"))
    assert [r.k for r in out.collect()] == ["b"] and (tmp_path / "said").read_text() == "1!" and said[-1] == "k\nb"
    whole = script.expanded(tmp_path / "main.sql", (tmp_path / "lib",))
    assert whole.count("VIEW") == 2 and ".python" in whole and ".read" not in whole
    (tmp_path / "bad.sql").write_text("SELECT 1;\n\nSELECT nothing\nFROM nowhere;\n")
    with pytest.raises(script.ScriptError, match="bad.sql, line 3"):
        script.run_script(spark, tmp_path / "bad.sql")
    (tmp_path / "x.sql").write_text(".read y.sql\n")
    (tmp_path / "y.sql").write_text(".read x.sql\n")
    for name, why in (("x.sql", "reads"), ("gone.sql", "no file"), ("odd.sql", "no directive")):
        (tmp_path / "gone.sql").write_text(".read none.sql\n")
        (tmp_path / "odd.sql").write_text(".write none.sql\n")
        with pytest.raises(script.ScriptError, match=why):
            list(script.steps(tmp_path / name))
    with pytest.raises(script.ScriptError, match="variable"):
        script.set_variables(spark, {"a b": 1})


def test_runs(spark, tmp_path):
    rows = plain.hits(5)
    run = Run(spark.createDataFrame(rows, plain.SCHEMA), block="XB", spark=spark).measures(Measure("mCG", methylated="CG", unmethylated="TG"))
    sites = plain.tally(rows, plain.site())
    assert run.sql("SELECT count(*) AS n FROM site_relation WHERE den >= :depth", depth=2).first().n == sum(k[4] == "mCG" and d >= 2 for k, (_, d) in sites.items())
    (tmp_path / "s.sql").write_text("CREATE OR REPLACE TEMP VIEW busy AS SELECT block FROM block_summary WHERE den > most;\n")
    (tmp_path / "p.py").write_text("spark.createDataFrame([(run.sites().count(), var('most'))], 'n bigint, most int').createOrReplaceTempView('told')\n")
    run.read(str(tmp_path / "s.sql"), most=3).python(str(tmp_path / "p.py"))
    assert spark.table("busy").count() > 0 and tuple(spark.table("told").first()) == (sum(k[4] == "mCG" for k in sites), 3)
