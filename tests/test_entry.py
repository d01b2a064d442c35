import json
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('lattica.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'bfs_levels' in names and not any(n.startswith('op') or n == 'pipeline' for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_the_corpus_subpackage():
    subprocess.run([sys.executable, "-B", "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "lattica").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_returns_levels(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["v", "val"] and df.count() == 200


def test_cli_build_run_partition_verify(spark, tmp_path, capsys):
    from lattica import cli

    (tmp_path / "edges.txt").write_text("# c\n10 70\n70 500\n500 900\n\n900 10\n")
    graph, out = str(tmp_path / "g"), str(tmp_path / "levels")
    assert cli.main(["build", str(tmp_path / "edges.txt"), graph, "--weight", "synthetic"]) == 0
    assert cli.main(["run", json.dumps({"algorithm": "bfs", "graph": graph, "root": 70, "original_ids": True, "output": out})]) == 0
    lines = sorted(x for f in Path(out).glob("*.csv") for x in f.read_text().split("\n") if x)
    assert lines == ["0 3", "1 0", "2 1", "3 2"]
    for algorithm in ("sssp", "cc", "pagerank"):
        assert cli.main(["run", json.dumps({"algorithm": algorithm, "graph": graph, "iterations": 2, "output": str(tmp_path / algorithm)})]) == 0
    assert cli.main(["partition", graph, str(tmp_path / "p"), "--strategy", "row", "--parts", "2"]) == 0
    assert cli.main(["partition", graph, str(tmp_path / "h"), "--strategy", "hash", "--parts", "2"]) == 0
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "h/edges")).select("src", "dst").collect())) == [(0, 2), (1, 3), (2, 1), (3, 0)]
    assert cli.main(["verify", out, out]) == 0 and cli.main(["verify", out, str(tmp_path / "cc")]) == 1
    assert cli.main(["ping"]) == 0 and "pong" in capsys.readouterr().out
