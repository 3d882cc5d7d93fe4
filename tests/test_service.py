"""A repository from the first index to facts that follow its changes, through the library and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from corvane import __main__ as cli
from corvane.operators import graph, snapshot
from corvane.service import Repository
from corvane.sources import files

FILES = {
    "app/base.py": 'class Base:\n    """Normalises rows."""\n\n    def normalize(self, row):\n        return str(row)\n',
    "app/run.py": "from .base import Base\n\n\nclass Processor(Base):\n    def process(self, row):\n        return self.normalize(row)\n\n\ndef run(rows):\n    worker = Processor()\n    return [worker.process(r) for r in rows]\n",
    "app/__init__.py": "",
    "web/view.ts": "export function render(rows) {\n  return format(rows);\n}\nfunction format(rows) { return rows; }\n",
    "notes.txt": "no code\n",
}


@pytest.fixture(scope="module")
def repository(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return Repository(spark, str(root), str(tmp_path_factory.mktemp("state")))


def run(repository, *argv):
    return cli.answer(repository, cli.parser().parse_args(list(argv)))


def test_from_index_to_facts(spark, repository, tmp_path):
    from pathlib import Path

    first = repository.index()
    assert (first.version, first.files, first.reparsed) == (1, 5, 5)
    again = repository.index()
    assert (again.version, again.reparsed) == (1, 0)
    assert [s["qualname"] for s in run(repository, "find-symbol", "process")] == ["app.run.Processor", "app.run.Processor.process"]
    ids = {s["qualname"]: s["id"] for s in run(repository, "find-symbol", "")}
    assert [(e["source"], e["confidence"]) for e in run(repository, "callers", "normalize") if e["kind"] == "calls"] == [(ids["app.run.Processor.process"], 0.9)]
    assert {e["target"] for e in run(repository, "callees", "render")} == {ids["web.view.format"]}
    found = run(repository, "graph", "format")
    assert {s["qualname"] for s in found["symbols"]} == {"web.view", "web.view.format", "web.view.render"} and len(found["edges"]) == 3
    text = run(repository, "context", "normalize a row", "--budget", "600")
    assert "def normalize(self, row)" in text and "# Why: " in text and "identifier match" in text and len(text.encode()) <= 600
    assert run(repository, "context", "normalize a row", "--budget", "600") == text and run(repository, "context", "normalize a row", "--budget", "0") == ""
    ranked = repository.rank(spark.createDataFrame([(0, "normalize a row"), (1, "render rows for the web")], "query_id long, text string")).orderBy("query_id", "rank").collect()
    best = {q: [r.id for r in ranked if r.query_id == q][:2] for q in (0, 1)}
    assert best[0][0] == ids["app.base.Base.normalize"] and set(best[1]) == {ids["web.view.render"], ids["web.view.format"]}
    alone = repository.rank(spark.createDataFrame([(0, "normalize a row")], "query_id long, text string"), graph_weight=0.0, vectors=False).collect()
    assert alone and all(r.lexical and not r.vector and r.graph_score == 0 for r in alone)

    repository.remember("normalize turns rows into text", [ids["app.base.Base.normalize"]], id="n")
    repository.remember("format does nothing", [ids["web.view.format"]], id="f", confidence=0.5)
    run(repository, "remember", "render is called by nobody", "--anchor", ids["web.view.render"], "--subject", "web")
    with pytest.raises(KeyError):
        repository.remember("of nothing", ["no such symbol"])
    assert [r["fact_id"] for r in run(repository, "recall", "turns rows")][0] == "n" and len(run(repository, "recall")) == 3
    # one symbol changes, one goes, one moves with its text
    root = Path(repository.root)
    (root / "app/base.py").write_text(FILES["app/base.py"].replace("str(row)", "repr(row)"))
    (root / "web/view.ts").write_text("export function render(rows) {\n  return format(rows);\n}\n")
    later = repository.index()
    assert (later.version, later.reparsed) == (2, 2)
    fresh = {r["text"]: r["freshness"] for r in run(repository, "recall")}
    assert fresh == {"normalize turns rows into text": "stale", "format does nothing": "orphaned", "render is called by nobody": "fresh"}
    assert [r["text"] for r in run(repository, "recall", "--fresh")] == ["render is called by nobody"]
    (root / "web/page.ts").write_text((root / "web/view.ts").read_text())
    (root / "web/view.ts").unlink()
    repository.index()
    moved = {r.id: r for r in repository.facts.facts().collect()}
    web = next(r for r in moved.values() if r.subject == "web")
    new = {s["qualname"]: s["id"] for s in run(repository, "find-symbol", "render")}
    assert web.freshness == "fresh" and web.anchors[0].symbol_id == new["web.page.render"]

    # branches on the command line
    run(repository, "memory", "branch", "try")
    run(repository, "memory", "switch", "try")
    run(repository, "forget", "f")
    assert {r["fact_id"] for r in run(repository, "recall")} == {"n", web.id}
    run(repository, "memory", "switch", "main")
    assert set(run(repository, "memory", "branches")) == {"main", "try"} and len(run(repository, "memory", "log")) >= 4
    assert run(repository, "memory", "diff", "main", "try") == [] and run(repository, "status")["version"] == 3
    assert json.dumps(run(repository, "memory", "preview", "try"))


def test_stored_graphs_and_trees_are_checked(spark):
    tree = snapshot.tree_hashes(spark.createDataFrame([("a/b/c", "0" * 64), ("d", "1" * 64)], "path string, digest string")).persist()
    assert snapshot.checked_tree(tree).count() == 3 and snapshot.checked_tree(tree.limit(0)).count() == 0
    for bad in (tree.filter("path <> 'a'"), tree.unionByName(tree.limit(1)), tree.withColumn("digest", F.lit("x")), tree.withColumn("depth", F.col("depth") + 1), tree.filter("path <> ''")):
        with pytest.raises(ValueError):
            snapshot.checked_tree(bad)
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edge = lambda b, c: spark.createDataFrame([("a", b, "calls", c)], "source string, target string, kind string, confidence double")
    assert graph.checked(nodes, edge("b", 0.5))
    for n, e in ((nodes, edge("z", 0.5)), (nodes, edge("b", 1.5)), (nodes, edge("b", float("nan"))), (nodes.union(nodes), edge("b", 0.5))):
        with pytest.raises(ValueError):
            graph.checked(n, e)


def test_data_sets_are_the_published_ones(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a")], "k int, t string")
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    digest = files.checksum(df)
    assert files.checksum(df.orderBy("k").select("t", "k")) == digest != files.checksum(df.distinct())
    assert [r.k for r in files.checked_parquet(spark, str(tmp_path / "d"), 3, ["k"], digest).collect()] == [1, 1, 2]
    for rows, found in ((2, digest), (3, "0" * 64)):
        with pytest.raises(ValueError):
            files.checked_parquet(spark, str(tmp_path / "d"), rows, ["k"], found)


def test_git_head(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "work")
    with pytest.raises(ValueError):
        files.git_head(str(tmp_path))
    git("commit", "-q", "--allow-empty", "-m", "one")
    commit = git("rev-parse", "HEAD")
    assert files.git_head(str(tmp_path)) == ("work", commit)
    git("checkout", "-q", "--detach")
    assert files.git_head(str(tmp_path)) == (None, commit)
