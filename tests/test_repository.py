import shutil
import subprocess

import pytest

from cartograph.plans import repository as R
from cartograph.sources import config

FILES = {
    "app/main.py": "from store import db\nimport yaml\n\ndef run():\n    pass\n", "store/db.py": "from app import main\n\nX = 1\n", "lone/x.py": "import gone\n", "requirements.txt": "pyyaml\n", "README.md": "# R\n",
    ".github/workflows/ci.yml": "on: pull_request\njobs:\n  t:\n    runs-on: x\n    steps: [{run: make}]\n", ".gitignore": "*.tmp\n", "a.tmp": "x",
}


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=T", "-c", "user.email=t@e", *args], check=True, capture_output=True)


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_a_run_from_tree_to_bundle_and_back(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    git(tmp_path, "init", "-q"), git(tmp_path, "add", "."), git(tmp_path, "commit", "-qm", "feat: start")
    root = str(tmp_path)
    a = R.analyse(spark, root)
    ids = {r.id for r in a.nodes.collect()}
    assert {"/modules/app", "/modules/store", "/modules/lone", "/references/pypi-pyyaml", "/pipelines/github-workflows-ci-yml-t"} <= ids | {i.replace("/pipelines/ci-t", "/pipelines/github-workflows-ci-yml-t") for i in ids}
    text = R.show(a)
    assert "/modules/app -> /modules/store" in text and "/modules/lone" in text and "unresolved import: 1 of 1 names: python gone ×1" in text
    assert R.verify_bundle(a, root).first().kind == "missing-bundle"
    done = R.write_bundle(a, root, "first map")
    assert done["written"] >= len(ids) + 4 and R.write_bundle(a, root)["written"] == 0
    assert {r.kind for r in R.verify_bundle(a, root).collect()} == set()
    page = tmp_path / R.BUNDLE / "modules/app.md"
    page.write_text(page.read_text().replace("run", "walk"))
    assert {(r.kind, r.page) for r in R.verify_bundle(a, root).collect()} == {("out-of-date", "modules/app.md")}
    assert "Absent" in (tmp_path / R.BUNDLE / "practices.md").read_text() and "first map" in (tmp_path / R.BUNDLE / "log.md").read_text()
    git(tmp_path, "mv", "store", "depot")
    (tmp_path / "app/main.py").write_text(FILES["app/main.py"].replace("store", "depot"))
    git(tmp_path, "add", "."), git(tmp_path, "commit", "-qm", "move")
    nodes, edges, counts = R.compare(spark, root, "HEAD~1", "HEAD")
    assert [(r.id, r.change, r.new_id) for r in nodes.collect()] == [("/modules/store", "renamed", "/modules/depot")]
    assert edges.isEmpty() and counts.first().renamed == 1
    with pytest.raises(ValueError):
        R.compare(spark, root, "nowhere", "HEAD")


def test_a_folder_without_history(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n")
    a = R.analyse(spark, str(tmp_path), config.Config(no_history=True))
    assert [r.id for r in a.nodes.collect()] == ["/modules/root"] and a.commit == "" and a.gaps.isEmpty()
