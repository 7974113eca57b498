"""Loaders and parsers on files as projects have them."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codestrata.functions import display
from codestrata.operators import releases
from codestrata.plans import instructions, parsed_queries
from codestrata.sources import coverage, layers, registry, repository, specs, vectors


def files(spark, content):
    return spark.createDataFrame([("r", p, t) for p, t in content.items()], "repo string, path string, content string")


def test_source_tree(spark, tmp_path):
    for path, text in {"a.go": "x\ny\n", "sub/b.py": "z", "node_modules/c.js": "no", "big.txt": "x" * 100}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = repository.files(spark, str(tmp_path), "r", max_bytes=50)
    assert {r.path: r.content for r in found.collect()} == {"a.go": "x\ny\n", "sub/b.py": "z"}
    assert [r.path for r in repository.files(spark, str(tmp_path), extensions=("py", "js")).collect()] == ["sub/b.py"]
    assert [(r.path, r.line_no, r.line) for r in repository.lines(found).orderBy("path", "line_no").collect()] == [("a.go", 1, "x"), ("a.go", 2, "y"), ("sub/b.py", 1, "z")]


def test_log(spark):
    rows = lambda text: [(r.sha, r.file) for r in repository.parse_log(spark.createDataFrame([("r", text)], "repo string, content string")).collect()]
    assert sorted(rows("COMMIT:abc123\nfile_a.go\nfile_b.go\n\nCOMMIT:def456\nfile_a.go\n")) == [("abc123", "file_a.go"), ("abc123", "file_b.go"), ("def456", "file_a.go")]
    assert rows("") == [] and rows("lost\nCOMMIT:x\n") == [("x", None)]


def test_name_status(spark):
    text = "COMMIT:s1\x1fann\x1f2026-01-02T03:04:05Z\x1ffeat!: x\x1fbody\nmore\x1e\nA\ta.rs\nD\tb.rs\nR090\told.rs\tnew.rs\nC75\tc\td\n"
    commits, touched = repository.parse_name_status(spark.createDataFrame([("r", text)], "repo string, content string"))
    c = commits.first()
    assert (c.sha, c.author, c.subject, c.body, c.authored_at.year) == ("s1", "ann", "feat!: x", "body\nmore", 2026)
    assert sorted((r.file, r.status, r.renamed_from) for r in touched.collect()) == [("a.rs", "A", None), ("b.rs", "D", None), ("new.rs", "R", "old.rs")]
    names = repository.current_names(spark.createDataFrame([("a", "b"), ("b", "c")], "renamed_from string, file string"))
    assert {r.old: r.new for r in names.collect()} == {"a": "c", "b": "c"}


def test_siblings_and_sections(spark, tmp_path):
    for p in ("one/.git", "group/two/.git", "plain"):
        os.makedirs(tmp_path / p)
    assert [n for n, _ in repository.sibling_repos(str(tmp_path))] == ["one", "two"]
    found = files(spark, {"02-conventions/naming.md": "n", "01-topology/INDEX.md": "i", "01-topology/a.md": "a", "meta/x.md": "m"})
    assert {(r.number, r.name, r.file) for r in repository.sections(found).collect()} == {(2, "conventions", "naming.md"), (1, "topology", "INDEX.md")}


def test_coverage_reports(spark):
    lcov = coverage.lcov(files(spark, {"lcov.info": "SF:src/foo.rs\nDA:1,1\nDA:2,0\nDA:3,1\nDA:4,0\nDA:5,0\nend_of_record\nSF:b\nDA:1,3\nend_of_record\n"}))
    assert sorted((r.path, r.line, r.hits) for r in lcov.collect()) == [("b", 1, 3), ("src/foo.rs", 1, 1), ("src/foo.rs", 2, 0), ("src/foo.rs", 3, 1), ("src/foo.rs", 4, 0), ("src/foo.rs", 5, 0)]
    jest = json.dumps({"total": {"lines": {"total": 20, "covered": 16, "pct": 80}}, "a.js": {"lines": {"total": 10, "covered": 9, "pct": 90}}, "b.js": {"lines": {"total": 10, "covered": 7, "pct": 70}}})
    assert {r.path: r.percent for r in coverage.jest_summary(files(spark, {"coverage-summary.json": jest})).collect()} == {"a.js": 90.0, "b.js": 70.0}
    go = coverage.go_profile(files(spark, {"cover.out": "mode: set\nm/foo.go:1.1,3.2 2 1\nm/foo.go:5.1,6.2 1 0\nm/bar.go:1.1,2.2 1 1\n"}))
    assert sorted((r.path, r.line, r.hits) for r in go.collect()) == [("m/bar.go", 1, 1), ("m/foo.go", 1, 1), ("m/foo.go", 5, 0)]
    xml = '<coverage><class name="A" filename="a.py"><methods><line number="1" hits="2"/></methods><lines><line number="2" hits="0"/></lines></class></coverage>'
    assert sorted((r.path, r.line, r.hits) for r in coverage.cobertura(files(spark, {"coverage.xml": xml})).collect()) == [("a.py", 1, 2), ("a.py", 2, 0)]


def test_specs(spark):
    yaml = "openapi: 3.0.0\npaths:\n  /users:\n    get:\n      operationId: listUsers\n      tags: [a]\n    post: {}\n  /x:\n    delete:\n      summary: s\n"
    got = specs.openapi(files(spark, {"openapi.yaml": yaml, "docs/swagger.json": '{"paths": {"/j": {"get": {}}}}', "api.yaml": "[broken", "other.yaml": yaml}))
    assert sorted((r.method, r.path, r.operation_id) for r in got.collect() if r.path != "/j") == [("DELETE", "/x", None), ("GET", "/users", "listUsers"), ("POST", "/users", None)]
    proto = 'syntax = "proto3";\npackage demo;\nservice Greeter {\n  rpc Hello (Req) returns (Rep) {}\n  rpc Feed (Req) returns (stream Rep);\n}\nmessage Req {}\n'
    got = specs.protobuf(files(spark, {"a.proto": proto})).collect()
    assert {(r.package, r.service, r.rpc, r.streaming) for r in got} == {("demo", "Greeter", "Hello", "Unary"), ("demo", "Greeter", "Feed", "ServerStream")}
    sdl = "type Query {\n  users: [User]\n  user(id: ID): User\n}\ntype Mutation {\n  add(x: CreateUserInput): User\n}\ntype User { id: ID }\ninput CreateUserInput { n: Int }\n"
    got = specs.graphql(files(spark, {"s.graphql": sdl})).collect()
    assert sorted((r.kind, r.name) for r in got) == [("input", "CreateUserInput"), ("operation", "add"), ("operation", "user"), ("operation", "users"), ("type", "User")]


def test_ci(spark):
    content = {
        ".github/workflows/ci.yml": "on: [push, pull_request]\njobs:\n  a:\n    runs-on: ubuntu\n    steps:\n      - uses: x@v1\n      - run: make all\n  b:\n    name: Bee\n",
        ".gitlab-ci.yml": "stages: [t]\n.hidden: {}\nbuild:\n  script: [a, b]\ntest:\n  stage: t\n  script: [c]\n",
        "Jenkinsfile": "stage('Build') {\nstage('Test') {\nstage(\"Deploy\") {\n",
    }
    jobs = specs.ci_jobs(files(spark, content))
    rows = jobs.collect()
    assert sorted((r.provider, r.job) for r in rows) == [("github", "Bee"), ("github", "a"), ("gitlab", "build"), ("gitlab", "test"), ("jenkins", "Build"), ("jenkins", "Deploy"), ("jenkins", "Test")]
    assert next(r.steps for r in rows if r.job == "a") == ["uses: x@v1", "run: make all"]
    flags = specs.trigger_flags(jobs).first()
    assert flags.on_push and flags.on_pull_request and flags.on_manual and not flags.on_schedule


def test_registry(spark, tmp_path):
    os.makedirs(tmp_path / "code/one/.git")
    for name in ("repos.yaml", "repos.json"):
        known = registry.Registry(str(tmp_path / name))
        assert known.scan(str(tmp_path / "code"), register=True)[0][0] == "one"
        with pytest.raises(ValueError, match="one"):
            known.register(str(tmp_path / "code/one"))
        known.register("/nowhere", "two", tags=("x",))
        known.save()
        again = registry.Registry(str(tmp_path / name))
        assert {(r.name, r.present) for r in again.table(spark).collect()} == {("one", True), ("two", False)}
        assert again.scan(str(tmp_path / "code")) == []
        again.remove("two")
        with pytest.raises(KeyError):
            again.remove("two")


def test_git_reader(spark, tmp_path):
    """A small history with a branch, a merge, a rename and two tags, read by git itself."""
    import subprocess

    def git(*args):
        identity = ["-c", "user.name=ann", "-c", "user.email=ann@example.org", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
        return subprocess.run(["git", "-C", str(tmp_path), *identity, *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(name, text, message):
        (tmp_path / name).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", message)
        return git("rev-parse", "HEAD")

    with pytest.raises(FileNotFoundError):
        repository.git_tags(spark, str(tmp_path))
    git("init", "-q")
    first = commit("a.rs", "one\ntwo\nthree\n", "feat!: start\n\nCOMMIT is a word here")
    git("tag", "v1.0.0")
    git("checkout", "-q", "-b", "side")
    side = commit("s p.rs", "x", "fix: side")
    git("checkout", "-q", "main")
    git("mv", "a.rs", "b.rs")
    moved = commit("c.rs", "y", "refactor: move")
    git("merge", "-q", "--no-ff", "side", "-m", "merge side")
    merge = git("rev-parse", "HEAD")
    git("tag", "-a", "v1.1.0", "-m", "annotated")
    last = commit("d.rs", "z", "chore: more")
    git("checkout", "-q", "--orphan", "lost")
    lost = commit("e.rs", "z", "lost")
    git("checkout", "-q", "main")
    commits, touched = repository.git_log(spark, str(tmp_path), "r")
    assert {(r.sha, r.subject) for r in commits.collect()} == {(first, "feat!: start"), (side, "fix: side"), (moved, "refactor: move"), (merge, "merge side"), (last, "chore: more")}
    got = {(r.sha, r.file, r.status, r.renamed_from) for r in touched.collect()}
    assert got == {(first, "a.rs", "A", None), (side, "s p.rs", "A", None), (moved, "b.rs", "R", "a.rs"), (moved, "c.rs", "A", None), (last, "d.rs", "A", None)}
    assert [r.sha for r in repository.git_log(spark, str(tmp_path), "r", revisions="v1.1.0..HEAD")[0].collect()] == [last]
    assert merge not in {r.sha for r in repository.git_log(spark, str(tmp_path), merges=False)[0].collect()}
    tags = repository.git_tags(spark, str(tmp_path), "r")
    assert {(r.tag, r.sha) for r in tags.collect()} == {("v1.0.0", first), ("v1.1.0", merge)}
    found = releases.reachable_release(repository.git_parents(spark, str(tmp_path), "r"), tags)
    assert {r.sha: r.tag for r in found.collect()} == {first: "v1.0.0", side: "v1.1.0", moved: "v1.1.0", merge: "v1.1.0", last: None, lost: None}


def test_messages(spark):
    text = "message A {\n  message B { string message = 1; }\n}\n// message C\nmessages x\n"
    assert sorted(r.message for r in specs.messages(files(spark, {"a.proto": text, "b.txt": text})).collect()) == ["A", "B"]


def test_jacoco_without_a_package(spark):
    xml = '<report><package name=""><sourcefile name="A.java"><line nr="3" mi="1" ci="0"/><line nr="x"/></sourcefile></package><package name="p/q"><sourcefile name="B.java"/></package></report>'
    assert [(r.path, r.line, r.hits) for r in coverage.jacoco(files(spark, {"jacoco.xml": xml})).collect()] == [("A.java", 3, 0)]


def test_layers(tmp_path):
    layer = tmp_path / "layer"
    (layer / "01-topology").mkdir(parents=True)
    (layer / "01-topology/INDEX.md").write_text("old")
    (layer / "gone.md").write_text("g")
    with pytest.raises(FileNotFoundError):
        layers.rollback(str(layer))
    name = layers.snapshot(str(layer), "pre-execute-x", at=0)
    (layer / "01-topology/INDEX.md").write_text("new")
    (layer / "gone.md").unlink()
    (layer / "more.md").write_text("m")
    assert layers.changes(str(layer)) == {"01-topology/INDEX.md": "revert", "gone.md": "restore", "more.md": "remove"}
    assert layers.rollback(str(layer), name, at=60) == name and layers.changes(str(layer), name) == {}
    assert (layer / "01-topology/INDEX.md").read_text() == "old" and not (layer / "more.md").exists()
    assert layers.snapshots(str(layer)) == ["1970-01-01T00-01-00-before-rollback", "1970-01-01T00-00-00-pre-execute-x"]
    layers.rollback(str(layer), at=120)  # back to the state before
    assert (layer / "more.md").read_text() == "m"
    phase = "uninitialized"
    for to in ("discovered", "planning", "awaiting_approval", "executing", "paused", "executing", "done", "planning"):
        phase = layers.advance(phase, to)
    with pytest.raises(ValueError, match="done"):
        layers.advance("planning", "done")
    assert set(layers.NEXT) == set(layers.PHASES)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "id int, v array<float>")
    raw = vectors.to_bytes(rows, "v")
    assert [bytes(r.v) if r.v is not None else None for r in raw.orderBy("id").collect()] == [b"\x00\x00\x80?\x00\x00 \xc0", b"", None]
    assert [r.v for r in vectors.from_bytes(raw, "v").orderBy("id").collect()] == [[1.0, -2.5], [], None]
    assert vectors.from_bytes(spark.createDataFrame([(bytearray(b"abc"),)], "v binary"), "v").first().v is None


def test_instructions(spark, tmp_path):
    facts = {"Stacks": spark.createDataFrame([("r", "Rust")], "repo string, stack string")}
    for tool, names in instructions.TOOLS.items():
        assert instructions.write(tool, "demo", facts, str(tmp_path)) == [str(tmp_path / n) for n in names]
    assert "| r | Rust |" in (tmp_path / "AGENTS.md").read_text() and (tmp_path / ".cursor/rules/project-context.mdc").read_text().startswith("---\n")


def test_display(spark):
    df = spark.createDataFrame([("a", 5, 10), ("bb", 20, 10), ("c", -1, 0)], "name string, v int, most int")
    assert [r[0] for r in df.select(display.bar(df.v, df.most, 4)).collect()] == ["██░░", "████", "░░░░"]
    assert display.terminal_table(df).splitlines() == ["name   v  most", "----  --  ----", "a      5    10", "bb    20    10", "c     -1     0"]
    assert display.badge("x", "ok", colour=False) == "[x]" and "31m" in display.badge("x", "critical")


def test_yaml_that_is_json(monkeypatch):
    import yaml

    slow = yaml.safe_load
    for text in ('{"a": 1e5}', '{"a": NaN, "b": "NaN"}', '{"a": 1.50, "on": [true, null]}', ' {"x": {"y": "é"}}', "{a: 1}", '{"a": 1,}', "a: b"):
        assert specs._load("x.yml", text) == slow(text)
    monkeypatch.setattr(yaml, "safe_load", None)
    assert specs._load(".gitlab-ci.yml", '{"j1": {"script": ["make"]}}') == {"j1": {"script": ["make"]}}
    content = "{" + ",".join(f'"j{i}": {{"script": [1]}}' for i in range(20_000)) + "}"
    frame = pd.DataFrame({"repo": ["r"], "path": [".gitlab-ci.yml"], "content": [content]})
    sizes = [len(f) for f in specs._each(specs._ci, ["repo", "file", "provider", "triggers", "job", "runs_on", "steps_count", "steps"])(iter([frame]))]
    assert sum(sizes) == 20_000 and max(sizes) <= specs.ROWS


def test_a_log_row_holds_one_commit(spark, monkeypatch):
    seen, parse = [], repository.parse_name_status
    monkeypatch.setattr(parsed_queries.repository, "parse_name_status", lambda logs: seen.append(logs) or parse(logs))
    parsed_queries.log_status(spark, "/root/testdata/sf0.001")
    most = seen[0].agg(F.max(F.regexp_count("content", F.lit("(?m)^COMMIT:")))).first()[0]
    assert most == 1  # all commits of a repository in one row grow without bound
