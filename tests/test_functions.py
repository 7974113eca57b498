"""Functions and operators on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths, symbols, syntax
from codestrata.functions import text as T
from codestrata.operators import activity, contracts, evolution, files, graph, knowledge, project, quality, releases, search, summaries
from codestrata.plans import report


def one(spark, column, **values):
    """The value of a column expression on one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("validate_email_format", ["validate", "email", "format"]),
        ("validateEmailFormat", ["validate", "email", "format"]),
        ("ValidateEmailFormat", ["validate", "email", "format"]),
        ("MAX_RETRIES", ["max", "retries"]),
        ("a-b-c-foo", ["foo"]),
        ("http2", ["http", "2"]),
        ("get_the_user", ["user"]),
        ("HTTPServer", ["httpserver"]),
        ("XMLHttp2Request", ["xmlhttp", "2", "request"]),
        ("é", ["é"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == tokens


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("src/tests/a.go", True), ("test/x.py", True), ("a/b_test.go", True), ("x.spec.ts", True), ("a/test_b.py", True),
        ("a/__tests__/b.js", True), ("lib/x_spec.rb", True), ("src/main.go", False), ("src/contest.rs", False), ("latest/a.py", False),
    ],
)
def test_is_test(spark, path, expected):
    assert one(spark, paths.is_test(F.lit(path))) is expected


def test_paths(spark):
    assert one(spark, paths.language(F.lit("a/b.tsx"))) == "typescript"
    assert one(spark, paths.language(F.lit("home/.bashrc"))) == "bash"
    assert one(spark, paths.language(F.lit("README"))) is None
    assert one(spark, paths.excluded(F.lit("web/package-lock.json")))
    assert one(spark, paths.excluded(F.lit("src/target_x.rs")))  # by substring, as the rule says
    assert not one(spark, paths.excluded(F.lit("src/a.rs")))
    assert one(spark, paths.skipped_anywhere(F.lit(".github/x.yml"))) and not one(spark, paths.in_folder(F.lit(".github/x.yml")))
    assert one(spark, paths.matches(F.lit("src/api/x.go"), "src/api")) and one(spark, paths.matches(F.lit("src/api/x.go"), "src/*.go"))


def commits(spark, baskets):
    return spark.createDataFrame([(str(i), f) for i, b in enumerate(baskets) for f in b], "sha string, file string")


def test_pairs_and_clusters(spark):
    found = graph.pairs(commits(spark, [["a.txt", "b.txt"]] * 5 + [["a.txt"]] * 2)).collect()
    assert [(r.file_a, r.file_b, r.shared, r.total_a, r.total_b) for r in found] == [("a.txt", "b.txt", 5, 7, 5)]
    assert found[0].ratio == pytest.approx(5 / 7) and found[0].strength == "moderate" and found[0].confidence_ba == 1.0
    assert graph.pairs(commits(spark, [["a.go", "b.go"]])).count() == 0
    assert graph.pairs(commits(spark, [["a.go", "package-lock.json"]] * 10)).count() == 0
    assert graph.pairs(commits(spark, [["a", "b"]] * 9 + [["a"]])).first().strength == "strong"
    cluster = graph.clusters(graph.pairs(commits(spark, [["a.go", "b.go", "c.go"]] * 10))).collect()
    assert len(cluster) == 1 and cluster[0].files == ["a.go", "b.go", "c.go"] and cluster[0].cohesion == pytest.approx(1.0)


def test_components_match_union_find(spark):
    import random

    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "file_a long, file_b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in {v for e in edges for v in e}}


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, "ValidateEmail src/a.go checks an email by RFC 5322"), (2, "FormatCurrency src/b.go money"), (3, "User src/c.go")], "doc_id long, text string"
    )
    queries = spark.createDataFrame([(1, "validate email"), (2, "currency formatting"), (3, "kubernetes deployment"), (4, ""), (5, "RFC 5322")], "query_id long, text string")
    best = {r.query_id: r.doc_id for r in search.top(search.bm25(docs, queries), 1, "query_id").collect()}
    assert best == {1: 1, 2: 2, 5: 1}
    cos = lambda a, b: one(spark, search.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert cos([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([0.0, 0.0], [1.0, 0.0]) == 0
    assert cos([1.0], [1.0, 2.0]) == 0


def test_ranges_and_coverage(spark):
    lines = spark.createDataFrame([("x", n) for n in (1, 2, 3, 7, 8, 15, 15)], "path string, line int")
    assert sorted((r.start, r.end) for r in quality.ranges(lines).collect()) == [(1, 3), (7, 8), (15, 15)]
    cov = quality.file_coverage(spark.createDataFrame([("f", i, h) for i, h in enumerate((1, 0, 1, 0, 0))], "path string, line int, hits long")).first()
    assert (cov.lines_total, cov.lines_covered, cov.percent) == (5, 2, 40.0)
    assert quality.overall(spark.createDataFrame([], "lines_total long, lines_covered long")).first().percent == 0.0


@pytest.mark.parametrize(("counts", "low", "high"), [((1, 0, 0, 0), 0, 0), ((2, 1, 2, 0), 1.0, 2.0), ((100, 50, 20, 20), 2.0, 2.0)])
def test_flaky_score(spark, counts, low, high):
    row = spark.createDataFrame([counts], "total int, isolated int, suspicious int, reverts int")
    assert low <= quality.score(row).first().score <= high


def endpoint(method, path, op="op", summary="s", tags=("a",), spec="api.yaml"):
    return (method, path, op, summary, list(tags), spec)


SCHEMA = "method string, path string, operation_id string, summary string, tags array<string>, spec_file string"


def test_contract_diff(spark):
    before = spark.createDataFrame([endpoint("get", "/users", "list"), endpoint("GET", "/legacy"), endpoint("GET", "/same", tags=("b", "a"))], SCHEMA)
    after = spark.createDataFrame([endpoint("GET", "/users", "all"), endpoint("GET", "/users/{id}/roles"), endpoint("GET", "/same", tags=("a", "b"))], SCHEMA)
    rows = {(r.path, r.change): (r.fields, r.breaking) for r in contracts.diff(before, after).collect()}
    assert rows == {("/users", "modified"): (["operation_id"], True), ("/legacy", "removed"): ([], True), ("/users/{id}/roles", "added"): ([], False)}
    assert contracts.summary(contracts.diff(before, after)).first()[:] == (3, 2, 1)
    moved = contracts.diff(spark.createDataFrame([endpoint("GET", "/x")], SCHEMA), spark.createDataFrame([endpoint("POST", "/x")], SCHEMA))
    assert sorted((r.change, r.breaking) for r in moved.collect()) == [("added", False), ("removed", True)]


def test_crossref(spark):
    ids = spark.createDataFrame([("listUsers",), ("/users/{id}",), ("/health",), ("ab",), ("nothing",), ("rôle",)], "identifier string")
    texts = ["x = listUsers()", "listUsersFast()", "route('/users/{id}')", "a listUsers", "listUsers;listUsers", "un rôle ici", "fooBar foo", "xrôle"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "path string, line_no int, line string")
    got = {r.identifier: (r.evidence_count, r.status) for r in contracts.crossref(ids, lines).collect()}
    assert got == {
        "listUsers": (3, "IMPLEMENTED"), "/users/{id}": (1, "CANDIDATE"), "/health": (0, "PHANTOM"), "ab": (0, "PHANTOM"),
        "nothing": (0, "PHANTOM"), "rôle": (1, "CANDIDATE"),
    }
    foo = spark.createDataFrame([("foo",)], "identifier string")
    assert contracts.crossref(foo, lines).first().evidence_count == 1
    assert contracts.crossref(foo, lines, all_occurrences=False).first().evidence_count == 0


def test_deprecations(spark):
    rows = [
        ('#[deprecated(since = "0.5.0", note = "use bar")]', "annotation", "0.5.0", "bar", None, "warning"),
        ("// TODO(remove-after: 2026-12-01) x", "todo", None, None, "2026-12-01", "critical"),
        ("/** @deprecated use newThing instead */", "annotation", None, "newThing instead */", None, "warning"),
        ("plain", None, None, None, None, None),
    ]
    lines = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "line_no int, line string")
    got = {r.line_no: (r.marker, r.since, r.replacement, r.remove_after, r.severity) for r in evolution.deprecations(lines).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows) if r[1]}


def test_changelog_and_breaking(spark):
    text = "# C\n## [1.0.0] - 2026-01-01\n### Deprecated\n- old thing one\n- old thing two\n### Added\n- new thing\n### Removed\n- gone thing\n## [0.9.0]\n- loose bullet"
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(text.split("\n"))], "line_no int, line string")
    got = [(r.version, r.section, r.text) for r in evolution.changelog(lines).orderBy("line_no").collect()]
    assert got == [("1.0.0", "deprecated", "old thing one"), ("1.0.0", "deprecated", "old thing two"), ("1.0.0", "removed", "gone thing")]
    kinds = {"x\tBREAKING CHANGE: y": "breaking_change_footer", "feat!: z\t": "conventional_breaking", "Migrate to q\t": "migrate_keyword", "docs: q\t": None}
    for text, kind in kinds.items():
        subject, body = text.split("\t")
        assert one(spark, T.breaking_kind(F.lit(subject), F.lit(body))) == kind
    assert [r.version for r in releases.changelog_versions(lines).collect()] == ["1.0.0", "0.9.0"]
    tags = spark.createDataFrame([("v1.0.0",), ("v2.0.0",)], "tag string")
    assert {r.tag: r.changelog_entry for r in releases.match_changelog(tags, releases.changelog_versions(lines)).collect()} == {"v1.0.0": "1.0.0", "v2.0.0": None}


def test_path_similarity(spark):
    sim = lambda a, b: one(spark, T.path_similarity(F.lit(a), F.lit(b)))
    assert sim("a/auth.rs", "b/auth.rs") == 0.9 and sim("src/old_auth.rs", "src/new_auth.rs") > 0.3 and sim("a/foo.rs", "b/bar.rs") < 0.3


def test_versions(spark):
    for tag, good in {"v1.0.0": True, "1.0.0": True, "v0.8.1": True, "v2.0.0-rc.1": True, "release-2024": False, "hotfix": False}.items():
        assert one(spark, T.is_semver(F.lit(tag))) is good
    assert one(spark, T.version_numbers(F.lit("0.9.0")) < T.version_numbers(F.lit("0.10.0")))
    listed = releases.ordered(spark.createDataFrame([("v0.10.0",), ("v0.9.0",), ("v1.0.0",)], "tag string"))
    assert {r.tag: r.previous_tag for r in listed.collect()} == {"v0.9.0": None, "v0.10.0": "v0.9.0", "v1.0.0": "v0.10.0"}


def test_knowledge(spark):
    for days, factor in ((3, 1.0), (20, 0.95), (60, 0.85), (120, 0.70), (200, 0.50)):
        assert one(spark, knowledge.decay(F.lit(days))) == factor
    aged = knowledge.aged(spark.createDataFrame([(0.95, 200), (0.95, 20)], "initial double, age_days int")).collect()
    assert [r.expired for r in aged] == [True, False]
    stale = {r.section for r in knowledge.stale_sections(spark.createDataFrame([("src/models/a_test.go",)], "path string")).collect()}
    assert {"02-conventions/testing", "05-risks/untested", "01-topology/activity", "04-domain/entities"} <= stale
    assert one(spark, knowledge.category(F.lit("validateEmail"))) == "validation" and one(spark, knowledge.category(F.lit("zzz"))) == "other"
    old, new = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r.path, r.change) for r in knowledge.stale_files(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_activity(spark):
    now = datetime.datetime(2026, 1, 31)
    rows = [("hot", "a", now - datetime.timedelta(days=i % 5)) for i in range(12)] + [("cold", "b", now - datetime.timedelta(days=400))]
    touches = spark.createDataFrame(rows, "path string, author string, at timestamp")
    ref = F.lit(now).cast("timestamp")
    assert {r.path: r.zone for r in activity.zones(touches, ref).collect()} == {"hot": "hot", "cold": "frozen"}
    assert [(r.path, r.creator) for r in activity.orphans(touches, ref).collect()] == [("cold", "b")]
    votes = activity.naming_votes(spark.createDataFrame([("a-b",), ("a_b",), ("c_d",), ("aB",)], "stem string")).first()
    assert (votes.kebab, votes.snake, votes.camel, votes.winner) == (1, 2, 1, "snake")


def test_symbols(spark):
    source = {
        "a.go": "// Adds numbers.\nfunc Add(a int) int {\n}\nfunc (r T) Get() {}\ntype User struct {",
        "b.rs": "/// A point.\npub struct Point;\nimpl Point {\n    fn new() {}\nconst MAX: u8 = 1;",
        "c.ts": "export interface Shape {\nexport const add: Fn = (a) => 1;\nclass Box {",
        "d.py": "class Foo:\n    def bar(self):\n# not a doc\n\ndef baz(x):",
        "e.sh": "function go_on() {\nstop() {",
        "f.txt": "func Nope() {",
    }
    rows = [("r", p, i + 1, line) for p, t in source.items() for i, line in enumerate(t.split("\n"))]
    got = {(r.path, r.name): (r.kind, r.doc) for r in symbols.extract(spark.createDataFrame(rows, "repo string, path string, line_no int, line string")).collect()}
    assert got == {
        ("a.go", "Add"): ("function", "Adds numbers."), ("a.go", "Get"): ("method", None), ("a.go", "User"): ("type", None),
        ("b.rs", "Point"): ("type", "A point."), ("b.rs", "new"): ("function", None), ("b.rs", "MAX"): ("constant", None),
        ("c.ts", "Shape"): ("type", None), ("c.ts", "add"): ("function", None), ("c.ts", "Box"): ("class", None),
        ("d.py", "Foo"): ("class", None), ("d.py", "bar"): ("method", None), ("d.py", "baz"): ("function", None),
        ("e.sh", "go_on"): ("function", None), ("e.sh", "stop"): ("function", None),
    }
    assert one(spark, symbols.identifier_at(F.lit("let fooBar = 1"), F.lit(6))) == "fooBar"


def test_summaries(spark):
    lines = lambda rows: spark.createDataFrame([("s", i, t) for i, t in enumerate(rows)], "source string, line_no int, line string")
    assert summaries.find_by_folder(lines([f"src/f{i}.rs" for i in range(100)])).first()[:2] == ("src", 100)
    assert summaries.grep_by_file(lines([f"src/main.rs:{i}:x" for i in range(50)])).first()[:] == ("src/main.rs", 50)
    assert {r.code: r.files for r in summaries.status_counts(lines([" M a"] * 15 + ["A  b"] * 5 + ["?? c"] * 20)).collect()} == {"M": 15, "A": 5, "??": 20}
    diff = lines(["diff --git a/x b/x", "--- a/x", "+++ b/x", "+1", "+2", "-3", " 4"])
    assert summaries.diff_by_file(diff).first()[:] == ("x", 2, 1)
    assert summaries.log_head(lines([f"c{i}" for i in range(50)])).first().earlier == 35
    assert {r.kind for r in summaries.test_output(lines(["test a FAILED", "error: b", "5 passed"])).collect()} == {"failure", "error", "summary"}


def test_project(spark):
    files = spark.createDataFrame([("r", "Cargo.toml"), ("r", "sub/go.mod"), ("r", "a/b/package.json"), ("r", "src/main.rs")], "repo string, path string")
    found = project.stacks(files)
    assert {r.stack for r in found.collect()} == {"Rust", "Go"}
    assert "cargo test" in {r.command for r in project.commands(found).collect()}
    assert [r.path for r in project.entry_points(files).collect()] == ["src/main.rs"]
    assert [r.path for r in project.tree(files, 1).collect()] == ["Cargo.toml", "a", "src", "sub"]
    for n in range(1, 12):
        text = "aé€😀b"
        assert one(spark, project.cut_bytes(F.lit(text), n)) == text.encode()[:n].decode("utf-8", "ignore")
    docs = spark.createDataFrame([("x.md", "---\nid: 3\ndate: soon\n---\nbody")], "path string, content string")
    errors = {(r.key, r.error) for r in project.frontmatter_errors(docs, {"id": "int", "date": "date", "name": "string"}).collect()}
    assert errors == {("date", "not date"), ("name", "missing")}


def test_project_signs(spark):
    content = {"Cargo.toml": "[workspace]\naxum = 1", "src/main.rs": "", "web/package.json": '{"dependencies": {"jest": "1", "@nestjs/core": "1"}}', "x.zig": "", "conftest.py": ""}
    files = spark.createDataFrame([("r", p, t) for p, t in content.items()], "repo string, path string, content string")
    assert {(r.stack, r.variant) for r in project.variants(files).collect()} == {("Rust", "workspace"), ("Rust", "axum"), ("Rust", "binary"), ("Node", "NestJS")}
    assert [(r.stack, r.confidence) for r in project.stacks_by_extension(files).collect()] == [("Zig", 0.2)]
    assert {r.server for r in project.servers(files).collect()} == {"rust-analyzer", "typescript-language-server"}
    assert {r.framework for r in project.test_framework(files).collect()} == {"cargo test", "jest", "pytest"}
    assert one(spark, project.excerpt(F.lit("---\na: 1\n---\n<!-- c --> Hello"), 3)) == "Hel"
    lines = spark.createDataFrame([("a.rs", 1, "pub fn go() {"), ("a.rs", 2, "fn _no() {"), ("a.rs", 3, "let x")], "path string, line_no int, line string")
    assert [r.name for r in project.sample_symbols(lines).collect()] == ["go"]
    touches = spark.createDataFrame([("a.rs", "ann"), ("a.rs", "bob")], "path string, author string")
    assert project.glance(files, touches)["hot_files"].first()[:] == ("a.rs", 2)


def test_more_summaries(spark):
    lines = lambda rows: spark.createDataFrame([("s", i, t) for i, t in enumerate(rows)], "source string, line_no int, line string")
    assert {(r.name, r.current) for r in summaries.branches(lines(["* main", "  feat/x"])).collect()} == {("main", True), ("feat/x", False)}
    assert [tuple(r) for r in summaries.diff_stat(lines([" src/a.rs | 12 ++--", " 1 file changed"])).collect()] == [("src/a.rs", 12)]
    assert summaries.listing(lines(["total 3", "drwxr-xr-x 2 a", "-rw-r--r-- 1 b", "-rw-r--r-- 1 c"])).first()[:] == (1, 2)
    assert one(spark, summaries.packages(F.lit('{"packages": [{"name": "a", "version": "1"}]}')))[0].name == "a"


def test_index_and_entities(spark, tmp_path):
    docs = spark.createDataFrame([(1, "validate email rfc"), (2, "format currency"), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "email email format")], "query_id long, text string")
    search.write_index(docs, str(tmp_path))
    written = search.search_index(spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/lengths"), queries)
    direct = {r.doc_id: r.score for r in search.bm25(docs, queries).collect()}
    assert {r.doc_id: pytest.approx(r.score) for r in written.collect()} == direct
    items = spark.createDataFrame([(1, "validation", 3, "2026-01-01"), (2, "format", 9, "2026-01-01")], "doc_id long, category string, uses int, changed_at string")
    assert [r.doc_id for r in search.reuse(items, written.select("doc_id", "score"), "format", least=0.0).collect()] == [2, 1]
    eps = spark.createDataFrame([endpoint("GET", "/u", "listU"), endpoint("GET", "/v", None)], SCHEMA)
    rpcs = spark.createDataFrame([("a.proto", "Hello")], "file string, rpc string")
    ops = spark.createDataFrame([("s.gql", "users")], "schema_file string, name string")
    assert {(r.source_kind, r.identifier) for r in contracts.entities(eps, rpcs, ops).collect()} == {("openapi", "listU"), ("openapi", "/v"), ("protobuf", "Hello"), ("graphql", "users")}
    status = spark.createDataFrame([("listU", "IMPLEMENTED")], "identifier string, status string")
    assert {r.path: r.status for r in contracts.with_status(eps, status).collect()} == {"/u": "IMPLEMENTED", "/v": "?"}
    lines = spark.createDataFrame([("// TODO implement x",), ("plain",)], "line string")
    names, log = spark.createDataFrame([("feat/y",), ("main",)], "name string"), spark.createDataFrame([("feat(a): z",), ("fix: q",)], "subject string")
    assert {(r.source, r.text) for r in evolution.intents(lines, names, log).collect()} == {("comment", "// TODO implement x"), ("branch", "feat/y"), ("commit", "feat(a): z")}


def test_hashes(spark):
    table = spark.createDataFrame([("a", "hello world"), ("b", ""), ("c", None), ("d", "é" * 1000)], "path string, content string")
    got = {r.path: (r.hash, r.size_bytes) for r in files.hashes(table).collect()}
    assert got["a"] == ("d447b1ea40e6988b", 11) and got["b"] == ("2d06800538d394c2", 0) and got["d"][1] == 2000 and "c" not in got
    assert files.totals(files.hashes(table)).first() == (3, 2011) and files.totals(files.hashes(table.limit(0))).first() == (0, 0)
    assert {r.path for r in files.hashes(table, method="sha256").collect()} == {"a", "b", "d"}


def test_references(spark):
    lines = spark.createDataFrame([("f", 1, "get get_x get"), ("f", 2, "forget"), ("f", 3, "x.get(get)"), ("f", 4, "éget")], "path string, line_no int, line string")
    assert sorted((r.line_no, r.col) for r in symbols.references(lines, "get").collect()) == [(1, 1), (1, 11), (3, 3), (3, 7), (4, 2)]


def test_crossref_without_ascii_words(spark):
    """Identifiers without a word of ASCII meet lines by their first characters; all against a plain search."""
    import re

    words = ["日本語", "日", "é£é", "->-", "a->-", "éé", "()()", "x y", "語日"]
    text = ["日本語 x", "é£éa", "é£é a->-b", "->- ()()", "日", "語日本語", "x y", "ax y", "éé é£é 語日 日本語é"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, line_no int, line string")
    got = {r.identifier: r.evidence_count for r in contracts.crossref(spark.createDataFrame([(w,) for w in words], "identifier string"), lines).collect()}
    alone = lambda w, t: re.search(r"(?<![A-Za-z0-9_])" + re.escape(w) + r"(?![A-Za-z0-9_])", t)
    assert got == {w: sum(bool(alone(w, t)) for t in text) if len(w.encode()) >= 3 else 0 for w in words}


def test_pairs_lose_nothing(spark):
    """Prefix filtering against counting all pairs, for ratios that keep few or many."""
    import collections
    import itertools
    import random

    r = random.Random(3)
    commits = {c: set(r.sample(range(30), r.choice((1, 2, 3, 30)))) for c in range(60)}
    rows = [(c, f) for c, fs in commits.items() for f in fs]
    table = spark.createDataFrame(rows + rows[:40], "sha long, file long")
    totals = collections.Counter(f for _, f in rows)
    for least in (0.0, 0.34, 0.5, 0.75, 1.0):
        shared = collections.Counter(p for fs in commits.values() for p in itertools.combinations(sorted(fs), 2))
        want = {(a, b): n for (a, b), n in shared.items() if min(totals[a], totals[b]) >= 5 and n / max(totals[a], totals[b]) >= least}
        got = {(x.file_a, x.file_b): x.shared for x in graph.pairs(table, min_ratio=least, excludes=()).collect()}
        assert got == want


def test_reuse_needs_a_score(spark):
    items = spark.createDataFrame([(1, "auth", 5, 1), (2, "auth", 1, 1), (3, "log", 9, 1), (4, "auth", 1, 2)], "doc_id long, category string, uses int, changed_at int")
    hits = spark.createDataFrame([(1, 2.9), (2, 3.0), (3, 9.0), (4, 3.0)], "doc_id long, score double")
    assert [r.doc_id for r in search.reuse(items, hits, "auth").collect()] == [4, 2, 3]
    assert [r.doc_id for r in search.reuse(items, hits, "auth", search.PLAN_SCORE).collect()] == [3]


def test_reports(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5, 3), ("a", "c", 0.9, 2), ("b", "c", 0.9, 4)], "file_a string, file_b string, ratio double, shared int")
    text = report.render("cochange", {"pairs": pairs})
    assert text.startswith("# Files that change together\n\n## Pairs\n\n| file_a |") and "Clusters" not in text
    assert [x.split(" | ")[1:3] for x in text.splitlines()[6:9]] == [["c", "0.9"], ["c", "0.9"], ["b", "0.5"]] and text.index("| b | c") < text.index("| a | c")
    assert len(report.REPORTS) == 18 and report.ordered(pairs, "-shared", most=1).first().shared == 4


def test_user_excludes(spark):
    patterns = paths.excludes(("docs/", "*.lock", "gen"))
    assert patterns[: len(paths.DEFAULT_EXCLUDES)] == paths.DEFAULT_EXCLUDES and patterns[len(paths.DEFAULT_EXCLUDES) :] == ("docs/", "gen")
    assert one(spark, paths.excluded(F.lit("a/docs/x"), patterns)) and not one(spark, paths.excluded(F.lit("src/x.rs"), patterns))


def test_python_symbols(spark):
    text = 'class A:\n    """doc of A"""\n    def m(self):\n        def inner(): pass\n    if True:\n        async def n(self): pass\n\n@dec\ndef f():\n    "doc of f"\n'
    table = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", "def ("), ("r", "c.go", "x"), ("r", "d.py", None), ("r", "e.py", "")], "repo string, path string, content string")
    got = [(r.path, r.line_no, r.name, r.kind, r.doc, r.inside) for r in syntax.python_symbols(table).orderBy("path", "line_no").collect()]
    assert got == [
        ("a.py", 1, "A", "class", "doc of A", ""), ("a.py", 3, "m", "method", None, "A"), ("a.py", 4, "inner", "function", None, "A.m"),
        ("a.py", 6, "n", "function", None, "A"), ("a.py", 9, "f", "function", "doc of f", ""),
    ]


def test_embed_texts(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "zz")], "doc_id long, embedding_text string")
    def encode(texts):
        assert len(texts) <= 2
        return [[len(t), sum(map(ord, t))] for t in texts]

    got = {r.doc_id: r.embedding for r in search.embed_texts(docs.coalesce(1), encode, at_once=2).collect()}
    assert got == {1: [3.0, 294.0], 2: [0.0, 0.0], 3: [2.0, 244.0]}


def test_classes_stand_for_their_items(spark, monkeypatch):
    """Items of equal commits are compared once: pairs, clusters and partners are those of all items."""
    import itertools
    import random

    monkeypatch.setattr(graph, "CELL", 2)
    r = random.Random(8)
    own = {}
    for kind in range(8):
        commits = frozenset(r.sample(range(12), r.choice((5, 6, 9, 11))))
        own |= {r.randrange(10**6): commits for _ in range(r.choice((1, 2, 7)))}
    table = spark.createDataFrame([(c, f) for f, cs in own.items() for c in cs] + [(None, min(own))], "sha long, file long")
    total = {f: len(cs) + (f == min(own)) for f, cs in own.items()}
    want = {}
    for a, b in itertools.combinations(sorted(own), 2):
        n = len(own[a] & own[b])
        if n / max(total[a], total[b]) >= 0.5:
            want[a, b] = n, total[a], total[b]
    found = graph.pairs(table, excludes=())
    assert {(x.file_a, x.file_b): (x.shared, x.total_a, x.total_b) for x in found.collect()} == want and found.count() == len(want)
    classed, met = graph.class_pairs(table, excludes=())
    assert classed.where("file = rep").count() <= 9 and met.agg({"links": "sum"}).first()[0] == len(want)
    rows = lambda df: sorted((x.component, x.files, x.size, round(x.cohesion, 9)) for x in df.collect())
    assert rows(graph.class_clusters(classed, met, 0.8)) == rows(graph.clusters(found, 0.8))
    plan = spark.createDataFrame([(f,) for f in sorted(own)[::5]], "file long")
    some = graph.partners(*graph.class_pairs(table, excludes=(), wanted=plan), plan)
    assert sorted(graph.unplanned(some, plan, 0.7).collect()) == sorted(graph.missing(found, plan, 0.7).collect())


@pytest.fixture
def in_cells(monkeypatch):
    """Classes of items are compared in blocks, however few they are, and pairs of classes are never kept."""
    for name, value in (("JOINED", 0), ("JOIN_COST", 1e9), ("FEW", 0), ("HEAVY", 3), ("CELL", 2)):
        monkeypatch.setattr(graph, name, value)
    monkeypatch.setattr(graph.cells, "BLOCK", 4)
    monkeypatch.setattr(graph.cells, "STRIP", 3)
    monkeypatch.setattr(graph.cells, "WIDE", 1)


def _all_different():
    """Items and their commits: most differ, some are equal, two groups share nothing, one item has few commits."""
    import random

    r = random.Random(14)
    own = {f"i{n}": frozenset(r.sample(range(12), r.choice((5, 8, 10, 11)))) for n in range(26)}
    own |= {f"j{n}": frozenset(r.sample(range(100, 118), r.choice((5, 16, 17)))) for n in range(14)}
    own |= {f"{x}_{n}": own[x] for x in ("i3", "j2") for n in range(4)}
    return own | {"one": frozenset((1, 2, 3, 4)), "alone": frozenset(range(200, 206)), "￿": frozenset(range(12)), "\U0001f600": frozenset(range(11))}


def _brute(own, least):
    import itertools

    known = {f: cs for f, cs in own.items() if len(cs) >= 5}
    found = {}
    for a, b in itertools.combinations(sorted(known, key=str.encode), 2):
        n = len(known[a] & known[b])
        if n and n / max(len(known[a]), len(known[b])) >= least:
            found[a, b] = n, len(known[a]), len(known[b])
    return found


def _commits_of(spark, own):
    return spark.createDataFrame([(c, f) for f, cs in own.items() for c in cs], "sha long, file string")


@pytest.mark.parametrize("least", [0.5, 0.0])
def test_pairs_in_cells(spark, in_cells, least):
    own = _all_different()
    table = _commits_of(spark, own)
    these = graph.compared(table, min_ratio=least, excludes=())
    assert these.blocks and these.blocks.count > 5
    found = graph.pairs(table, min_ratio=least, excludes=()).collect()
    assert {(x.file_a, x.file_b): (x.shared, x.total_a, x.total_b) for x in found} == _brute(own, least) and len(found) == len(_brute(own, least))
    assert all(x.ratio == x.shared / max(x.total_a, x.total_b) for x in found)
    _, met = graph.class_pairs(table, min_ratio=least, excludes=())
    assert met.agg({"links": "sum"}).first()[0] == len(found) and met.where("file_a > file_b").count() == 0


def test_clusters_in_cells(spark, in_cells):
    own = _all_different()
    table, found = _commits_of(spark, own), _brute(own, 0.5)
    component = {}
    for a, b in (p for p, (n, x, y) in found.items() if n / max(x, y) >= 0.9):
        one, other = component.get(a, {a}), component.get(b, {b})
        for f in one | other:
            component[f] = one | other
    want = {}
    for files in component.values():
        inside = [n / max(x, y) for (a, b), (n, x, y) in found.items() if a in files and b in files]
        want[min(files, key=str.encode)] = len(files), round(sum(inside) / len(inside), 9)
    assert len(want) > 2
    these = graph.compared(table, excludes=())
    assert {x.component: (x.size, round(x.cohesion, 9)) for x in graph.item_clusters(these, 0.9).collect()} == want
    got = {x.node: x.component for x in graph.item_members(graph.compared(table, min_ratio=0.9, excludes=()), 0.9, 0.9).collect()}
    assert got == {f: min(files, key=str.encode) for f, files in component.items()}


@pytest.mark.parametrize("dense", [True, False])
def test_best_pairs(spark, request, dense):
    """The first of all pairs, without writing out all of them."""
    if dense:
        request.getfixturevalue("in_cells")
    own = _all_different()
    table, order = _commits_of(spark, own), ["-ratio", "-shared", "file_a", "file_b"]
    shown = lambda df: [tuple(r) for r in report.ordered(df.select("file_a", "file_b", "shared", F.round("ratio", 6).alias("ratio")), *order, most=20).collect()]
    every = graph.pairs(table, excludes=())
    best = graph.best_pairs(table, 20, excludes=())
    assert shown(best) == shown(every) and len(shown(best)) == 20 and best.count() < every.count() / 2
    assert graph.best_pairs(table.where("sha < 0"), 20, excludes=()).count() == 0


ODD_SOURCE = '''# first
@dec(
  1)
class A(B,
        C):  # why
    # a note
    """doc
  of A"""

    if x:
        def a(self): "doc of a"
    else:
        class Q: pass
    @dec
    # between
    @dec
    async def n(self, y=lambda: 1):

        def inner():
            """inner
            doc"""
            try:
                return 1
            except E:
                class R:
                    def r(self): return 2
            finally: pass
        async with z as w: pass
        return """
no indent"""
    class D:
        @dec
        def m(self): pass; "no doc"
    x = 1; y = 2
def last(): return 1
'''


@pytest.mark.parametrize("piece", [0, 40, 10**6])
def test_python_symbols_in_pieces(spark, monkeypatch, piece):
    """A large source is parsed in pieces, never as one tree, and gives the same rows; one that doesn't parse gives none."""
    import ast

    want = sorted(map(str, syntax._walk(ast.parse(ODD_SOURCE), "")))
    monkeypatch.setattr(syntax, "PIECE", piece)
    parse, sizes = ast.parse, []
    monkeypatch.setattr(ast, "parse", lambda text: sizes.append(len(text)) or parse(text))
    for text in (ODD_SOURCE, ODD_SOURCE.replace("\n", "\r\n"), ODD_SOURCE.rstrip("\n")):
        assert sorted(map(str, syntax._symbols(text))) == want
    assert piece > 10**5 or max(sizes) < len(ODD_SOURCE) / 2
    assert list(syntax._symbols("# nothing")) == list(syntax._symbols("")) == []
    for wrong in ("  x\n", "def (", "class X:\n        def a(): pass\n    def b(): pass\n", "if x:\n    pass\n  y\n", "else: pass\n", "class A:\n    x = 'a\n"):
        with pytest.raises((SyntaxError, syntax.tokenize.TokenError)):
            list(syntax._symbols(ODD_SOURCE + wrong))
