"""Definitions with nested braces, strings and comments; co-change of items in very many commits."""

import random

import pytest

from codestrata.operators import graph
from codestrata.sources import specs

PROTO = """
syntax = "proto3"; /* package wrong; service No { rpc A(B) returns (C); } */
package acme.v1; // package other;
message Outer { message Inner { string s = 1; } oneof x { Inner a = 2; } string t = 3 [default = "service Q { rpc Z(A) returns (B);"]; }
service Shop {
  option (x) = { name: "}" list: [{ a: 1 }] };
  rpc Get(GetReq) returns (Rep) { option (google.api.http) = { get: "/v1/{id}" body: "*" }; }
  rpc Up(stream acme.v1.Chunk)
    returns (Rep); // rpc Dead(A) returns (B);
  rpc Down(Req) returns (stream Rep) {}
  rpc Both( stream stream ) returns ( stream .acme.Rep );
  rpc Odd(stream) returns (stream);
}
message rpc { int32 service = 1; }
service Empty {}
service Two { rpc Last(A) returns (B); }
"""

GRAPHQL = '''
"""type Query { no: Int }"""
type Query @auth(rules: [{ allow: owner }]) {
  "a { brace" user(id: ID = "x}", where: Filter = { a: { b: [1, 2] } }): User @deprecated(reason: "use } other: me")
  """
  doc: with colon { and "quotes" \\""" still
  """
  users: [User!]!
  # hidden: Int
  type: Kind
}
extend type Mutation { add(in: [In!]! = [{ n: 1 }]): User }
type User implements Node & Other { id: ID!  nested(a: In = { n: 2 }): Int }
input In { n: Int = 3 }
enum Kind { A B @x(y: { z: 1 }) }
union Any = User | Thing
scalar Date
interface Node { id: ID! }
extend type User { more: Int }
schema { query: Query }
directive @auth(rules: [R]) on OBJECT | FIELD_DEFINITION
'''


def test_protobuf_with_braces_anywhere(spark):
    files = spark.createDataFrame([("r", "a.proto", PROTO), ("r", "b.proto", "service X { rpc A(B) returns"), ("r", "c.proto", "}}} service"), ("r", "d.proto", None)], "repo string, path string, content string")
    got = {(r.service, r.rpc, r.request_type, r.response_type, r.streaming) for r in specs.protobuf(files).collect()}
    assert got == {
        ("Shop", "Get", "GetReq", "Rep", "Unary"), ("Shop", "Up", "acme.v1.Chunk", "Rep", "ClientStream"), ("Shop", "Down", "Req", "Rep", "ServerStream"),
        ("Shop", "Both", "stream", ".acme.Rep", "Bidi"), ("Shop", "Odd", "stream", "stream", "Unary"), ("Two", "Last", "A", "B", "Unary"),
    }
    assert {r.package for r in specs.protobuf(files).collect()} == {"acme.v1"}


def test_graphql_with_braces_anywhere(spark):
    files = spark.createDataFrame([("r", "a.graphql", GRAPHQL), ("r", "b.gql", "type Query { a: Int"), ("r", "c.gql", "")], "repo string, path string, content string")
    got = [(r.schema_file, r.kind, r.type_name, r.name) for r in specs.graphql(files).collect()]
    fields = [("Query", "user"), ("Query", "users"), ("Query", "type"), ("Mutation", "add")]
    types = [("type", "User"), ("input", "In"), ("enum", "Kind"), ("union", "Any"), ("scalar", "Date"), ("interface", "Node")]
    assert sorted(got) == sorted([("a.graphql", "operation", t, f) for t, f in fields] + [("a.graphql", k, n, n) for k, n in types] + [("b.gql", "operation", "Query", "a")])


@pytest.mark.parametrize("ratio", [0.5, 0.8])
def test_pairs_in_small_buckets(spark, monkeypatch, ratio):
    """Items of all commits beside rare ones: the same pairs by buckets of a few commits as by comparing all sets."""
    monkeypatch.setattr(graph, "BUCKET", 16)
    monkeypatch.setattr(graph, "BINS", 4)
    r = random.Random(11)
    sets = {f"f{i}": set(r.sample(range(400), r.choice((5, 8, 40, 300, 390)))) for i in range(40)} | {"all": set(range(400)), "most": set(range(380)), "few": {1, 2}}
    sets |= {f"{k}_copy": set(list(v)[: max(5, int(len(v) * 0.9))]) for k, v in list(sets.items())[:12]}
    rows = [(c, f) for f, own in sets.items() for c in own] * 1 + [(1, "few"), (None, "few")]
    got = {(p.file_a, p.file_b): (p.shared, p.total_a, p.total_b) for p in graph.pairs(spark.createDataFrame(rows, "sha long, file string"), min_ratio=ratio, excludes=()).collect()}
    known, expected = {k: v for k, v in sets.items() if len(v) >= 5}, {}
    for a in known:
        for b in known:
            n = len(known[a] & known[b])
            if a < b and n / max(len(known[a]), len(known[b])) >= ratio:
                expected[a, b] = n, len(known[a]), len(known[b])
    assert got == expected and ("all", "most") in got


SPEC = {
    "paths": {
        "/users": {"get": {"operationId": "list", "summary": "all", "tags": ["b", 1, None, "a"]}, "post": {}, "x-note": {"get": 1}, "parameters": []},
        "/again": {"$ref": "#/paths/~1users"},
        "/shared": {"$ref": "#/components/pathItems/One"},
        "/lost": {"$ref": "#/nowhere"},
        "/odd": {"get": None, "put": 3, "delete": {"operationId": 5, "tags": "x", "summary": ["no"]}, "trace": {"tags": []}},
        "/none": None,
        "/list": [{"get": {}}],
    },
    "components": {"pathItems": {"One": {"head": {"operationId": "one"}}}},
}


def test_openapi_as_variants(spark):
    import json

    import yaml

    files = [("r", "docs/openapi.json", json.dumps(SPEC)), ("r", "swagger.YAML".lower(), yaml.safe_dump(SPEC)), ("r", "api.json", "{broken"), ("r", "openapi.yml", "a: [b"), ("q", "api.json", "[1]"), ("q", "openapi.json", None)]
    df = spark.createDataFrame([*files, ("r", "other.json", json.dumps(SPEC))], "repo string, path string, content string")
    users = [("GET", "list", "all", ("b", "a")), ("POST", None, None, ())]
    expected = {"/users": users, "/again": users, "/shared": [("HEAD", "one", None, ())], "/odd": [("GET", None, None, ()), ("PUT", None, None, ()), ("DELETE", None, None, ()), ("TRACE", None, None, ())]}
    whole = sorted((p, *e) for p, es in expected.items() for e in es)
    for spec_file in ("docs/openapi.json", "swagger.yaml"):
        got = sorted((r.path, r.method, r.operation_id, r.summary, tuple(r.tags)) for r in specs.openapi(df).where(f"spec_file = '{spec_file}'").collect())
        assert sorted(got, key=str) == sorted(whole, key=str)
    assert {r.spec_file for r in specs.openapi(df).collect()} == {"docs/openapi.json", "swagger.yaml"}
    assert "Python" not in specs.openapi_json(df)._jdf.queryExecution().toString() and "MapInPandas" not in specs.openapi_json(df)._jdf.queryExecution().toString()


def test_openapi_of_a_large_file(spark):
    """Path items are variants of their own: a file may be larger than one variant can be."""
    import json

    items = {f"/p{i}": {"get": {"operationId": f"op{i}", "summary": "s" * 70_000}} for i in range(2000)}
    df = spark.createDataFrame([("r", "openapi.json", json.dumps({"paths": items})), ("q", "openapi.json", json.dumps([{"paths": items["/p0"]}]))], "repo string, path string, content string")
    found = specs.openapi_json(df)
    assert found.selectExpr("count(*)", "count(distinct path)", "min(length(summary))").first()[:] == (2000, 2000, 70_000)
