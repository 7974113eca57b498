"""API and CI definitions as tables. YAML and schema languages need Python, on the few files that hold them."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a file that are sent on at once.
ROWS = 8192

# Methods, places of specs, keys that are no jobs.
METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")
SPEC_NAMES = ("openapi", "swagger", "api")
GITLAB_RESERVED = ("stages", "variables", "default", "include", "workflow", "image", "services", "before_script", "after_script", "cache")

ENDPOINTS = "repo string, spec_file string, path string, method string, operation_id string, summary string, tags array<string>"
RPCS = "repo string, file string, package string, service string, rpc string, request_type string, response_type string, streaming string"
GRAPHQL = "repo string, schema_file string, kind string, type_name string, name string"
CI = "repo string, file string, provider string, triggers array<string>, job string, runs_on string, steps_count int, steps array<string>"


def _each(parse: Callable[[str, str], Iterator[tuple]], columns: list[str]) -> Callable:
    """parse applied to each file (repo, path, content); files that can't be read give no rows. Rows leave by ROWS of
    them, so that only one file is held as objects."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repo, path, content in zip(frame["repo"], frame["path"], frame["content"], strict=True):
                found = parse(path, content or "")
                while rows := [(repo, path, *row) for row in islice(found, ROWS)]:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _plain(number: str) -> float:
    """A number that YAML reads as one, too."""
    if not re.fullmatch(r"-?[0-9]+\.[0-9]+", number):
        raise ValueError(number)
    return float(number)


def _load(path: str, content: str):
    try:
        if path.lower().endswith(".json"):
            return json.loads(content)
        if content.lstrip()[:1] == "{":
            with contextlib.suppress(ValueError):  # most such YAML is JSON, which takes a fraction of the time and memory
                return json.loads(content, parse_float=_plain, parse_constant=_plain)
        import yaml

        return yaml.safe_load(content)
    except ImportError:
        raise
    except Exception:
        return None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _spec_files(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)\.(?:json|ya?ml)$", 1)
    return files.where(F.lower(name).isin(*SPEC_NAMES)).select("repo", "path", "content")


def _text_at(value: Column, path: str) -> Column:
    """The string at path of a variant; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


#: What is read of a specification: its path items, each a variant of its own, and those that others may refer to.
_SPEC = "paths map<string, variant>, components struct<pathItems: map<string, variant>>"


def _entries(rows: DataFrame, items: str) -> DataFrame:
    """(repo, path, key, value) of the map items of specifications (repo, path, content); none of a map that repeats a key.

    Entries of one variant of the whole file would each carry the names of all others; these carry their own.
    """
    spec = F.when(F.col("content").rlike(r"^\s*\{"), F.from_json("content", _SPEC))
    held = rows.select("repo", "path", spec.alias("_s")).select("repo", "path", F.col(f"_s.{items}").alias("_m"))
    once = held.where(F.size(F.array_distinct(F.map_keys("_m"))) == F.size("_m"))
    return once.select("repo", "path", F.explode("_m").alias("key", "value"))


def _endpoints(specs: DataFrame) -> DataFrame:
    """Endpoints of specs (repo, path, content) in JSON; items that refer to others of their file are followed."""
    places, shared = _entries(specs, "paths"), _entries(specs, "components.pathItems")
    pointer = lambda folder: F.concat(F.lit(f"#/{folder}/"), F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    targets = places.select("repo", "path", pointer("paths").alias("ref"), F.col("value").alias("target")).unionByName(
        shared.select("repo", "path", pointer("components/pathItems").alias("ref"), F.col("value").alias("target"))
    )
    items = places.withColumn("ref", _text_at(F.col("value"), "$['$ref']"))
    direct = items.where("ref is null").select("repo", "path", "key", F.col("value").alias("item"))
    referred = items.where("ref is not null").join(targets, ["repo", "path", "ref"]).select("repo", "path", "key", F.col("target").alias("item"))
    each = direct.unionByName(referred).withColumnRenamed("key", "place")
    ops = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col("item").outer())).where(F.col("key").isin(*METHODS))
    tags = F.try_variant_get("value", "$.tags", "array<variant>")
    texts = F.transform(F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    return ops.select(
        "repo", F.col("path").alias("spec_file"), F.col("place").alias("path"), F.upper("key").alias("method"),
        _text_at(F.col("value"), "$.operationId").alias("operation_id"), _text_at(F.col("value"), "$.summary").alias("summary"),
        F.coalesce(texts, F.array().cast("array<string>")).alias("tags"),
    )


def openapi_json(files: DataFrame) -> DataFrame:
    """Endpoints of the OpenAPI and Swagger files in JSON: variants, no Python. Files that are no JSON give no rows."""
    found = _spec_files(files).where(F.lower("path").endswith(".json"))
    return _endpoints(found)


def openapi(files: DataFrame) -> DataFrame:
    """Endpoints of OpenAPI and Swagger files, JSON or YAML. YAML, which Spark doesn't read, is turned into JSON first."""
    found = _spec_files(files).where(~F.lower("path").endswith(".json"))
    turned = found.mapInPandas(_as_json, "repo string, path string, content string")
    return openapi_json(files).unionByName(_endpoints(turned))


def _as_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        content = [json.dumps(_load(p, c or ""), default=str) for p, c in zip(frame["path"], frame["content"], strict=True)]
        yield pd.DataFrame({"repo": frame["repo"], "path": frame["path"], "content": content})


#: Strings and comments are taken whole, so that what they hold is no brace; then brackets, words and other signs.
_PROTO_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\w.]+|[^\s\w]""", re.S)
_GRAPHQL_TOKEN = re.compile(r'''"""(?:\\"""|.)*?(?:"""|\Z)|#[^\n]*|"(?:[^"\\\n]|\\.)*"|\w+|[^\s\w]''', re.S)
_MODES = {(False, False): "Unary", (True, False): "ClientStream", (False, True): "ServerStream", (True, True): "Bidi"}


def _proto(path: str, content: str) -> Iterator[tuple]:
    """One pass over the tokens with the blocks that are open: calls are those right inside a service."""
    tokens = [t for t in _PROTO_TOKEN.findall(content) if not t.startswith(("//", "/*"))]
    package, open_, at = None, [], 0
    while at < len(tokens):
        t, rest = tokens[at], tokens[at + 1 : at + 12]
        if t == "{":
            opened = at > 1 and tokens[at - 2] == "service" and not open_
            open_.append(tokens[at - 1] if opened else None)
        elif t == "}":
            open_ = open_[:-1]
        elif t == "package" and not open_ and rest[1:2] == [";"]:
            package = package or rest[0]
        elif t == "rpc" and len(open_) == 1 and open_[0] and rest[1:2] == ["("]:
            asked, found = rest[2:].index(")") + 2 if ")" in rest[2:] else None, None
            if asked and rest[asked + 1 : asked + 3] == ["returns", "("] and ")" in rest[asked + 3 :]:
                found = rest[asked + 3 : rest.index(")", asked + 3)]
            if found:
                given = rest[2:asked]
                yield package, open_[0], rest[0], given[-1], found[-1], _MODES[given[0] == "stream" and len(given) > 1, found[0] == "stream" and len(found) > 1]
        at += 1


def messages(files: DataFrame) -> DataFrame:
    """(repo, file, message): lines of .proto files that begin with "message"."""
    rows = files.where(F.col("path").endswith(".proto")).select("repo", F.col("path").alias("file"), F.explode(F.split("content", r"\r?\n")).alias("line"))
    return rows.where(F.trim("line").startswith("message ")).select("repo", "file", F.regexp_extract("line", r"^\s*message\s+(\w*)", 1).alias("message"))


def protobuf(files: DataFrame) -> DataFrame:
    """Remote calls of .proto files."""
    found = files.where(F.col("path").endswith(".proto")).select("repo", "path", "content")
    return found.mapInPandas(_each(_proto, ["repo", "file", "package", "service", "rpc", "request_type", "response_type", "streaming"]), RPCS)


_GRAPHQL_KINDS = ("type", "input", "enum", "interface", "union", "scalar")


def _graphql(path: str, content: str) -> Iterator[tuple]:
    """One pass over the tokens with the brackets that are open: definitions are at the top, operations right inside a root type; arguments,
    defaults and directives lie in further brackets."""
    tokens = [t for t in _GRAPHQL_TOKEN.findall(content) if t[0] not in '#"']
    open_, root = [], None
    for at, t in enumerate(tokens):
        before, after = tokens[at - 1] if at else "", tokens[at + 1] if at + 1 < len(tokens) else ""
        if not open_ and t in _GRAPHQL_KINDS and after.isidentifier() and before not in ("=", "|", "&", "@", "on", "implements", *_GRAPHQL_KINDS):
            root = after if t == "type" and after in ("Query", "Mutation", "Subscription") else None
            if not root and before != "extend":
                yield t, after, after
        elif t in ("{", "(", "["):
            open_.append(t)
        elif t in ("}", ")", "]"):
            root = None if t == "}" and len(open_) == 1 else root
            open_ = open_[:-1]
        elif open_ == ["{"] and root and after in (":", "(") and t.isidentifier() and before != "@":
            yield "operation", root, t


def graphql(files: DataFrame) -> DataFrame:
    """Operations (kind operation, type_name Query, Mutation or Subscription) and types of GraphQL schemas."""
    found = files.where(F.col("path").rlike(r"\.(graphql|gql)$")).select("repo", "path", "content")
    return found.mapInPandas(_each(_graphql, ["repo", "schema_file", "kind", "type_name", "name"]), GRAPHQL)


def _step(step) -> str:
    step = step if isinstance(step, dict) else {}
    if _text(step.get("name")):
        return step["name"]
    if _text(step.get("uses")):
        return "uses: " + step["uses"]
    if _text(step.get("run")) is not None:
        first = (step["run"].splitlines() or [""])[0].strip()
        return "run: " + (first[:60] + "..." if len(first) > 60 else first)
    return "(unnamed)"


def _github(path: str, spec: dict) -> Iterator[tuple]:
    on = spec.get("on", spec.get(True))  # a bare "on" is a truth value in YAML
    triggers = [on] if isinstance(on, str) else [str(x) for x in on] if isinstance(on, (list, dict)) else []
    jobs = spec.get("jobs")
    for key, job in jobs.items() if isinstance(jobs, dict) else ():
        job = job if isinstance(job, dict) else {}
        steps = job.get("steps") if isinstance(job.get("steps"), list) else []
        runs = job.get("runs-on", "unknown")
        yield "github", triggers, _text(job.get("name")) or str(key), ", ".join(map(str, runs)) if isinstance(runs, list) else str(runs), len(steps), [_step(s) for s in steps[:10]]


def _gitlab(path: str, spec: dict) -> Iterator[tuple]:
    for key, job in spec.items():
        if isinstance(key, str) and not key.startswith(".") and key not in GITLAB_RESERVED and isinstance(job, dict):
            script = job.get("script")
            yield "gitlab", ["push", "merge_request"], key, "stage:" + (_text(job.get("stage")) or "test"), len(script) if isinstance(script, list) else 0, []


def _circle(path: str, spec: dict) -> Iterator[tuple]:
    jobs = spec.get("jobs")
    for key, job in jobs.items() if isinstance(jobs, dict) else ():
        job = job if isinstance(job, dict) else {}
        docker = job.get("docker")
        image = docker[0].get("image") if isinstance(docker, list) and docker and isinstance(docker[0], dict) else None
        yield "circleci", ["push"], str(key), _text(image) or _text(job.get("machine")), len(job["steps"]) if isinstance(job.get("steps"), list) else 0, []


def _ci(path: str, content: str) -> Iterator[tuple]:
    if path == "Jenkinsfile":
        trigger = "scm-poll" if "triggers {" in content else "manual"
        for name in re.findall(r"""(?m)^\s*stage\(\s*['"]*([^'"\n)]+)""", content):
            yield "jenkins", [trigger], name, None, 0, []
        return
    spec = _load(path, content)
    if isinstance(spec, dict):
        yield from (_gitlab if path == ".gitlab-ci.yml" else _circle if path.startswith(".circleci/") else _github)(path, spec)


def ci_jobs(files: DataFrame) -> DataFrame:
    """Jobs of the four kinds of CI definitions, at their places."""
    here = F.col("path").rlike(r"^(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|\.circleci/config\.yml|Jenkinsfile)$")
    found = files.where(here).select("repo", "path", "content")
    return found.mapInPandas(_each(_ci, ["repo", "file", "provider", "triggers", "job", "runs_on", "steps_count", "steps"]), CI)


def trigger_flags(jobs: DataFrame) -> DataFrame:
    """(repo, on_push, on_pull_request, on_schedule, on_manual, on_other, jobs): what starts a repository's workflows."""
    each = jobs.select("repo", F.explode_outer("triggers").alias("t"), "job")
    known = {"on_push": ("push",), "on_pull_request": ("pull_request", "merge_request", "pull_request_target"), "on_schedule": ("schedule", "scm-poll"), "on_manual": ("workflow_dispatch", "manual")}
    flags = [F.coalesce(F.bool_or(F.col("t").isin(*names)), F.lit(False)).alias(flag) for flag, names in known.items()]
    every = [n for names in known.values() for n in names]
    other = F.array_sort(F.collect_set(F.when(~F.col("t").isin(*every), F.col("t")))).alias("on_other")
    return each.groupBy("repo").agg(*flags, other, F.countDistinct("job").alias("jobs"))
