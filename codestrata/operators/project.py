"""What a source tree says about its project: stacks, entry points, manifests, the tree itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths

# Manifests and entry points that results depend on.
STACKS = {
    "Cargo.toml": "Rust", "go.mod": "Go", "package.json": "Node", "pyproject.toml": "Python", "requirements.txt": "Python", "setup.py": "Python",
    "composer.json": "PHP", "Gemfile": "Ruby", "pom.xml": "Java", "build.gradle": "Java", "build.gradle.kts": "Kotlin", "Package.swift": "Swift",
    "pubspec.yaml": "Flutter", "mix.exs": "Elixir", "deno.json": "Deno", "CMakeLists.txt": "C++", "Dockerfile": "Docker",
}
ENTRY_POINTS = (
    "main.go", "main.rs", "lib.rs", "main.py", "app.py", "__main__.py", "manage.py", "index.ts", "index.js", "main.ts", "server.ts", "server.js",
    "index.php", "artisan",
)
COMMANDS = {"Rust": ("cargo build", "cargo test"), "Go": ("go build ./...", "go test ./..."), "Node": ("npm install", "npm test"), "Python": ("pytest",)}


def stacks(files: DataFrame) -> DataFrame:
    """(repo, stack, manifest): by manifests at the root or one folder below, each stack once."""
    table = F.create_map(*[F.lit(x) for kv in STACKS.items() for x in kv])
    rows = files.where(F.size(F.split("path", "/")) <= 2).select("repo", table[paths.file_name(F.col("path"))].alias("stack"), "path").where("stack is not null")
    return rows.groupBy("repo", "stack").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("manifest"))


def entry_points(files: DataFrame, depth: int = 5, most: int = 10) -> DataFrame:
    found = files.where(paths.file_name(F.col("path")).isin(*ENTRY_POINTS) & (F.size(F.split("path", "/")) <= depth))
    return found.select("path").orderBy("path").limit(most)


def commands(found: DataFrame) -> DataFrame:
    """(repo, command) that the stacks suggest."""
    table = F.create_map(*[x for k, v in COMMANDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return found.select("repo", F.explode(table[F.col("stack")]).alias("command"))


def tree(files: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """The first paths, folders included, to a depth, in order."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(prefixes).alias("path")).distinct().orderBy("path").limit(most)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of text of at most so many bytes of UTF-8 that ends between characters."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    whole = F.regexp_replace(F.hex(raw), "(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")


def frontmatter_errors(files: DataFrame, required: dict[str, str]) -> DataFrame:
    """(path, key, error): keys that a document's front matter lacks or holds with another kind (int, date, string)."""
    head = F.regexp_extract("content", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    shapes = {"int": "^[0-9]+$", "date": r"^\d{4}-\d{2}-\d{2}", "string": "^.+$"}
    value = lambda k: F.trim(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1))
    checks = [
        F.struct(F.lit(k).alias("key"), F.when(~F.col("head").rlike(rf"(?m)^{k}:"), "missing").when(~value(k).rlike(shapes[kind]), f"not {kind}").alias("error"))
        for k, kind in required.items()
    ]
    rows = files.withColumn("head", head).select("path", F.explode(F.array(*checks)).alias("c"))
    return rows.select("path", "c.key", "c.error").where("error is not null")


# Signs of frameworks as (stack, variant, file pattern, text in it or ""), extensions without a manifest,
# language servers by manifest, and test frameworks.
VARIANTS = (
    ("Node", "Next.js", "next.config.*", ""), ("Node", "NestJS", "nest-cli.json", ""), ("Node", "NestJS", "package.json", "@nestjs/"),
    ("Node", "Vite", "vite.config.*", ""), ("Node", "SvelteKit", "package.json", "@sveltejs/kit"), ("Node", "Astro", "astro.config.*", ""),
    ("Node", "Remix", "remix.config.*", ""), ("Node", "Nuxt", "nuxt.config.*", ""), ("Node", "Expo", "package.json", '"expo"'),
    ("Node", "React Native", "package.json", '"react-native"'), ("Node", "Electron", "package.json", '"electron"'),
    ("Node", "Express", "package.json", '"express"'), ("Node", "Fastify", "package.json", '"fastify"'), ("Node", "pnpm workspace", "pnpm-workspace.yaml", ""),
    ("Node", "Turborepo", "turbo.json", ""), ("Node", "Nx", "nx.json", ""), ("Python", "Django", "manage.py", ""),
    ("Python", "FastAPI", "pyproject.toml", "fastapi"), ("Python", "FastAPI", "requirements.txt", "fastapi"), ("Python", "Flask", "pyproject.toml", "flask"),
    ("Python", "Flask", "requirements.txt", "flask"), ("Python", "Litestar", "pyproject.toml", "litestar"), ("Python", "Celery", "pyproject.toml", "celery"),
    ("Python", "Streamlit", "pyproject.toml", "streamlit"), ("Python", "Poetry", "pyproject.toml", "[tool.poetry]"), ("Python", "uv", "uv.lock", ""),
    ("Python", "uv", "pyproject.toml", "[tool.uv]"), ("Python", "pipenv", "Pipfile", ""), ("PHP", "Laravel", "artisan", ""),
    ("PHP", "Symfony", "composer.json", "symfony/framework-bundle"), ("PHP", "Slim", "composer.json", "slim/slim"), ("PHP", "WordPress", "wp-config.php", ""),
    ("Rust", "binary", "src/main.rs", ""), ("Rust", "library", "src/lib.rs", ""), ("Rust", "axum", "Cargo.toml", "axum"),
    ("Rust", "actix-web", "Cargo.toml", "actix-web"), ("Rust", "gRPC", "Cargo.toml", "tonic"), ("Rust", "tokio", "Cargo.toml", "tokio"),
    ("Rust", "CLI", "Cargo.toml", "clap"), ("Rust", "Tauri", "Cargo.toml", "tauri"), ("Rust", "workspace", "Cargo.toml", "[workspace]"),
    ("Flutter", "Flutter", "lib/main.dart", ""), ("Android", "Android", "AndroidManifest.xml", ""),
)
BARE_EXTENSIONS = {
    "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "hrl": "Erlang", "hs": "Haskell", "ml": "OCaml", "mli": "OCaml", "zig": "Zig", "nim": "Nim",
    "cr": "Crystal", "jl": "Julia", "lua": "Lua", "r": "R", "R": "R", "scala": "Scala", "sbt": "Scala", "clj": "Clojure", "cljs": "Clojure",
    "fs": "F#", "fsi": "F#", "kt": "Kotlin script", "dart": "Dart",
}
SERVERS = {
    "rust-analyzer": ("Cargo.toml",), "gopls": ("go.mod",), "pyright": ("pyproject.toml", "setup.py", "requirements.txt", "Pipfile"),
    "typescript-language-server": ("package.json", "tsconfig.json", "jsconfig.json"), "intelephense": ("composer.json",),
    "clangd": ("CMakeLists.txt", "compile_commands.json", "Makefile"), "ruby-lsp": ("Gemfile",),
}
SAMPLE_WORDS = "fn|func|def|class|struct|interface|type|enum|trait|const|function|impl|module"


def variants(files: DataFrame) -> DataFrame:
    """(repo, stack, variant) by files and what they hold; the rules are a fixed table inside the expression."""
    name = paths.file_name(F.col("path"))
    rules = [
        F.struct(
            F.when((F.col("path") if "/" in glob else name).rlike(paths.glob_regex(glob)) & (F.col("content").contains(text) if text else F.lit(True)), F.lit(stack)).alias("stack"),
            F.lit(variant).alias("variant"),
        )
        for stack, variant, glob, text in VARIANTS
    ]
    return files.select("repo", F.explode(F.array(*rules)).alias("r")).where("r.stack is not null").select("repo", "r.stack", "r.variant").distinct()


def stacks_by_extension(files: DataFrame, sure: float = 0.7) -> DataFrame:
    """(repo, stack, confidence): languages without a manifest, by their share of files, `sure` at most."""
    table = F.create_map(*[F.lit(x) for kv in BARE_EXTENSIONS.items() for x in kv])
    rows = files.select("repo", table[paths.extension(F.col("path"))].alias("stack"))
    counted = rows.groupBy("repo", "stack").agg(F.count("*").alias("n"))
    totals = rows.groupBy("repo").agg(F.count("*").alias("all"))
    found = counted.where("stack is not null").join(totals, "repo")
    return found.select("repo", "stack", F.least(F.lit(sure), F.col("n") / F.col("all")).alias("confidence"))


def servers(files: DataFrame) -> DataFrame:
    """(repo, server): the language servers whose manifests a repository has."""
    table = F.create_map(*[F.lit(x) for s, names in SERVERS.items() for n in names for x in (n, s)])
    return files.select("repo", table[paths.file_name(F.col("path"))].alias("server")).where("server is not null").distinct()


def test_framework(files: DataFrame) -> DataFrame:
    """(repo, framework) of tests, from manifests and their contents."""
    name, text = paths.file_name(F.col("path")), F.col("content")
    hit = F.array_compact(
        F.array(
            F.when(name == "Cargo.toml", F.lit("cargo test")),
            F.when(name == "go.mod", F.lit("go test")),
            F.when(name.isin("pytest.ini", "conftest.py"), F.lit("pytest")),
            *[F.when((name == "package.json") & text.contains(f'"{f}"'), F.lit(f)) for f in ("jest", "vitest", "mocha")],
        )
    )
    return files.select("repo", F.explode(hit).alias("framework")).distinct()


def sample_symbols(lines: DataFrame, most: int = 25, first_lines: int = 500) -> DataFrame:
    """(path, line_no, name): the first defining keyword of each early line, for a glance; names that start with _ don't count."""
    name = F.regexp_extract("line", rf"\b(?:{SAMPLE_WORDS})\s+([A-Za-z0-9_]+)", 1)
    found = lines.where(F.col("line_no") <= first_lines).select("path", "line_no", name.alias("name"))
    return found.where((F.col("name") != "") & ~F.col("name").startswith("_")).orderBy("path", "line_no").limit(most)


def excerpt(text: Column, most: int = 400) -> Column:
    """The start of a document without its front matter and comments."""
    return F.substring(F.trim(F.regexp_replace(without_frontmatter(text), r"(?s)<!--.*?-->", "")), 1, most)


def glance(files: DataFrame, touches: DataFrame) -> dict[str, DataFrame]:
    """The parts of a first look at repositories: stacks, entry points, commands, hot files and active authors.

    touches: (path, author, at) of the last 90 days.
    """
    found = stacks(files)
    top = lambda c: touches.groupBy(c).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), c).limit(5)
    return {"stacks": found, "entry_points": entry_points(files), "commands": commands(found), "hot_files": top("path"), "active_authors": top("author")}


#: Files that describe a project, and the bounds of what is shown of it.
README_NAMES = ("README.md", "README.rst", "README.txt", "README")
SIGNAL_MANIFESTS = (
    "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "requirements.txt", "Gemfile", "composer.json", "pom.xml", "build.gradle",
    "build.gradle.kts", "mix.exs",
)
README_BYTES, MANIFEST_BYTES, SUBJECTS, LAST_COMMITS, TOP_FILES, HOT, DAYS = 8000, 4000, 30, 10, 15, 5, 90


def _best(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first `most` rows of each repository, with their rank; the limit is applied before the shuffle, too."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def recent(commits: DataFrame, reference: Column, days: int = DAYS) -> DataFrame:
    """The commits of the last `days` days before the moment reference, as history_signals() takes them."""
    since = reference - F.make_interval(days=F.lit(days))
    return commits.where((F.col("at") >= since) & (F.col("at") <= reference))


def history_signals(commits: DataFrame, touches: DataFrame, reference: Column, days: int = DAYS) -> DataFrame:
    """(repo, part, rank, value, count): what histories say of projects at the moment reference, for all repositories.

    commits (repo, sha, author, at, subject, parents), touches (repo, sha, path), of which those of recent() suffice. Parts: last_commits (short hash and
    subject of the last ten, merges too), subjects (of the last thirty in the window, no merges), commits (how many these
    are, the value null), top_files (fifteen by commits in the window), active_authors (five).
    """
    within = recent(commits, reference, days)
    own = within.where(F.col("parents") <= 1)
    one, none = F.lit(None).cast("long"), F.lit(None).cast("string")
    newest = (F.desc("at"), F.desc("sha"))
    short = F.concat_ws(" ", F.substring(F.col("sha").cast("string"), 1, 7), "subject")
    changed = touches.join(within.select("repo", "sha"), ["repo", "sha"], "left_semi").groupBy("repo", "path").agg(F.count_distinct("sha").alias("count"))
    people = within.groupBy("repo", "author").agg(F.count("*").alias("count"))
    part = lambda df, name, value, count: df.select("repo", F.lit(name).alias("part"), "rank", value.cast("string").alias("value"), count.alias("count"))
    before = commits.where(F.col("at") <= reference)
    parts = [
        part(_best(before, LAST_COMMITS, *newest), "last_commits", short, one),
        part(_best(own, SUBJECTS, *newest), "subjects", F.col("subject"), one),
        part(own.groupBy("repo").agg(F.count("*").alias("count")).withColumn("rank", F.lit(1)), "commits", none, F.col("count")),
        part(_best(changed, TOP_FILES, F.desc("count"), "path"), "top_files", F.col("path"), F.col("count")),
        part(_best(people, HOT, F.desc("count"), "author"), "active_authors", F.col("author"), F.col("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_signals(files: DataFrame) -> DataFrame:
    """(repo, part, rank, path, excerpt) of files (repo, path, content) at the top of a repository: its readme, by the first
    name there is, and its manifests, cut where a character ends."""
    at = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    known = files.where(F.col("content").isNotNull() & F.col("path").isin(*README_NAMES, *SIGNAL_MANIFESTS))
    readme = _best(known.where(F.col("path").isin(*README_NAMES)), 1, at(README_NAMES))
    manifests = known.where(F.col("path").isin(*SIGNAL_MANIFESTS)).withColumn("rank", at(SIGNAL_MANIFESTS).cast("int"))
    show = lambda df, part, most: df.select("repo", F.lit(part).alias("part"), "rank", "path", cut_bytes(F.col("content"), most).alias("excerpt"))
    return show(readme, "readme", README_BYTES).unionByName(show(manifests, "manifest", MANIFEST_BYTES))
