"""Symbols from syntax trees, for Python sources; patterns (symbols.extract) serve the other languages."""

from __future__ import annotations

import ast
import tokenize
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a file that are sent on at once.
ROWS = 8192
#: Characters of a file that is parsed as one tree; bytes of a tree, about, where a file has more.
WHOLE, PIECE = 1 << 18, 1 << 16
KIND = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}


def _walk(node: ast.AST, inside: str) -> Iterator[tuple[int, int, str, str, str | None, str]]:
    """(first line, last line, name, kind, doc, the names around it) of all definitions below a node, in order."""
    for child in ast.iter_child_nodes(node):
        kind = KIND.get(type(child))
        if kind:
            own = "method" if kind == "function" and isinstance(node, ast.ClassDef) else kind
            yield child.lineno, child.end_lineno, child.name, own, ast.get_docstring(child), inside
            yield from _walk(child, f"{inside}.{child.name}".lstrip("."))
        else:
            yield from _walk(child, inside)


class _Source:
    """A source as logical lines: the row of each, how deep it lies, and whether it is a plain one, goes on with a statement, decorates or defines."""

    PLAIN, CLAUSE, DECORATOR, DEFINITION = range(4)
    CLAUSES = {"else", "elif", "except", "finally"}
    SKIPPED = {tokenize.NL, tokenize.COMMENT, tokenize.ENDMARKER}

    def __init__(self, content: str):
        self.data = content.replace("\r\n", "\n").replace("\r", "\n").encode()
        ends = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10) + 1
        self.offsets = np.concatenate([[0], ends, [len(self.data)] if not len(ends) or ends[-1] < len(self.data) else []]).astype(np.int64)
        self.row, self.deep, self.kind = array("l"), array("h"), array("b")
        rows = iter(range(1, len(self.offsets)))
        depth, first, new = 0, "", True
        for t in tokenize.generate_tokens(lambda: self.text(r, r + 1) if (r := next(rows, None)) else ""):
            if t.type == tokenize.INDENT:
                depth += 1
            elif t.type == tokenize.DEDENT:
                depth -= 1
            elif t.type == tokenize.NEWLINE:
                new = True
            elif t.type not in self.SKIPPED:
                if new:
                    self.row.append(t.start[0])
                    self.deep.append(depth)
                    word = t.string
                    self.kind.append(
                        self.DEFINITION if word in ("class", "def") else self.CLAUSE if word in self.CLAUSES else self.DECORATOR if word == "@" else self.PLAIN
                    )
                    new, first = False, word
                elif first == "async" and t.string == "def":
                    self.kind[-1] = self.DEFINITION
                    first = ""
                else:
                    first = ""

    def text(self, row: int, end: int) -> str:
        return self.data[self.offsets[row - 1] : self.offsets[min(end, len(self.offsets)) - 1]].decode()

    def start(self, line: int) -> int:
        return self.row[line] if line < len(self.row) else len(self.offsets)

    def size(self, line: int, end: int) -> int:
        return int(self.offsets[min(self.start(end), len(self.offsets)) - 1] - self.offsets[self.row[line] - 1])

    def statements(self, line: int, end: int) -> Iterator[tuple[int, int]]:
        """The statements of a block, each as its first logical line and the one after its last."""
        depth, decorated, first = self.deep[line], self.kind[line] == self.DECORATOR, line
        for i in range(line + 1, end):
            if self.deep[i] == depth:
                if self.kind[i] != self.CLAUSE and not decorated:
                    yield first, i
                    first = i
                decorated = self.kind[i] == self.DECORATOR
        yield first, end

    def parsed(self, line: int, end: int, more: str = "") -> tuple[list[ast.stmt], int]:
        """The statements in a run of lines, and what their rows lack."""
        text, row = self.text(self.row[line], self.start(end)) + more, self.row[line]
        return (ast.parse("if 1:\n" + text).body[0].body, row - 2) if self.deep[line] else (ast.parse(text).body, row - 1)

    def walk(self, line: int, end: int, inside: str, within: type) -> Iterator[tuple | int]:
        """_walk() of a block, whose large definitions are read as a head and a block; at last, the block's last row."""
        run, last = line, 0
        for s, e in (*self.statements(line, end), (end, end)):
            head = s
            while head < e and self.kind[head] == self.DECORATOR:
                head += 1
            opened = s < e and self.size(s, e) > PIECE and self.kind[head] == self.DEFINITION and head + 1 < e
            if run < s and (opened or s == end or self.size(run, s) > PIECE):
                body, lacks = self.parsed(run, s)
                node = ast.ClassDef("", [], [], body, []) if within is ast.ClassDef else ast.Module(body, [])
                for x in _walk(node, inside):
                    yield (x[0] + lacks, x[1] + lacks, *x[2:])
                run, last = s, body[-1].end_lineno + lacks
            if opened:
                simple = self.kind[head + 1] != self.DECORATOR and (head + 2 >= e or self.deep[head + 2] <= self.deep[head + 1])
                row = self.text(self.row[head + 1], self.row[head + 1] + 1)
                body, lacks = self.parsed(s, head + 2) if simple else self.parsed(s, head + 1, row[: len(row) - len(row.lstrip())] + "pass\n")
                node = body[0]
                kind = KIND[type(node)]
                yield from self.block(node, node.lineno + lacks, "method" if kind == "function" and within is ast.ClassDef else kind, head + 1, e, inside)
                run, last = e, self.ended
        self.ended = last

    def block(self, node: ast.stmt, row: int, kind: str, line: int, end: int, inside: str) -> Iterator[tuple]:
        yield from self.walk(line, end, f"{inside}.{node.name}".lstrip("."), type(node))
        yield row, self.ended, node.name, kind, ast.get_docstring(node), inside


def _symbols(content: str) -> Iterator[tuple[int, int, str, str, str | None, str]]:
    """_walk() of a source's tree. A large source's definitions and runs of statements are parsed one after another."""
    source = _Source(content)
    return source.walk(0, len(source.row), "", ast.Module) if len(source.row) else iter(())


def _batches(found: Iterable[tuple], at_once: int = ROWS) -> Iterator[list[tuple]]:
    rows = []
    for x in found:
        rows.append(x)
        if len(rows) == at_once:
            yield rows
            rows = []
    if rows:
        yield rows


def python_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, end_line, name, kind, doc, inside) of .py files (repo, path, content).

    A function right inside a class is a method. Files that don't parse give no rows.
    """

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["repo", "path", "line_no", "end_line", "name", "kind", "doc", "inside"]

    def batch_of(repo: str, path: str, found: list[tuple]) -> pa.RecordBatch:
        rows = [(repo, path, *x) for x in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def parsed(repo: str, path: str, content: str) -> list[pa.RecordBatch]:
        """A file's rows, of which none leaves before all of it is parsed."""
        if len(content) > WHOLE and "\0" not in content:
            try:
                return [batch_of(repo, path, found) for found in _batches(_symbols(content))]
            except Exception:  # what can't be cut or read in pieces is judged as a whole
                pass
        try:
            return [batch_of(repo, path, found) for found in _batches(_walk(ast.parse(content), ""))]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file's tree at a time, its rows by ROWS of them
                repo, path, content = (c[at].as_py() for c in batch.columns)
                yield from parsed(repo, path, content)

    found = files.where(F.col("path").endswith(".py") & F.col("content").isNotNull()).select("repo", "path", "content")
    return found.mapInArrow(run, "repo string, path string, line_no int, end_line int, name string, kind string, doc string, inside string")
