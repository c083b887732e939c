"""Structure of one Python file by a walk over its tree: what the tables are held against."""

import ast
import hashlib
import io
import tokenize

KINDS = ["symbols", "imports", "barriers", "refs", "statement_ends", "diagnostics"]
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_DEFINITIONS = (*_FUNCTIONS, ast.ClassDef)


class _File:
    """Positions of nodes, and the rows found so far."""

    def __init__(self, path: str, text: str):
        self.path, self.raw = path, text.encode()
        self.starts = [0]
        for line in io.StringIO(text, newline=""):
            self.starts.append(self.starts[-1] + len(line.encode()))
        self.rows: dict[str, list] = {name: [] for name in KINDS}

    def byte(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def place(self, node) -> dict:
        return self.span(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def span(self, line: int, column: int, end_line: int, end_column: int) -> dict:
        return {"start_byte": self.byte(line, column), "end_byte": self.byte(end_line, end_column), "start_line": line, "end_line": end_line, "column": column}

    def source(self, node) -> str:
        at = self.place(node)
        return self.raw[at["start_byte"] : at["end_byte"]].decode()


def _targets(node) -> list[ast.Name]:
    """Simple names that a statement assigns."""
    found = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AugAssign, ast.AnnAssign)) else []
    return [t for t in found if isinstance(t, ast.Name)]


def _parameter_names(arguments: ast.arguments) -> set[str]:
    names = {a.arg for a in ast.walk(arguments) if isinstance(a, ast.arg)}
    return names | {n.id for n in ast.walk(arguments) if isinstance(n, ast.Name)}


def _add_imports(f: _File, node, scope: str | None) -> None:
    module = "." * node.level + (node.module or "") if isinstance(node, ast.ImportFrom) else None
    for item in node.names:
        if item.name == "*" and module is not None:
            continue
        alias = item.asname or item.name.split(".")[0]
        f.rows["imports"].append({"module": module or item.name, "name": item.name if module is not None else None, "alias": alias, "scope": scope, "reexport": False, **f.place(item)})


def _define(f: _File, node, scope: dict | None) -> dict:
    at, is_class = f.place(node), isinstance(node, ast.ClassDef)
    name = getattr(node, "name", f"<anonymous@{at['start_line']}:{at['start_byte']}>")
    kind = "class" if is_class else "method" if scope and scope["kind"] == "class" else "function"
    body = node.body if isinstance(node.body, list) else [node.body]
    first = min(body, key=lambda b: (b.lineno, b.col_offset))
    start = min((f.byte(d.lineno, d.col_offset - 1) for d in getattr(first, "decorator_list", [])), default=f.place(first)["start_byte"])
    local = {t.id for b in body for n in ast.walk(b) for t in _targets(n)} | (set() if is_class else _parameter_names(node.args))
    shown = [] if name.startswith("_") else [name]
    digest = hashlib.sha256("\0".join([f.path, str(at["start_byte"]), kind, name]).encode()).hexdigest()[:32]
    symbol = {
        "id": digest,
        "name": name,
        "qualified_name": f"{scope['qualified_name']}.{name}" if scope else name,
        "kind": kind,
        "scope": scope["id"] if scope else None,
        "locals": sorted(local),
        "signature": f.raw[at["start_byte"] : start].decode().strip(),
        "exported": bool(shown),
        "export_names": shown,
        **at,
    }
    f.rows["symbols"].append(symbol)
    return symbol


def _reference(f: _File, name: str, scope: dict | None, called: bool, base: str | None, place: dict) -> None:
    f.rows["refs"].append(
        {"name": name, "scope": scope["id"] if scope else None, "role": "call" if called else "reference", "member": base is not None, "member_base": base, **place}
    )


def _visit(f: _File, node, scope: dict | None, called: bool = False) -> None:
    """Rows for a node and all below; ``called`` if the node is what a call calls."""
    if isinstance(node, ast.stmt):
        f.rows["statement_ends"].append({"end_byte": f.place(node)["end_byte"]})
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        _add_imports(f, node, scope["id"] if scope else None)
        return
    for target in _targets(node):
        f.rows["barriers"].append({"name": target.id, "scope": scope["id"] if scope else None})
    if isinstance(node, _DEFINITIONS):
        inner = _define(f, node, scope)
        for part in getattr(node, "decorator_list", []):
            _visit(f, part, scope)
        for part in [*getattr(node, "bases", []), *getattr(node, "keywords", []), *([node.returns] if getattr(node, "returns", None) else [])]:
            _visit(f, part, inner)
        for part in node.body if isinstance(node.body, list) else [node.body]:
            _visit(f, part, inner)
        return
    if isinstance(node, ast.Name):
        _reference(f, node.id, scope, called, None, f.place(node))
    elif isinstance(node, ast.Attribute):
        end, line = node.end_col_offset, node.end_lineno
        _visit(f, node.value, scope, called and isinstance(node.value, ast.Name))
        _reference(f, node.attr, scope, called, f.source(node.value), f.span(line, end - len(node.attr.encode()), line, end))
        return
    elif isinstance(node, ast.keyword) and node.arg:
        width = len(node.arg.encode())
        _reference(f, node.arg, scope, False, None, f.span(node.lineno, node.col_offset, node.lineno, node.col_offset + width))
    elif isinstance(node, ast.Call):
        _visit(f, node.func, scope, True)
        for part in [*node.args, *node.keywords]:
            _visit(f, part, scope)
        return
    for part in ast.iter_child_nodes(node):
        _visit(f, part, scope)


def _words_of_statement(f: _File, tree, text: str) -> None:
    """Names of global and nonlocal statements and of except clauses, which the tree has as plain strings."""
    wanted = {(n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.Global, ast.Nonlocal))}
    handlers = {n.lineno: n.name for n in ast.walk(tree) if isinstance(n, ast.ExceptHandler) and n.name}
    if not wanted and not handlers:
        return
    spans = sorted(((s["start_byte"], s["end_byte"], s) for s in f.rows["symbols"]), key=lambda s: s[1] - s[0])
    lines, before = text.split("\n"), ""
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        (row, column), (end_row, end_column) = token.start, token.end
        listed = any(a <= row <= b for a, b in wanted) and token.string not in ("global", "nonlocal")
        if token.type == tokenize.NAME and (listed or before == "as" and handlers.get(row) == token.string):
            width = lambda r, c: len(lines[r - 1][:c].encode())
            place = f.span(row, width(row, column), end_row, width(end_row, end_column))
            scope = next((s for a, b, s in spans if a <= place["start_byte"] < b), None)
            _reference(f, token.string, scope, False, None, place)
        before = token.string


def extract_python(path: str, text: str) -> dict[str, list]:
    """Row lists of one Python file."""
    lines, error, tree = text.split("\n"), None, None
    upto = len(lines)
    while upto > 0 and tree is None:
        try:
            tree = ast.parse("\n".join(lines[:upto]))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            error = e
            # on before the top-level statement that holds the error
            upto = min(getattr(e, "lineno", None) or upto, upto) - 1
            while upto > 0 and (not lines[upto].strip() or lines[upto][0] in " \t"):
                upto -= 1
    readable = "\n".join(lines[:upto])
    f = _File(path, text)
    if error is not None:
        start, end = len(readable.encode()) + bool(readable), len(f.raw)
        first = readable.count("\n") + 1 + bool(readable)
        f.rows["diagnostics"].append({"kind": "syntax-error", "start_byte": start, "end_byte": end, "start_line": first, "end_line": text.count("\n") + 1, "column": 0})
    if tree is not None:
        for statement in tree.body:
            _visit(f, statement, None)
        _words_of_statement(f, tree, readable)
    ends = sorted({e["end_byte"] for e in f.rows["statement_ends"]})
    f.rows["statement_ends"] = [{"end_byte": e} for e in ends]
    f.rows["refs"].sort(key=lambda r: (r["start_byte"], r["end_byte"]))
    for n, r in enumerate(f.rows["refs"]):
        r["ref_no"] = n
    return f.rows

