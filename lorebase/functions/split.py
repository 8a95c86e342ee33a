"""Splitters: one text to chunks of bounded size, plain Python for use in Arrow functions.

A chunk is a dict of content, types, level and path. Sizes are in code points.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

#: Chunk sizes, JSON depth and number of JSON chunks.
MIN_SIZE, PREFERRED_SIZE, MAX_SIZE = 500, 1500, 5000
JSON_DEPTH, JSON_CHUNKS = 5, 1000

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def chunk(content: str, types: list[str], level: int = 0, path: list[str] | None = None) -> dict:
    return {"content": content, "types": types, "level": level, "path": list(path or [])}


# --- fences ----------------------------------------------------------------------------------------------------


def open_fence(text: str) -> str | None:
    """The opening line of the fence that is still open at the end of the text."""
    opened = None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if not m:
            continue
        if opened is None:
            opened = line.strip()
        elif m[1][0] == opened[0] and len(m[1]) >= len(_FENCE.match(opened)[1]) and not m[2].strip():
            opened = None
    return opened


def rebalanced(pieces: list[str]) -> list[str]:
    """Pieces cut inside a fence are closed and opened again, so that each stands alone."""
    out, opened = [], None
    for p in pieces:
        body = f"{opened}\n{p}" if opened else p
        opened = open_fence(body)
        out.append(f"{body}\n{_FENCE.match(opened)[1]}" if opened else body)
    return out


# --- plain text ------------------------------------------------------------------------------------------------


def slices(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def merged(parts: list[str], size: int, joiner: str = "") -> list[str]:
    """Neighbours together as long as they fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joiner) + len(p) <= size:
            out[-1] += joiner + p
        else:
            out.append(p)
    return out


def split_text(text: str, size: int) -> list[str]:
    """Whole if it fits; paragraphs if each fits and none cuts a fence; else lines together; longer lines in slices. Before fences are mended the pieces add up to the text."""
    if len(text) <= size:
        return [text]
    paragraphs = re.findall(r".+?(?:\n\s*\n|\Z)", text, re.S)
    whole: list[str] = []
    for p in paragraphs:
        if whole and open_fence(whole[-1]):
            whole[-1] += p
        else:
            whole.append(p)
    if all(len(p) <= size for p in whole):
        return merged(whole, size)
    lines = [s for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text) for s in slices(line, size)]
    return rebalanced(merged(lines, size))


def split_document(text: str, size: int = MAX_SIZE) -> list[dict]:
    return [chunk(p, ["text"]) for p in split_text(text, size)] if text.strip() else []


# --- greedy merge ----------------------------------------------------------------------------------------------


def related(a: list[str], b: list[str]) -> bool:
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def common(a: list[str], b: list[str]) -> list[str]:
    out = []
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        out.append(x)
    return out


def greedy(chunks: list[dict], least: int = MIN_SIZE, preferred: int = PREFERRED_SIZE, most: int = MAX_SIZE) -> list[dict]:
    """Small neighbours together: a merge never passes ``most``; a first or second level section starts anew once the chunk has ``least`` and is not of the same branch; two chunks of ``least`` each stay apart where they would pass ``preferred``."""
    bounded = [c | {"content": p} for c in chunks for p in ([c["content"]] if len(c["content"]) <= most else split_text(c["content"], most))]
    out: list[dict] = []
    for c in bounded:
        if not out:
            out.append(dict(c))
            continue
        now, size = out[-1], len(out[-1]["content"]) + 1 + len(c["content"])
        fresh = c["level"] in (1, 2) and "heading" in c["types"] and len(now["content"]) >= least and not (now["path"] == c["path"] or related(now["path"], c["path"]))
        apart = size > preferred and len(now["content"]) >= least and len(c["content"]) >= least
        if size > most or fresh or apart:
            out.append(dict(c))
            continue
        if now["path"] == c["path"]:
            path = now["path"]
        elif related(now["path"], c["path"]):
            path = max(now["path"], c["path"], key=len)
        else:
            path = common(now["path"], c["path"])
        out[-1] = chunk(now["content"] + "\n" + c["content"], list(dict.fromkeys([*now["types"], *c["types"]])), min(now["level"], c["level"]), path)
    return out


# --- Markdown --------------------------------------------------------------------------------------------------

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_ITEM = re.compile(r"^\s*([-*+]|\d+[.)])\s")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")


def frontmatter(text: str) -> tuple[str | None, str]:
    """(frontmatter, rest): a closed block of dashes at the start that holds at least one ``key:``."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", text, re.S)
    if m and re.search(r"^[A-Za-z_][\w-]*[ \t]*:", m[1], re.M):
        return m[1], text[m.end() :]
    return None, text


def blocks(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, level) of heading, code, table, list, blockquote, media and text blocks; rules are left out."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if not line.strip() or _RULE.match(line):
            i += 1
            continue
        if m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not ((c := _FENCE.match(lines[j])) and c[1][0] == m[1][0] and len(c[1]) >= len(m[1]) and not c[2].strip()):
                j += 1
            yield "code", "\n".join(lines[i : j + 1]), 0
            i = j + 1
            continue
        if m := _HEADING.match(line):
            yield "heading", line.strip(), len(m[1])
            i += 1
            continue
        kind = "table" if "|" in line and i + 1 < len(lines) and re.match(r"^[\s|:-]*-[\s|:-]*$", lines[i + 1]) and "|" in lines[i + 1] else "list" if _ITEM.match(line) else "blockquote" if line.lstrip().startswith(">") else "text"
        j = i
        while j < len(lines) and not _HEADING.match(lines[j]) and not (_FENCE.match(lines[j]) and kind != "list"):
            if not lines[j].strip() and not (kind == "list" and j + 1 < len(lines) and (_ITEM.match(lines[j + 1]) or lines[j + 1].startswith("  "))):
                break
            if j > i and kind == "text" and (_ITEM.match(lines[j]) or lines[j].lstrip().startswith(">") or _RULE.match(lines[j])):
                break
            if kind == "table" and "|" not in lines[j]:
                break
            j += 1
        j = max(j, i + 1)
        body = "\n".join(lines[i:j]).strip("\n")
        yield ("media" if kind == "text" and re.fullmatch(r"\s*!\[[^\]]*\]\([^)]*\)\s*", body) else kind), body, 0
        i = j


def split_list(text: str, size: int) -> list[str]:
    items: list[str] = []
    for line in text.split("\n"):
        if _ITEM.match(line) or not items:
            items.append(line)
        else:
            items[-1] += "\n" + line
    return [s for p in merged(items, size, "\n") for s in split_text(p, size)]


def split_table(text: str, size: int) -> list[str]:
    """Header and separator stand on each piece; a row that does not fit beneath them is an error."""
    lines = text.strip("\n").split("\n")
    if len(text) <= size or len(lines) < 3:
        return [text]
    head = "\n".join(lines[:2])
    room = size - len(head) - 1
    if any(len(r) > room for r in lines[2:]):
        raise ValueError("a row is larger than a chunk")
    return [f"{head}\n{p}" for p in merged(lines[2:], room, "\n")]


def split_code(text: str, size: int) -> list[str]:
    body = text if _FENCE.match(text.split("\n", 1)[0]) else f"```\n{text}\n```"
    if len(body) <= size:
        return [body]
    lines = body.split("\n")
    mark = _FENCE.match(lines[0])[1]
    inner = "\n".join(lines[1:-1] if _FENCE.match(lines[-1]) else lines[1:])
    room = max(1, size - len(lines[0]) - len(mark) - 2)
    parts = merged([s for line in re.findall(r"[^\n]*\n|[^\n]+\Z", inner) for s in slices(line, room)], room)
    return [f"{lines[0]}\n{p.rstrip(chr(10))}\n{mark}" for p in parts]


def recursive(text: str, size: int) -> list[str]:
    """Slices that overlap by a tenth, twenty characters at most: the last resort."""
    step = max(1, size - min(20, size // 10))
    return [text[i : i + size] for i in range(0, max(1, len(text) - (size - step)), step)]


def split_markdown(text: str, preferred: int = PREFERRED_SIZE, most: int = MAX_SIZE) -> list[dict]:
    """Blocks under their headings: a heading opens a section one level below the last higher one."""
    front, rest = frontmatter(text)
    out = [chunk(f"---\n{front}\n---", ["frontmatter"])] if front is not None else []
    stack: list[tuple[int, str]] = []
    how: dict[str, tuple[Callable[[str, int], list[str]], int]] = {"code": (split_code, most), "table": (split_table, most), "list": (split_list, preferred)}
    for kind, body, level in blocks(rest):
        if kind == "heading":
            title = re.sub(r"\s*\{/\*.*?\*/\}\s*$|\s*\{#[^}]*\}\s*$", "", _HEADING.match(body)[2]).strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            body = "#" * level + " " + title
        path = [t for _, t in stack]
        f, size = how.get(kind, (split_text, preferred))
        try:
            pieces = f(body, size)
        except ValueError:
            pieces = recursive(body, size)
        out += [chunk(p, [kind], stack[-1][0] if stack else 0, path) for p in pieces if p.strip()]
    return out


# --- JSON ------------------------------------------------------------------------------------------------------


def split_json(text: str, depth: int = JSON_DEPTH, most: int = JSON_CHUNKS, size: int = MAX_SIZE) -> list[dict]:
    """A chunk for each bracket, property and primitive; joined by line breaks they are the value again. Deeper values are text; invalid ones one chunk; too many chunks fall back to text."""
    try:
        value = json.loads(text)
    except ValueError:
        return [chunk(text, ["code"], 0, ["invalid-json"])] if text.strip() else []
    out: list[dict] = []

    def walk(v, path: list[str], key: str, last: bool, indent: int) -> None:
        pad, comma = "  " * indent, "" if last else ","
        if isinstance(v, (dict, list)) and v and len(path) <= depth:
            a, b = "{}" if isinstance(v, dict) else "[]"
            out.append(chunk(f"{pad}{key}{a}", ["code"], len(path), path))
            items = list(v.items()) if isinstance(v, dict) else [(f"[{i}]", x) for i, x in enumerate(v)]
            for n, (k, x) in enumerate(items):
                walk(x, [*path, k], f"{json.dumps(k, ensure_ascii=False)}: " if isinstance(v, dict) else "", n == len(items) - 1, indent + 1)
            out.append(chunk(f"{pad}{b}{comma}", ["code"], len(path), path))
        else:
            out.append(chunk(f"{pad}{key}{json.dumps(v, ensure_ascii=False)}{comma}", ["code"], len(path), path))

    walk(value, ["root"], "", True, 0)
    return out if len(out) <= most else [c | {"types": ["code"]} for c in split_document(text, size)]


# --- source code -----------------------------------------------------------------------------------------------


def python_boundaries(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, name) from 1: classes and imports structural, outermost functions and methods content."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def visit(node, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                if isinstance(child, ast.ClassDef):
                    out.append((first, child.end_lineno, "structural", child.name))
                    visit(child, inside)
                elif not inside:
                    out.append((first, child.end_lineno, "content", child.name))
                    visit(child, True)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.append((child.lineno, child.end_lineno, "structural", "import"))

    visit(tree, False)
    return out


_TS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|namespace|module|enum|type|function|const|let)\s*\*?\s*([A-Za-z_$][\w$]*)", re.M)
_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*\*?([A-Za-z_$][\w$]*)\s*(?:<[^>{]*>)?\([^;]*?\)\s*(?::[^={]+)?\{", re.M)


def _skip(text: str, i: int) -> int:
    """Behind the string or comment that starts at i, or i."""
    if text.startswith("//", i):
        return (text.find("\n", i) + 1 or len(text) + 1) - 1
    if text.startswith("/*", i):
        return (text.find("*/", i + 2) + 2) if text.find("*/", i + 2) >= 0 else len(text)
    if text[i] in "'\"`":
        j = i + 1
        while j < len(text) and text[j] != text[i]:
            if text[j] == "\n" and text[i] != "`":
                return j
            j += 2 if text[j] == "\\" else 1
        return min(len(text), j + 1)
    return i


def script_boundaries(text: str) -> list[tuple[int, int, str, str]]:
    """The same for TypeScript and JavaScript, by braces: declarations at the top and the methods of classes."""
    depth_at, depth, i = [0] * (len(text) + 1), 0, 0
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            depth_at[i : j + 1] = [depth] * (min(j, len(text)) + 1 - i)
            i = j
            continue
        depth_at[i] = depth
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        i += 1
    line = lambda p: text.count("\n", 0, p) + 1

    def end(start: int) -> int:
        level, p = depth_at[start], start
        seen = False
        while p < len(text):
            q = _skip(text, p)
            if q > p:
                p = q
                continue
            if text[p] == "{":
                seen = True
            if text[p] == "}" and seen and depth_at[p] == level + 1:
                return p
            if not seen and text[p] in ";\n" and depth_at[p] == level and (text[p] == ";" or not text[start:p].rstrip().endswith(("=", "(", ",", "=>", "|", "&"))):
                return p
            p += 1
        return len(text) - 1

    out = []
    for m in _TS.finditer(text):
        at = m.start(1)
        if depth_at[at] != 0:
            continue
        stop = end(at)
        kind = "structural" if m[1] in ("class", "interface", "namespace", "module", "enum", "type") else "content"
        out.append((line(m.start()) if text[m.start()] != "\n" else line(at), line(stop), kind, m[2]))
        if m[1] == "class":
            out += [(line(x.start(1)), line(end(x.start(1))), "content", x[1]) for x in _METHOD.finditer(text, at, stop) if depth_at[x.start(1)] == 1 and x[1] not in ("if", "for", "while", "switch", "catch", "return")]
    return out


def split_source(text: str, language: str = "python", size: int = MAX_SIZE) -> list[dict]:
    """Segments between boundary lines; joined without a separator they are the text. The first segment of a structural boundary is structural, the innermost boundary gives a segment its path."""
    if not text:
        return []
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    found = sorted(python_boundaries(text) if language == "python" else script_boundaries(text), key=lambda b: (b[0], -b[1]))
    cuts = sorted({0, len(lines), *(b[0] - 1 for b in found), *(min(b[1], len(lines)) for b in found)})
    out: list[dict] = []
    carry = ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        body = carry + "".join(lines[a:b])
        if not body.strip():
            carry = body
            continue
        carry = ""
        around = [x for x in found if x[0] - 1 <= a and x[1] >= b]
        opens = [x for x in around if x[0] - 1 == a]
        path = [x[3] for x in around]
        kind = ["code", "structural"] if opens and opens[-1][2] == "structural" else ["code"]
        out += [chunk(p, kind, len(path), path) for p in merged([s for l in re.findall(r"[^\n]*\n|[^\n]+\Z", body) for s in slices(l, size)], size)]
    if carry:
        if out:
            out[-1]["content"] += carry
        else:
            out.append(chunk(carry, ["code"]))
    return out


# --- OpenAPI ---------------------------------------------------------------------------------------------------

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def expanded(node, root: dict, depth: int = 6, budget: list[int] | None = None, seen: tuple[str, ...] = ()):
    """References put in their places: bounded depth and number, a placeholder for a cycle."""
    budget = [100] if budget is None else budget
    if isinstance(node, dict):
        ref = node.get("$ref")
        if isinstance(ref, str) and ref.startswith("#/"):
            if ref in seen or depth <= 0 or budget[0] <= 0:
                return {"$ref": ref}
            budget[0] -= 1
            target = root
            for part in ref[2:].split("/"):
                target = target.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(target, dict) else None
            return expanded(target, root, depth - 1, budget, (*seen, ref))
        return {k: expanded(v, root, depth, budget, seen) for k, v in node.items()}
    if isinstance(node, list):
        return [expanded(v, root, depth, budget, seen) for v in node]
    return node


def split_openapi(text: str, size: int = MAX_SIZE) -> list[dict]:
    """A chunk for each path and method, cut with an ellipsis."""
    try:
        root = json.loads(text)
    except ValueError:
        return split_document(text, size)
    out = []
    for path, item in sorted((root.get("paths") or {}).items()):
        for method in METHODS:
            if isinstance(item, dict) and isinstance(item.get(method), dict):
                op = item[method]
                body = f"# {method.upper()} {path}\n\n{op.get('summary') or op.get('description') or ''}\n\n```json\n{json.dumps(expanded(op, root), ensure_ascii=False, indent=1)}\n```"
                out.append(chunk(body if len(body) <= size else body[: size - 1] + "…", ["code"], 2, [path, method.upper()]))
    return out or split_document(text, size)


def split(text: str, pipeline: str, language: str = "") -> list[dict]:
    """By the conversion that made the text."""
    if pipeline == "json":
        return split_json(text)
    if pipeline == "openapi":
        return split_openapi(text)
    if pipeline == "source":
        return split_source(text, language) if language in ("python", "typescript", "javascript", "tsx", "jsx") else split_document(text)
    if pipeline in ("html", "markdown"):
        return greedy(split_markdown(text))
    return greedy(split_document(text))
