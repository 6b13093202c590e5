"""A Markdown subset: blocks to rules, and front matter.

Read are ATX and setext headings, bullet and ordered lists (a nested list is text of its top item),
paragraphs, fenced and indented code, block quotes, HTML blocks and thematic breaks; inline code, links,
images, emphasis, escapes, entities and hard breaks. Link reference definitions give no rule. Not read
are tables and footnotes (they are paragraphs).
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from dataclasses import dataclass, field

import yaml

from .paths import split_outside_braces
from .references import references

MAX_NESTING = 100
COMMAND_LANGUAGES = frozenset("bash sh shell zsh console".split())

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])( +|\t|$)")
QUOTE = re.compile(r" {0,3}> ?")
HTML_BLOCK = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
# Elements whose tags end a paragraph.
HTML_ENDS = re.compile(
    r" {0,3}<(?:!--|[?]|![A-Z]|(?:script|pre|style|textarea)(?:[\s>]|$)|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|link|main|menu|nav|ol|option|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I
)
DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+")


@dataclass
class Block:
    kind: str
    start: int
    end: int
    text: str = ""
    depth: int = 0
    inner: list[Block] = field(default_factory=list)


def blocks(lines: list[str], first: int = 1, depth: int = 0) -> list[Block]:
    """Blocks of lines; first is the number of the first line."""
    out: list[Block] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            j = i + 1
            close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            body = [x[min(len(m[1]), len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : j]]
            out.append(Block(f"code {m[3].split()[0]}" if m[3].strip() else "code", first + i, first + min(j, len(lines) - 1), "\n".join(body)))
            i = j + 1
        elif m := HEADING.match(line):
            out.append(Block("heading", first + i, first + i, m[2] or "", len(m[1])))
            i += 1
        elif BREAK.match(line):
            i += 1
        elif QUOTE.match(line):
            j = i
            while j < len(lines) and (QUOTE.match(lines[j]) or (lines[j].strip() and not _interrupts(lines[j]) and QUOTE.match(lines[j - 1]) and QUOTE.sub("", lines[j - 1], count=1).strip())):
                j += 1
            inner = [QUOTE.sub("", x, count=1) for x in lines[i:j]]
            out.append(Block("quote", first + i, first + j - 1, inner=blocks(inner, first + i, depth + 1) if depth < MAX_NESTING else []))
            i = j
        elif m := ITEM.match(line):
            i = _items(lines, i, first, out)
        elif line.startswith(("    ", "\t")):
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
        elif HTML_BLOCK.match(line):
            comment = line.lstrip().startswith("<!--")
            while i < len(lines) and (comment or lines[i].strip()):
                i += 1
                if comment and "-->" in lines[i - 1]:
                    break
        elif DEFINITION.match(line):
            i += 1
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not SETEXT.match(lines[j]) and not _interrupts(lines[j]):
                j += 1
            text = "\n".join(x.strip(" \t") + ("  " if x.endswith("  ") else "") for x in lines[i:j])
            if j < len(lines) and (m := SETEXT.match(lines[j])):
                out.append(Block("heading", first + i, first + j, text, 1 if m[1][0] == "=" else 2))
                j += 1
            else:
                out.append(Block("paragraph", first + i, first + j - 1, text))
            i = j
    return out


def _interrupts(line: str) -> bool:
    item = ITEM.match(line)
    return bool(FENCE.match(line) or HTML_ENDS.match(line) or HEADING.match(line) or BREAK.match(line) or QUOTE.match(line) or (item and line[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1")))


def _items(lines: list[str], i: int, first: int, out: list[Block]) -> int:
    """Items of a list from line i on, as blocks of their text; where the list ends."""
    kind = ITEM.match(lines[i])[2][-1]
    while i < len(lines) and (m := ITEM.match(lines[i])) and m[2][-1] == kind and not BREAK.match(lines[i]):
        indent = len(m[1]) + len(m[2]) + (len(m[3]) if 1 <= len(m[3]) <= 4 and m[3] != "\t" else 1)
        j, last, fence = i + 1, i, None
        while j < len(lines):
            line = lines[j]
            if not line.strip():
                if j + 1 < len(lines) and lines[j + 1].strip() and len(lines[j + 1]) - len(lines[j + 1].lstrip(" ")) < indent:
                    break
            elif len(line) - len(line.lstrip(" ")) >= indent or line.startswith("\t"):
                last = j
            elif _interrupts(line) or ITEM.match(line) or not lines[j - 1].strip() or fence:
                break
            else:
                last = j
            if opened := FENCE.match(line[indent:]):
                fence = None if fence else opened[2]
            j += 1
        body = [lines[i][m.end() :], *(x[indent:] if x[:indent].strip() == "" else x.lstrip() for x in lines[i + 1 : last + 1])]
        out.append(Block("item", first + i, first + last, "\n".join(body)))
        i = last + 1
        while i < len(lines) and not lines[i].strip():
            i += 1
    return i


INLINE = re.compile(
    r"(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|\\(?P<escape>[!-/:-@\[-`{-~])|!\[[^\]]*\]\([^)]*\)"
    r"|\[(?P<label>(?:[^\[\]`]|`[^`]*`|\[[^\]]*\])*)\]\((?P<url><[^>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|</?[A-Za-z][^<>]*>|(?P<mark>\*{1,3}|(?<![A-Za-z0-9])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![A-Za-z0-9]))|(?P<break>(?: {2,}|\\)\n)",
    re.DOTALL,
)


#: Every match of INLINE has one of these.
MARKED = re.compile(r"[`\\\[<*_]|  \n")


def flatten(text: str, depth: int = 0) -> tuple[str, list[str]]:
    """Display text of inline Markdown, code in backticks, and its code spans and relative link targets."""
    spans: list[str] = []
    out: list[str] = []
    last = 0
    for m in INLINE.finditer(text) if MARKED.search(text) else ():
        out.append(html.unescape(text[last : m.start()]))
        last = m.end()
        if m["code"] is not None:
            code = m["code"].replace("\n", " ")
            code = code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code
            spans.append(code)
            out.append(f"`{code}`")
        elif m["escape"]:
            out.append(m["escape"])
        elif m["label"] is not None:
            label, inner = flatten(m["label"], depth + 1) if depth < MAX_NESTING else ("", [])
            spans += inner
            out.append(label)
            url = m["url"].strip("<>")
            if url and not re.match(r"[a-z]+:", url, re.I) and not url.startswith("#"):
                spans.append(url)
        elif m["auto"]:
            out.append(m["auto"])
        elif m["mark"]:
            left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if (not left or left.isspace()) and (not right or right.isspace()):
                out.append(m["mark"])
        elif m["break"]:
            out.append(" ")
    out.append(html.unescape(text[last:]))
    return re.sub(r"\s+", " ", "".join(out)).strip(), spans


def item_text(source: str) -> tuple[str, list[str]]:
    """Text of a list item with all it holds; blocks follow each other without a space, as their texts do."""
    texts, spans = [], []
    todo = [(b, 0) for b in reversed(blocks(source.split("\n")))]
    while todo:
        b, depth = todo.pop()
        if b.kind.startswith("code"):
            texts.append(b.text)
        elif b.kind == "quote":
            todo += [(x, depth + 1) for x in reversed(b.inner)]
        elif b.kind == "item" and depth < MAX_NESTING:
            todo += [(x, depth + 1) for x in reversed(blocks(b.text.split("\n")))]
        else:
            t, s = flatten(b.text)
            texts.append(t)
            spans += s
    return re.sub(r"\s+", " ", "".join(texts)).strip(), spans


def rules(source: str, surface_id: str, offset: int = 0) -> list[dict]:
    """Rules of a document: rule_id, text, section, start_line, end_line, command, refs."""
    headings: list[str] = []
    seen: dict[str, int] = {}
    out: list[dict] = []

    def add(text: str, spans: list[str], b: Block, command: bool = False) -> None:
        if not text.strip():
            return
        mark = hashlib.sha1(text.encode()).hexdigest()[:12]
        seen[mark] = seen.get(mark, 0) + 1
        out.append({
            "rule_id": f"{surface_id}:{mark}" + (f".{seen[mark]}" if seen[mark] > 1 else ""), "text": text, "section": list(headings),
            "start_line": b.start + offset, "end_line": b.end + offset, "command": command, "refs": references(text, spans),
        })

    todo = list(reversed(blocks(source.split("\n"))))
    while todo:
        b = todo.pop()
        if b.kind == "heading":
            headings[:] = [*headings, *[""] * 6][: b.depth - 1] + [flatten(b.text)[0]]
        elif b.kind == "item":
            add(*item_text(b.text), b)
        elif b.kind == "paragraph":
            add(*flatten(b.text), b)
        elif b.kind.startswith("code ") and b.kind[5:] in COMMAND_LANGUAGES:
            add(b.text.strip(), [], b, command=True)
        elif b.kind == "quote":
            todo += reversed(b.inner)
    return out


class Loader(yaml.SafeLoader):
    """YAML whose only booleans are true and false, and without dates."""


Loader.yaml_implicit_resolvers = {
    c: [(tag, r) for tag, r in found if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for c, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

# Keys and values that a tool reads although YAML doesn't.
LENIENT = {
    "cursor-rule": {"description": r".*", "globs": r"[A-Za-z0-9_@*?./{}, -]*", "alwaysApply": r"true|false"},
    "windsurf-rule": {"description": r".*", "trigger": r"always_on|manual|model_decision|glob", "globs": r"[A-Za-z0-9_@*?./{}, -]*"},
}
TRIGGERS = frozenset("always_on manual model_decision glob".split())


def front_matter(raw: str, kind: str) -> tuple[dict, str, str | None]:
    """Data, body, and the error if the tool can't read it."""
    lines = raw.split("\n")
    if not re.fullmatch(r"-{3}\s*", lines[0]):
        return {}, raw, None
    close = next((i for i in range(1, len(lines)) if re.fullmatch(r"-{3}\s*", lines[i])), None)
    inner = lines[1 : close if close is not None else len(lines)]
    try:
        data = yaml.load("\n".join(inner), Loader)  # noqa: S506  a safe loader
        if data is not None and not isinstance(data, dict):
            raise yaml.YAMLError("not a mapping")
        return data or {}, "\n".join(lines[close + 1 :]) if close is not None else "", None
    except yaml.YAMLError as e:
        error = str(e).split("\n")[0]
    end = next((i for i in range(1, len(lines)) if re.fullmatch(r"-{2,}\s*", lines[i])), None)
    body = "\n".join(lines[end + 1 :]) if end is not None else raw
    known, data = LENIENT.get(kind, {}), {}
    for line in inner if close is not None else ["?"]:
        if not line.strip() or line.strip().startswith("#"):
            continue
        m = re.match(r"([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*?)\s*$", line)
        if not m or m[1] not in known or not re.fullmatch(known[m[1]], m[2]):
            return {}, body, error
        data[m[1]] = {"true": True, "false": False}.get(m[2], m[2])
    return (data, body, None) if data else ({}, body, error)


def globs_of(value: object) -> list[str] | None:
    if isinstance(value, list):
        return list(map(str, value))
    return split_outside_braces(value, trim=True) if isinstance(value, str) else None


def parse_surface(path: str, kind: str, surface_id: str, raw: str) -> tuple[list[dict], dict]:
    """Rules of a surface, and its meta: description, globs, always_apply, trigger, frontmatter_error, and front_matter with all keys as JSON text."""
    meta: dict = {"description": None, "globs": None, "always_apply": None, "trigger": None, "frontmatter_error": None, "front_matter": None}
    if kind not in ("cursor-rule", "windsurf-rule", "skill") or path.endswith(".windsurfrules"):
        return rules(raw, surface_id), meta
    data, body, error = front_matter(raw, kind)
    meta["frontmatter_error"] = error
    meta["front_matter"] = json.dumps(data, ensure_ascii=False, default=str, skipkeys=True) if data else None
    if isinstance(data.get("description"), str):
        meta["description"] = data["description"]
    meta["globs"] = globs_of(data.get("globs"))
    if isinstance(data.get("alwaysApply"), bool):
        meta["always_apply"] = data["alwaysApply"]
    if data.get("trigger") in TRIGGERS:
        meta["trigger"] = data["trigger"]
    return rules(body, surface_id, raw.count("\n") - body.count("\n")), meta
