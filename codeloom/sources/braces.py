"""Declarations of languages with braces, found on a copy of the source in which comments and strings are blank."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from codeloom.sources.extract import Extraction

_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_CLOSE = {"{": "}", "(": ")", "[": "]"}
#: What stands before a bracket without being called.
_NO_CALL = frozenset("if for foreach while switch catch function return typeof super import new await constructor using lock nameof sizeof default base this throw when".split())
_STARTS = re.compile(r"\s*(?:export|import|public|private|protected|internal|static|abstract|async|readonly|const|let|var|function|class|interface|enum|type|namespace|using|@|\[|[A-Za-z_$][\w$]*\s*[(:=?;])")
_OPEN_END = re.compile(r"(?:[=,(&|+<>?:]|=>|\b(?:extends|implements|export|async|static|public|private|protected|internal|abstract|default|readonly))$")
_DECORATOR = re.compile(r"\s*@([A-Za-z_$][\w$.]*(?:\((?:[^()]|\([^()]*\))*\))?)")


def blank(source: str) -> str:
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def brackets(text: str) -> dict[int, int]:
    """For each opening bracket where it is closed, in one pass; those that are not close at the end of the text."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[{}()\[\]]", text):
        c = m[0]
        if c in _CLOSE:
            stack.append((_CLOSE[c], m.start()))
        elif stack and c == stack[-1][0]:
            out[stack.pop()[1]] = m.start()
    for _, at in stack:
        out[at] = len(text)
    return out


def open_end(text: str, start: int, at: int) -> bool:
    """Whether what stands before a place, however much white space lies between, can't be a statement's end."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return bool(_OPEN_END.search(text, max(start, at - 40), at))


def statements(r: Reader, a: int, b: int, ends: str = ";") -> Iterator[tuple[str, int, int, int]]:
    """(head, start of head, start of the body in braces or -1, end) between two places."""
    text, pair = r.text, r.pair
    start = i = a
    begun = False  # whether the head has anything but white space
    for_stop = re.compile("[([{\n" + re.escape(ends) + "]")
    while i < b:
        m = for_stop.search(text, i, b)
        if not m:
            break
        begun = begun or not text[i : m.start()].isspace() and m.start() > i
        i, c = m.start(), m[0]
        if c in "([":
            i, begun = pair.get(i, len(text)) + 1, True
            continue
        if c == "{":
            end = min(pair.get(i, len(text)), b)
            yield text[start:i], start, i, end
            i = start = end + 1
            begun = False
            continue
        if c in ends or begun and _STARTS.match(text, i, b) and not open_end(text, start, i):
            yield text[start:i], start, -1, i
            start, begun = i + 1, False
        i += 1
    if text[start:b].strip():
        yield text[start:b], start, -1, b


class Reader:
    def __init__(self, x: Extraction):
        self.x, self.source, self.text = x, x.source, blank(x.source)
        self.breaks = [m.start() for m in re.finditer("\n", self.source)]
        self.pair: dict[int, int] = {}

    def pair_up(self) -> None:
        """Match the brackets of the text as it now is."""
        self.pair = brackets(self.text)

    def hide(self, spans: list[tuple[int, int]]) -> None:
        """Blank some parts of the text, given in order."""
        out, at = [], 0
        for a, b in spans:
            out += [self.text[at:a], re.sub(r"[^\n]", " ", self.text[a:b])]
            at = b
        self.text = "".join([*out, self.text[at:]])

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def begin(self, head: str, at: int) -> int:
        return at + len(head) - len(head.lstrip())

    def comment(self, at: int) -> str | None:
        """The documentation comment right before a place, with its marks."""
        end = at
        while end and self.source[end - 1].isspace():
            end -= 1
        if self.source.endswith("*/", 0, end) and (k := self.source.rfind("/**", 0, end)) >= 0:
            return self.source[k:end]
        top = last = end
        while last > 0:
            begin = self.source.rfind("\n", 0, last) + 1
            if not re.match(r"\s*//", self.source[begin:last]):
                break
            top, last = begin, begin - 1
        return self.source[top:end] or None

    def declare(self, parent: int, kind: str, name: str, head: str, at: int, end: int, words=None, decorators: list[str] | None = None) -> int:
        first = self.begin(head, at)
        text = self.source[first : end + 1]
        return self.x.add(parent, kind, name, self.line(first), self.line(min(end, len(self.source) - 1)), text, self.source[first : at + len(head)], self.comment(first), sorted(words or ()) or None, decorators)

    def uses(self, owner: int, a: int, b: int) -> None:
        """Calls and constructions between two places."""
        for m in re.finditer(r"\bnew\s+([A-Za-z_$][\w$.]*)", self.text[a:b]):
            self.x.use(owner, m[1], "instantiates", self.line(a + m.start()))
        for m in re.finditer(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\??\.)*[A-Za-z_$][\w$]*)(?:<[\w\s,.<>\[\]]*>)?\(", self.text[a:b]):
            if m[1] not in _NO_CALL and not re.search(r"\b(?:new|function)\s+$", self.text[max(a, a + m.start() - 12) : a + m.start()]):
                self.x.use(owner, m[1], "calls", self.line(a + m.start()))


def parts(text: str) -> list[str]:
    """A list of types, cut at its commas, without generic arguments."""
    flat, depth = "", 0
    for c in text:
        depth -= c == ">"
        if depth <= 0 and c != ">":
            flat += "" if c == "<" else c
        depth += c == "<"
    return flat.split(",")


def first_name(text: str) -> str | None:
    m = re.match(r"\s*([A-Za-z_$][\w$.]*)", text)
    return m[1] if m else None


def decorators(r: Reader, head: str, at: int) -> tuple[list[str] | None, str, int]:
    """The decorators that a head begins with, as they are written, and the head and its start behind them."""
    marks, skip = [], 0
    while m := _DECORATOR.match(head, skip):
        marks.append(" ".join(r.source[at + m.start(1) : at + m.end(1)].split()))
        skip = m.end()
    return marks or None, head[skip:], at + skip


def extract_typescript(x: Extraction) -> None:
    r, gone = Reader(x), []
    for m in re.finditer(r"""^[ \t]*import\s+(?:type\s+)?([^'";]*?)\s*(?:from\s*)?["']([^"'\n]+)["'];?""", x.source, re.M):
        node = x.add(x.root, "import", m[2], r.line(m.start()), r.line(m.end()), m[0], m[0].strip(), mark=f"import({m[2]})")
        if named := re.search(r"\{([^}]*)\}", m[1]):
            for part in named[1].split(","):
                x.use(node, part, "imports", r.line(m.start()), 0, m[2])
        gone.append((m.start(), m.end()))
    r.hide(gone)
    r.pair_up()

    def members(owner: int, a: int, b: int, in_interface: bool) -> None:
        waiting: list[str] = []
        for head, at, body, end in statements(r, a, b):
            marks, head, at = decorators(r, head, at)
            waiting += marks or []
            if not head.strip():
                continue
            marks, waiting = waiting or None, []
            words = set(re.findall(r"\b(?:public|private|protected|static|async|abstract|readonly)\b", head.split("(")[0].split(":")[0]))
            plain = re.sub(r"^\s*(?:(?:public|private|protected|static|async|abstract|readonly|override|declare|get|set)\s+)*", "", head)
            call = re.match(r"([#A-Za-z_$][\w$]*)\s*[?!]?\s*(?:<[^(]*>)?\s*\(", plain)
            prop = re.match(r"([#A-Za-z_$][\w$]*)\s*[?!]?\s*(?::\s*([^=]+))?(?:=|$)", plain.strip())
            if call and (body >= 0 or "abstract" in words) and not in_interface:
                node = r.declare(owner, "method", call[1], head, at, end, words, marks)
                if back := re.search(r"\)\s*:\s*([^{]+)$", head.strip()):
                    x.use(node, back[1], "returns", r.line(at))
                if body >= 0:
                    r.uses(node, body + 1, end)
            elif prop or (call and in_interface):
                node = r.declare(owner, "property", (call or prop)[1], head, at, end, words, marks)
                if prop and not call and prop[2]:
                    x.use(node, prop[2], "type_of", r.line(at))

    waiting: list[str] = []  # decorators on lines of their own
    for head, at, body, end in statements(r, 0, len(r.text)):
        marks, head, at = decorators(r, head, at)
        waiting += marks or []
        if not head.strip():
            continue
        marks, waiting = waiting or None, []
        h = head.strip()
        words = {w for w, there in (("export", r"export\b"), ("abstract", r"(?:export\s+)?(?:default\s+)?abstract\b"), ("async", r"[\s\S]*\basync\b")) if re.match(there, h)}
        h = re.sub(r"^(?:(?:export|default|declare|abstract)\s+)+", "", h)
        if body >= 0 and (m := re.match(r"(class|interface)\s+([A-Za-z_$][\w$]*)(.*)", h, re.S)):
            node = r.declare(x.root, m[1], m[2], head, at, end, words - {"async"}, marks)
            rest = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", m[3])
            up, _, via = rest.partition("implements")
            for use, listed in (("extends", up.partition("extends")[2]), ("implements", via)):
                for part in parts(listed):
                    x.use(node, part, use, r.line(r.begin(head, at)))
            members(node, body + 1, end, m[1] == "interface")
        elif body >= 0 and (m := re.match(r"(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)", h)):
            node = r.declare(x.root, "enum", m[1], head, at, end, words & {"export"})
            for part, p, _, q in statements(r, body + 1, end, ",;"):
                if name := first_name(part):
                    r.declare(node, "enum_member", name, part, p, q)
        elif m := re.match(r"type\s+([A-Za-z_$][\w$]*)", h):
            r.declare(x.root, "type_alias", m[1], head, at, end, words & {"export"})
        elif m := re.match(r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", h):
            node = r.declare(x.root, "function", m[1], head, at, end, words)
            if back := re.search(r"\)\s*:\s*([^{]+)$", h):
                x.use(node, back[1], "returns", r.line(at))
            if body >= 0:
                r.uses(node, body + 1, end)
        elif m := re.match(r"(const|let|var)\s+([A-Za-z_$][\w$]*)", h):
            arrow = re.search(r"=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?(?:\([^=]*|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>)", h)
            node = r.declare(x.root, "function" if arrow else m[1], m[2], head, at, end, words - {"abstract"})
            r.uses(node, at + head.find(m[2]) + len(m[2]), end)


def extract_csharp(x: Extraction) -> None:
    r = Reader(x)
    r.pair_up()
    modifier = r"(?:public|private|protected|internal|static|abstract|sealed|partial|async|virtual|override|readonly|const|new|unsafe|extern|required)"

    def shape(head: str) -> tuple[set[str], str]:
        head = re.sub(r"^\s*(?:\[[^\]]*\]\s*)*", "", head)
        words = re.match(rf"\s*((?:{modifier}\s+)*)", head)[1].split()
        return set(words), re.sub(rf"^\s*(?:{modifier}\s+)*", "", head)

    def block(owner: int, a: int, b: int, in_type: str | None) -> None:
        for head, at, body, end in statements(r, a, b):
            words, h = shape(head)
            first = r.line(r.begin(head, at))
            if m := re.match(r"\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*$", head):
                x.add(x.root, "import", m[1], first, first, head, head.strip(), mark=f"using({m[1]})")
            elif m := re.match(r"namespace\s+([\w.]+)", h):
                node = r.declare(owner, "namespace", m[1], head, at, end)
                block(node, body + 1 if body >= 0 else end + 1, end if body >= 0 else b, None)
                if body < 0:
                    return  # a namespace of the whole file
            elif m := re.match(r"(class|struct|record(?:\s+(?:class|struct))?|interface)\s+(\w+)(.*)", h, re.S):
                kind = "interface" if m[1] == "interface" else "struct" if "struct" in m[1] else "class"
                node = r.declare(owner, kind, m[2], head, at, end, words - {"async"})
                rest = re.sub(r"^\s*<[^>]*>", "", re.sub(r"\bwhere\b.*", "", m[3], flags=re.S))
                for part in parts(rest.partition(":")[2]):
                    x.use(node, part, "base", first)
                if body >= 0:
                    block(node, body + 1, end, m[2])
            elif body >= 0 and (m := re.match(r"enum\s+(\w+)", h)):
                node = r.declare(owner, "enum", m[1], head, at, end, words & {"public", "private", "protected", "internal"})
                for part, p, _, q in statements(r, body + 1, end, ",;"):
                    if name := first_name(part):
                        r.declare(node, "enum_member", name, part, p, q)
            elif in_type and (m := re.match(r"(?:([\w.<>\[\],?\s]+?)\s+)?(\w+)\s*(?:<[^(]*>)?\s*\(", h)) and "=" not in h.split("(")[0]:
                node = r.declare(owner, "method", m[2], head, at, end, words)
                if m[1]:
                    x.use(node, m[1], "returns", first)
                r.uses(node, body + 1 if body >= 0 else at + len(head), end)
            elif in_type and body >= 0 and (m := re.match(r"([\w.<>\[\],?\s]+?)\s+(\w+)\s*$", h)):
                r.declare(owner, "property", m[2], head, at, end, words - {"async"})
            elif in_type and body < 0 and (m := re.match(r"([\w.<>\[\],?\s]+?)\s+(\w+)\s*(?:=|$)", h)):
                r.declare(owner, "property" if "=>" in h else "field", m[2], head, at, end, words - {"async"})

    block(x.root, 0, len(r.text), None)
