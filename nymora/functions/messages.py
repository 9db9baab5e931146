"""Which strings of a JSON document or chat message are text to mask: their token, inner token, value and field name.

Styles: ``values`` (every string value of a document, HAR context included), ``blocks`` (messages of typed blocks: text, tool use and
results, documents, search results), ``chat`` (content parts, refusals, function and custom tool calls), ``items`` (message, call, call
output and reasoning items). Anything else in a message is opaque: images, binary sources, citations, ids, encrypted content.
An ``inner`` of -1 is the token itself; otherwise the token is a JSON document of arguments, and inner counts its tokens.
"""

from __future__ import annotations

from typing import NamedTuple

from .json_text import Token, document, replaced, string_tokens

STYLES = ("values", "blocks", "chat", "items")


class Part(NamedTuple):
    token: int
    inner: int
    text: str
    field: str | None
    is_key: bool = False


class _Doc:
    def __init__(self, text: str):
        self.root, self.tokens = document(text)
        self.parts: list[Part] = []

    @staticmethod
    def get(node, key: str):
        """The last value of a key, as JSON readers do."""
        return next((child for name, child in reversed(node[1]) if name == key), None) if node is not None and node[0] == "o" else None

    def string(self, node) -> str | None:
        return self.tokens[node[1]].value if node is not None and node[0] == "s" else None

    def items(self, node) -> list:
        return node[1] if node is not None and node[0] == "a" else []

    def add(self, node, field: str | None = None) -> None:
        if self.string(node) is not None:
            self.parts.append(Part(node[1], -1, self.string(node), field))

    def add_tree(self, node, field: str | None = None) -> None:
        """All string values below, with their keys as fields."""
        if node is None or node[0] == "x":
            return
        if node[0] == "s":
            self.add(node, field)
        for entry in node[1] if node[0] in "oa" else ():
            self.add_tree(*((entry[1], entry[0]) if node[0] == "o" else (entry, None)))

    def add_arguments(self, node) -> None:
        """A string that is itself a JSON document; ValueError if it isn't one."""
        text = self.string(node)
        if text is not None:
            for i, t in enumerate(string_tokens(text)):
                self.parts.append(Part(node[1], i, t.value, None if t.is_key else t.field_name, t.is_key))

    # --- blocks ---------------------------------------------------------------------------------------------------

    def content(self, node) -> None:
        self.add(node)
        for b in self.items(node):
            self.block(b)

    def block(self, b) -> None:
        kind = self.string(self.get(b, "type"))
        if kind == "text":
            self.add(self.get(b, "text"))
        elif kind == "tool_result":
            self.content(self.get(b, "content"))
        elif kind == "tool_use":
            self.add_tree(self.get(b, "input"))
        elif kind == "search_result":
            for key in ("source", "title"):
                self.add(self.get(b, key))
            for x in self.items(self.get(b, "content")):
                self.block(x)
        elif kind == "document":
            for key in ("title", "context"):
                self.add(self.get(b, key))
            source = self.get(b, "source")
            inside = self.string(self.get(source, "type"))
            if inside == "text":
                self.add(self.get(source, "data"))
            elif inside == "content":
                self.content(self.get(source, "content"))

    # --- chat and items ----------------------------------------------------------------------------------------------

    def typed_parts(self, node, kinds: tuple[str, ...]) -> None:
        self.add(node)
        for p in self.items(node):
            kind = self.string(self.get(p, "type"))
            self.add(self.get(p, "text") if kind in kinds else self.get(p, "refusal") if kind == "refusal" else None)

    def chat(self, m) -> None:
        self.typed_parts(self.get(m, "content"), ("text",))
        self.add(self.get(m, "refusal"))
        self.add_arguments(self.get(self.get(m, "function_call"), "arguments"))
        for call in self.items(self.get(m, "tool_calls")):
            self.add_arguments(self.get(self.get(call, "function"), "arguments"))
            self.add(self.get(self.get(call, "custom"), "input"))

    def item(self, m) -> None:
        kind = self.string(self.get(m, "type"))
        texts = ("input_text", "output_text", "text")
        if kind == "message" or kind is None and self.get(m, "role") is not None:
            self.typed_parts(self.get(m, "content"), texts)
        elif kind == "function_call":
            self.add_arguments(self.get(m, "arguments"))
        elif kind in ("function_call_output", "custom_tool_call_output"):
            self.typed_parts(self.get(m, "output"), texts)
        elif kind == "custom_tool_call":
            self.add(self.get(m, "input"))
        elif kind == "reasoning":
            for s in self.items(self.get(m, "summary")):
                self.add(self.get(s, "text"))


def parts(text: str, style: str) -> list[Part]:
    """The strings to mask in document order. ValueError if the text (or its arguments) isn't JSON."""
    if style == "values":
        return [Part(i, -1, t.value, None if t.is_key else t.field_name, t.is_key) for i, t in enumerate(string_tokens(text))]
    doc = _Doc(text)
    for m in doc.items(doc.root) if doc.root[0] == "a" else [doc.root]:
        if style == "blocks":
            doc.content(doc.get(m, "content"))
        elif style == "chat":
            doc.chat(m)
        elif m[0] == "s":
            doc.add(m)
        else:
            doc.item(m)
    return sorted(doc.parts)


def rebuilt(text: str, values: dict[tuple[int, int], str]) -> str:
    """``text`` with the given (token, inner) values in place of theirs; the rest keeps its spelling."""
    tokens = document(text)[1]
    changes: list[tuple[Token, str]] = []
    for number in sorted({t for t, _ in values}):
        token = tokens[number]
        if (number, -1) in values:
            changes.append((token, values[number, -1]))
            continue
        inner = document(token.value)[1]
        own = sorted((i, v) for (t, i), v in values.items() if t == number)
        changes.append((token, replaced(token.value, [(inner[i], v) for i, v in own])))
    return replaced(text, changes)
