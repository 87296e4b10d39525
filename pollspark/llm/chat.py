"""Chat formatting by a small compiler for a sandboxed template language.

The language: text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
one ``{% for name in messages %} {% endfor %}``, ``{% generation %} {% endgeneration %}``
and ``{# comments #}``; expressions have strings, numbers, the message's ``role`` and
``content``, ``loop.first``, ``loop.last``, ``loop.index``, the constants given at
compile time, ``== != + and or not in``, ``a if c else b``, parentheses and filters.
There is nothing else to reach: names and attributes are looked up when compiling.

A template is parsed into a tree, constants are folded (neighbouring text melts
together, decided branches disappear) and each node becomes a Python closure.
Rendering takes messages one by one with one of them ahead, so memory holds two
messages, however long a conversation is.

``escape`` makes any text safe: backslashes are doubled and a backslash breaks each
control string after its first character. ``unescape`` reverts it, so what a model
trains on can be read back without loss.

Cases: null role and text are empty; messages of equal turn are ordered by role and
text; a null conversation id is a conversation; an empty table gives no rows; a
conversation that fills ``PART`` characters goes on in further rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm.common import map_batches, table
from pollspark.session import materialise

#: Strings with a meaning to chat models.
CONTROL = ["<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TEMPLATE = (
    "{{ bos }}{% for message in messages %}{{ turn + (message.role | escape_line) }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}{{ end }}\n{% endfor %}{{ eos }}"
)
CONSTANTS = {"bos": "<s>", "eos": "</s>", "turn": "<|turn|>", "end": "<|end|>"}
#: Characters after which a conversation goes on in a further row.
PART = 1 << 20

_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _BREAK.sub(r"\g<0>\\", text) if "<" in text or "[" in text else text


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
FIELDS = {("message", "role"), ("message", "content"), ("loop", "first"), ("loop", "last"), ("loop", "index")}


class TemplateError(ValueError):
    """A template outside the language."""


_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|().\[\]]))", re.S)
_UNQUOTE = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str, constants: dict, variable: str | None):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.constants, self.variable = 0, constants, variable

    def parse(self) -> tuple:
        node = self._choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def _peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def _take(self, *values: str) -> bool:
        found = self._peek(*values)
        self.at += found
        return found

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise TemplateError(f"{value!r} expected")

    def _choice(self) -> tuple:
        node = self._either()
        if self._take("if"):
            test = self._either()
            self._need("else")
            node = ("choose", test, node, self._choice())
        return node

    def _either(self) -> tuple:
        node = self._both()
        while self._take("or"):
            node = ("or", node, self._both())
        return node

    def _both(self) -> tuple:
        node = self._not()
        while self._take("and"):
            node = ("and", node, self._not())
        return node

    def _not(self) -> tuple:
        return ("not", self._not()) if self._take("not") else self._compare()

    def _compare(self) -> tuple:
        node = self._sum()
        while self._peek("==", "!=", "in"):
            op = self.items[self.at][1]
            self.at += 1
            node = (op, node, self._sum())
        return node

    def _sum(self) -> tuple:
        node = self._filtered()
        while self._take("+"):
            node = ("+", node, self._filtered())
        return node

    def _filtered(self) -> tuple:
        node = self._atom()
        while self._take("|"):
            kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def _atom(self) -> tuple:
        if self._take("("):
            node = self._choice()
            self._need(")")
            return node
        if self.at >= len(self.items):
            raise TemplateError("an expression ends too early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind == "name" and value in self.constants:
            return ("const", self.constants[value])
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in (self.variable, "loop") and self.variable:
            if self._take("["):
                field = self.items[self.at][1][1:-1] if self.at < len(self.items) else ""
                self.at += 1
                self._need("]")
            else:
                self._need(".")
                field = self.items[self.at][1] if self.at < len(self.items) else ""
                self.at += 1
            owner = "loop" if value == "loop" else "message"
            if (owner, field) in FIELDS:
                return ("field", owner, field)
            raise TemplateError(f"no {value}.{field}")
        raise TemplateError(f"unknown name {value!r}")


_OPERATORS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "in": lambda a, b: a in b}


def _fold(node: tuple) -> tuple:
    """The tree with everything computed that needs no message."""
    kind = node[0]
    if kind in ("const", "field"):
        return node
    if kind == "filter":
        inner = _fold(node[2])
        return ("const", FILTERS[node[1]](str(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    parts = [_fold(n) for n in node[1:]]
    if kind == "choose" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        if kind == "not":
            return ("const", not parts[0][1])
        if kind in _OPERATORS:
            return ("const", _OPERATORS[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def _closure(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda _, value=node[1]: value
    if kind == "field":
        return lambda scope, key=node[1:]: scope[key]
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]], inner=_closure(node[2]): f(str(inner(scope)))
    parts = [_closure(n) for n in node[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    if kind == "choose":
        return lambda scope: parts[1](scope) if parts[0](scope) else parts[2](scope)
    return lambda scope, f=_OPERATORS[kind]: f(parts[0](scope), parts[1](scope))


_MARKS = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_LOOP = re.compile(r"for\s+([A-Za-z_]\w*)\s+in\s+messages$")


class Template:
    """A compiled template: ``render(messages)`` yields ``(text, under the generation mark)`` pieces."""

    def __init__(self, source: str = TEMPLATE, constants: dict[str, str] = CONSTANTS):
        self.constants, self.items, self.at, self.variable = constants, [s for s in _MARKS.split(source) if s], 0, None
        self.loops = 0
        top = self._block(())
        loop = next((i for i, n in enumerate(top) if n[0] == "for"), len(top))
        self.before = self._emit(self._melt(top[:loop]))
        self.each = self._emit(self._melt(top[loop][1])) if loop < len(top) else lambda scope: iter(())
        self.after = self._emit(self._melt(top[loop + 1 :]))

    def _expression(self, source: str) -> tuple:
        return _fold(_Expression(source, self.constants, self.variable).parse())

    def _block(self, stops: tuple[str, ...], inside: bool = False) -> list[tuple]:
        nodes = []
        while self.at < len(self.items):
            item = self.items[self.at]
            if item.startswith("{%"):
                tag = item[2:-2].strip("-").strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in stops:
                    return nodes
                self.at += 1
                if word == "if":
                    nodes.append(self._if(tag[2:], inside))
                elif word == "generation":
                    nodes.append(("generation", self._block(("endgeneration",), inside)))
                    self.at += 1
                elif (m := _LOOP.match(tag)) and not self.loops and not inside and not stops:
                    self.loops, self.variable = 1, m[1]
                    nodes.append(("for", self._block(("endfor",), True)))
                    self.variable = None
                    self.at += 1
                else:
                    raise TemplateError(f"unexpected tag {tag!r}")
                continue
            self.at += 1
            if item.startswith("{{"):
                nodes.append(("out", self._expression(item[2:-2])))
            elif not item.startswith("{#"):
                nodes.append(("out", ("const", item)))
        if stops:
            raise TemplateError(f"{stops[-1]!r} is missing")
        return nodes

    def _if(self, test: str, inside: bool) -> tuple:
        condition = self._expression(test)
        body, other = self._block(("elif", "else", "endif"), inside), []
        tag = self.items[self.at][2:-2].strip("-").strip()
        self.at += 1
        if tag.startswith("elif"):
            other = [self._if(tag[4:], inside)]
        elif tag == "else":
            other = self._block(("endif",), inside)
            self.at += 1
        return ("if", condition, body, other)

    def _melt(self, nodes: list[tuple]) -> list[tuple]:
        """Fold decided branches and join neighbouring constants."""
        out: list[tuple] = []
        for node in nodes:
            if node[0] == "if" and node[1][0] == "const":
                new = self._melt(node[2] if node[1][1] else node[3])
            elif node[0] == "if":
                new = [("if", node[1], self._melt(node[2]), self._melt(node[3]))]
            elif node[0] == "generation":
                new = [("generation", self._melt(node[1]))]
            else:
                new = [node]
            for n in new:
                if n[0] == "out" and n[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
                    out[-1] = ("out", ("const", str(out[-1][1][1]) + str(n[1][1])))
                else:
                    out.append(n)
        return out

    def _emit(self, nodes: list[tuple], marked: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        steps = []
        for node in nodes:
            if node[0] == "out":
                steps.append(lambda scope, f=_closure(node[1]): iter([(str(f(scope)), marked)]))
            elif node[0] == "generation":
                steps.append(self._emit(node[1], True))
            else:
                yes, no = self._emit(node[2], marked), self._emit(node[3], marked)
                steps.append(lambda scope, f=_closure(node[1]), yes=yes, no=no: yes(scope) if f(scope) else no(scope))

        def run(scope: dict) -> Iterator[tuple[str, bool]]:
            for step in steps:
                yield from step(scope)

        return run

    def render(self, messages: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, bool]]]:
        """The pieces before the loop, of each message, and after it, as one list each."""
        yield list(self.before({}))
        source = iter(messages)
        now = next(source, None)
        index = 0
        while now is not None:
            ahead = next(source, None)
            index += 1
            scope = {
                ("message", "role"): now[0], ("message", "content"): now[1], ("loop", "first"): index == 1,
                ("loop", "last"): ahead is None, ("loop", "index"): index,
            }
            yield list(self.each(scope))
            now = ahead
        yield list(self.after({}))


@lru_cache(maxsize=8)
def _compiled(source: str, constants: tuple) -> Template:
    return Template(source, dict(constants))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with the same first field, each an iterator that is used up before the next."""
    pending = next(rows, None)
    while pending is not None:
        key, done = pending[0], False

        def run() -> Iterator[tuple]:
            nonlocal pending, done
            while pending is not None and pending[0] == key:
                row, pending = pending, next(rows, None)
                yield row[1:]
            done = True

        group = run()
        yield key, group
        if not done:
            for _ in group:
                pass


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, constants: dict[str, str] = CONSTANTS, part: int = PART
) -> DataFrame:
    """``(conv_id, part, text, loss)`` from rows ``(conv_id, turn, role, text)``.

    ``loss`` lists (start, length) in code points of the row's text. Rows are shuffled
    once by conversation and streamed in order; a task holds one part at a time.
    """
    _compiled(template, tuple(sorted(constants.items())))  # errors before the job
    kind = turns.schema["conv_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        compiled = _compiled(template, tuple(sorted(constants.items())))
        for conv, messages in _groups(_rows(batches)):
            number, size, held, loss = 0, 0, [], []

            def row(conv=conv) -> dict:
                return {"conv": [conv], "part": [number], "text": ["".join(held)], "loss": [[{"start": a, "length": n} for a, n in loss]]}

            for pieces in compiled.render((role or "", text or "") for role, text in messages):
                if size >= part:
                    yield row()
                    number, size, held, loss = number + 1, 0, [], []
                for text, marked in pieces:
                    if marked and text:
                        loss.append((size, len(text)))
                    held.append(text)
                    size += len(text)
            yield row()

    ordered = (
        turns.select("conv_id", "role", "text", "turn").repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )
    return map_batches(ordered, step, f"conv_id {kind}, part int, text string, loss array<struct<start: int, length: int>>")


def parse_turns(text: str, first: bool) -> Iterator[tuple[str, str, int]]:
    """Role, text and start of the text of each turn in a part that ``TEMPLATE`` made."""
    turn, end = CONSTANTS["turn"], CONSTANTS["end"] + "\n"
    at = len(CONSTANTS["bos"]) if first else 0
    while text.startswith(turn, at):
        m = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S).match(text, at + len(turn))
        stop = text.index(end, m.end())
        yield unescape(m[1]), unescape(text[m.end() : stop]), m.end()
        at = stop + len(end)
    if text[at:] not in ("", CONSTANTS["eos"]):
        raise ValueError("text outside of turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from formatted rows alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, parts in _groups(_rows(batches)):
            n_turns = n_loss = n_chars = 0
            turns, losses = hashlib.sha256(), hashlib.sha256()
            for number, text, loss in parts:
                n_chars += len(text)
                for role, said, _ in parse_turns(text, number == 0):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    n_loss += len(said)
                    losses.update(said.encode("utf-8", "surrogatepass"))
            yield {"conv": [conv], "n": [n_turns], "t": [turns.hexdigest()], "l": [n_loss], "d": [losses.hexdigest()], "c": [n_chars]}

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_batches(
        ordered, step,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))]))
    more = spark.range(1).select(tricky.alias("m")).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("m.turn").cast("long").alias("turn"), "m.role", F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return read_back(materialise(format_conversations(turns.unionByName(more))))
