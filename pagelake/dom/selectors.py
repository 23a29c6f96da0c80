"""A subset of CSS selectors: type, *, #id, .class, [attribute] with its operators and the i flag, :not() of these,
:first-child, :last-child, the combinators and lists. An invalid selector raises SelectorError; callers turn it into a value."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from .parser import Node


class SelectorError(ValueError):
    pass


_IDENT = r"(?:-?(?:[_a-zA-Z\u0080-\U0010ffff]|\\.)(?:[-\w\u0080-\U0010ffff]|\\.)*|--(?:[-\w]|\\.)*)"
_SIMPLE = re.compile(
    rf"(?P<type>{_IDENT}|\*)|\#(?P<id>(?:[-\w\u0080-\U0010ffff]|\\.)+)|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[*^$~|]?=)\s*(?:\"(?P<dq>(?:[^\"\\]|\\.)*)\"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<word>{_IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|:(?P<pseudo>first-child|last-child|empty)|:not\((?P<no>[^()]*)\)"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
Test = Callable[[Node], bool]


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    lower = lambda s: s.lower() if fold else s
    want = lower(value)
    if op is None:
        return lambda n: name in n.attrs
    tests = {
        "=": lambda v: v == want,
        "*=": lambda v: bool(want) and want in v,
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "~=": lambda v: bool(want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"),
    }
    test = tests[op]
    return lambda n: name in n.attrs and test(lower(n.attrs[name]))


def _compound(text: str, at: int) -> tuple[Test, int]:
    tests: list[Test] = []
    while m := _SIMPLE.match(text, at):
        if m["type"]:
            if tests:
                raise SelectorError(f"a type follows other parts: {text}")
            want = _plain(m["type"]).lower()
            tests.append((lambda n: True) if want == "*" else lambda n, t=want: n.tag == t)
        elif m["id"]:
            tests.append(lambda n, v=_plain(m["id"]): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=_plain(m["cls"]): v in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["word"]) if v is not None), "")
            tests.append(_attribute(_plain(m["attr"]).lower(), m["op"], _plain(value), (m["flag"] or "").lower() == "i"))
        elif m["no"] is not None:
            inner = compile_selector(m["no"])
            tests.append(lambda n, f=inner: not f(n))
        elif m["pseudo"] == "empty":
            tests.append(lambda n: not n.children)
        else:
            at_end = -1 if m["pseudo"] == "last-child" else 0
            tests.append(lambda n, k=at_end: n.parent is not None and n.parent.elements[k] is n)
        at = m.end()
    if not tests:
        raise SelectorError(f"not a valid selector: {text}")
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), at


def _complex(text: str) -> Test:
    test, at = _compound(text, 0)
    while at < len(text):
        m = _COMBINATOR.match(text, at)
        if not m:
            raise SelectorError(f"not a valid selector: {text}")
        right, at = _compound(text, m.end())
        test = _joined(test, m[1] or " ", right)
    return test


def _joined(left: Test, how: str, right: Test) -> Test:
    def before(n: Node) -> list[Node]:
        return n.parent.elements[: n.parent.elements.index(n)] if n.parent is not None else []

    if how == ">":
        return lambda n: right(n) and n.parent is not None and left(n.parent)
    if how == "+":
        return lambda n: right(n) and bool(b := before(n)) and left(b[-1])
    if how == "~":
        return lambda n: right(n) and any(map(left, before(n)))
    return lambda n: right(n) and n.parent is not None and any(map(left, n.parent.ancestors()))


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> Test:
    parts = re.split(r",(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", selector)
    tests = [_complex(p.strip()) for p in parts]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


def select(scope: Node, selector: str) -> Iterator[Node]:
    """Matching descendants in document order."""
    return filter(compile_selector(selector), scope.descendants())


def first(scope: Node, selector: str) -> Node | None:
    return next(select(scope, selector), None)


def closest(node: Node, selector: str) -> Node | None:
    return next(filter(compile_selector(selector), node.ancestors()), None)


def is_valid(selector: str) -> bool:
    try:
        compile_selector(selector)
    except SelectorError:
        return False
    return True
