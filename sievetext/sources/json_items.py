"""The items of a JSON list of any length, one at a time.

The text is read in blocks; a stack of open brackets says where an item of the outer list ends.
What is held is one block and one item, never the list.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

READ_BYTES = 1 << 20
SPACE = " \t\n\r"

_STRUCTURE = re.compile(r'["\[\]{},]')
_STRING_END = re.compile(r'["\\]')
_CLOSES = {"]": "[", "}": "{"}


def decoded(stream) -> Iterator[str]:
    """The stream's text in blocks; broken bytes are replaced, whatever blocks they fall into."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    while block := stream.read(READ_BYTES):
        yield decoder.decode(block)
    yield decoder.decode(b"", final=True)


def list_items(texts: Iterator[str]) -> Iterator[str]:
    """The raw text of each item of a top-level list.

    Raises ValueError where brackets do not match, where the list does not end, and where text
    follows it.  Items themselves are not parsed.
    """
    held: list[str] = []
    stack: list[str] = []
    in_string = escaped = ended = False
    items = 0
    for text in texts:
        at = begin = 0
        while at < len(text):
            if ended or not stack:
                rest = text[at:].lstrip(SPACE)
                if not rest:
                    break
                if ended or rest[0] != "[":
                    raise ValueError("text after the list" if ended else "not a list")
                at = begin = len(text) - len(rest) + 1
                stack.append("[")
            elif escaped:
                escaped, at = False, at + 1
            elif in_string:
                found = _STRING_END.search(text, at)
                if not found:
                    break
                at = found.end()
                in_string, escaped = found[0] != '"', found[0] == "\\"
            else:
                found = _STRUCTURE.search(text, at)
                if not found:
                    break
                at, mark = found.end(), found[0]
                if mark == '"':
                    in_string = True
                elif mark in "[{":
                    stack.append(mark)
                elif mark != ",":
                    if stack.pop() != _CLOSES[mark]:
                        raise ValueError("brackets do not match")
                if mark == "," and len(stack) == 1 or not stack:
                    item = "".join([*held, text[begin : at - 1]]).strip(SPACE)
                    held, begin, ended = [], at, not stack
                    if item or items or not ended:
                        items += 1
                        yield item
        if not ended and stack:
            held.append(text[begin:])
    if not ended:
        raise ValueError("the list does not end")


def check(item: str) -> None:
    """Raise ValueError unless the item is valid JSON."""
    try:
        json.loads(item, parse_int=str, parse_float=str)
    except RecursionError:
        raise ValueError("an item is nested too deeply") from None


def checked_items(texts: Iterator[str]) -> Iterator[str]:
    for item in list_items(texts):
        check(item)
        yield item


def item_blocks(items: Iterator[str], size: int) -> Iterator[tuple[str | None, str]]:
    """Items as lists of about ``size`` characters: (the first item of all, list); it is null for the first list."""
    head, held, length = None, [], 0
    for item in items:
        if held and length + len(item) > size:
            yield head, f"[{','.join(held)}]"
            head = first if head is None else head
            held, length = [], 0
        if head is None and not held:
            first = item
        held.append(item)
        length += len(item) + 1
    if held:
        yield head, f"[{','.join(held)}]"
