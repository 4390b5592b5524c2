"""Token ids of whole texts with a tokenizer file, for the operators that store or pack ids.

Both kinds of files cut a text by a pattern before they look for tokens.  A text of plain characters
(ASCII and letters on which all libraries agree) is cut by that pattern here; any other one where
white space follows something else, which no token crosses.  The pieces' ids, each found once per
worker and kept in a memory of bounded size, joined together are the text's ids.  Texts that hold an
added token's string or one of the control characters that libraries class differently are encoded
in one go.
"""

from __future__ import annotations

import json
import re
import unicodedata
import weakref
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: Pieces kept per generation and worker.
KEPT = 450_000
#: Characters worked on at once.
SLICE = 1 << 20
#: Letters from here up to there are plain, but those whose lower case depends on their neighbours or is longer.
PLAIN_FROM, PLAIN_TO, ODD_CASES = "\u00c0", "\u0250", frozenset("\u0130")

# The patterns of the two kinds of files, for plain characters; one keeps a blank with what follows.
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_MORE = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WITH_BLANKS = re.compile(rf" ?[A-Za-z{_MORE}]+|{_SHORT}| ?[0-9]+| ?[^\sA-Za-z0-9{_MORE}]+|\s+(?!\S)|\s+")
_WITHOUT_BLANKS = re.compile(rf"[a-z{_MORE}]+|{_SHORT}|[0-9]|[^\sa-z0-9{_MORE}]+")


_ODD = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"\s*\S+|\s+")
_LOADED: dict[tuple, TextEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizer file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """What was found for the latest pieces: two generations, so a full one costs no search.

    A worker may serve several operators in turn; once another ``owner`` learns, what the others
    hold is let go.
    """

    everyone: weakref.WeakSet[Memory] = weakref.WeakSet()
    current: str = ""

    def __init__(self, find, owner: str, kept: int = KEPT):
        self.find, self.owner, self.kept, self.young, self.old = find, owner, kept, {}, {}
        Memory.everyone.add(self)

    def claim(self) -> None:
        """Let go of what other owners hold."""
        if Memory.current != self.owner:
            Memory.current = self.owner
            for other in Memory.everyone:
                if other.owner != self.owner:
                    other.forget()

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def learn(self, lists: list[list]) -> None:
        """Find what is not known of these lists of pieces, all at once; ``young`` has it all then."""
        self.claim()
        missing = set().union(*lists).difference(self.young)
        if missing and len(self.young) + len(missing) > self.kept and self.young:
            self.old, self.young = self.young, {}
            missing = set().union(*lists)
        known = missing.intersection(self.old)
        for piece in known:
            self.young[piece] = self.old[piece]
        if new := list(missing.difference(known)):
            self.young.update(zip(new, self.find(new), strict=True))

    def look(self, pieces: list) -> list:
        return list(map(self.young.__getitem__, pieces))


class PieceMemory(Memory):
    """A memory that finds a piece when it is first looked up; ``find`` gets one piece."""

    def __init__(self, find, owner: str, kept: int = KEPT):
        super().__init__(find, owner, kept)
        self.forget()

    def forget(self) -> None:
        self.young, self.old = _Found(self), {}


class _Found(dict):
    def __init__(self, memory: PieceMemory):
        super().__init__()
        self.memory = weakref.proxy(memory)

    def __missing__(self, piece):
        memory = self.memory
        found = memory.old.get(piece)
        if found is None:
            found = memory.find(piece)
        if len(self) >= memory.kept:
            memory.old = dict(self)
            self.clear()
        self[piece] = found
        return found


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, together about SLICE characters or a single longer one."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut where white space follows something else."""
    at = 0
    while len(text) - at > SLICE:
        cut = re.compile(r"(?<=\S)\s").search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level files write a byte as: itself if it is printed, else one from 256 on, in order."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printed)
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()


def is_plain(char: str) -> bool:
    """Whether all libraries class, compose and lower-case the character alike."""
    if char < "\x80":
        return not "\x1c" <= char <= "\x1f"
    low = char.lower()
    letter = PLAIN_FROM <= char < PLAIN_TO and unicodedata.category(char)[0] == "L" and char not in ODD_CASES
    return letter and len(low) == 1 and low < PLAIN_TO and unicodedata.is_normalized("NFC", char + low)


def cutter(path: str) -> Callable[[str], list[str]] | None:
    """A function from a plain text to the pieces in which the file's tokenizer looks for tokens; null for other files."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    first = parts["pre_tokenizer"]
    if parts["normalizer"] is None and first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return _WITH_BLANKS.findall
    kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    split = first.get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
    if kinds == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return lambda text: _WITHOUT_BLANKS.findall(text.lower())
    return None


class TextEncoder:
    """ids of texts as arrays; equals the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cut = cutter(path)
        self.plain: set[str] = set()
        # pieces of plain texts are what the model gets; others still go through the whole tokenizer
        self.model = self.tokenizer.model
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memory = PieceMemory(self._find_plain, path)
        self.others = Memory(self._find, path)

    def _is_odd(self, text: str) -> bool:
        """Whether the text is to be encoded in one go."""
        return "<|" in text or not self._is_plain(text) and bool(_ODD.search(text))

    def _is_plain(self, text: str) -> bool:
        if text.isascii():
            return not _ODD.search(text)
        unknown = set(text).difference(self.plain)
        if not unknown:
            return True
        self.plain.update(filter(is_plain, unknown))
        return unknown <= self.plain

    def _pieces(self, text: str) -> tuple[Memory, list[str]]:
        """What to look up for the text, and where."""
        if self.cut and self._is_plain(text):
            return self.memory, self.cut(text)
        return self.others, _PIECES.findall(text)

    def _find_plain(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", BYTE_SIGNS[32])
        else:
            shown = piece.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array(self.code, [token.id for token in self.model.tokenize(shown)]).tobytes()

    def _find(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return [np.array(one.ids, self.kind).tobytes() for one in found]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids of each text in turn."""
        self.memory.claim()
        for group in groups(texts):
            whole = [self._is_odd(t) for t in group]
            parts = [[] if odd else list(slices(t)) for t, odd in zip(group, whole, strict=True)]
            single = len(group) == 1 and len(parts[0]) > 1
            if not single:
                lists = [[self._pieces(x) for x in cut] for cut in parts]
                self.others.learn([pieces for own in lists for of, pieces in own if of is self.others])
            for place, text in enumerate(group):
                if whole[place]:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
                elif single:
                    yield np.frombuffer(b"".join(map(self._part, parts[0])), self.kind)
                else:
                    yield np.frombuffer(b"".join(b"".join(of.look(pieces)) for of, pieces in lists[place]), self.kind)

    def _part(self, part: str) -> bytes:
        memory, pieces = self._pieces(part)
        if memory is self.others:
            memory.learn([pieces])
        return b"".join(memory.look(pieces))


def encoder(path: str) -> TextEncoder:
    """The encoder of a file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]
