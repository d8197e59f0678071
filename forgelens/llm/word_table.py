"""A bounded table from words to encoded bytes, for encoders that treat the words of a text one by one."""

from collections.abc import Callable
from itertools import filterfalse

CAPACITY = 500_000
MARKS = 1 << 23


class WordTable:
    """Keeps words that were met in two groups of texts: most words of a corpus occur once and would fill it.

    Holds between ``capacity`` and twice as many words: those met since the last but one time it was full.  A byte
    per hash value tells whether a word (or another one with that value) was met before.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], capacity: int = CAPACITY):
        self.encode, self.capacity = encode, capacity
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    def _first_time(self, word: str) -> bool:
        at = hash(word) % MARKS
        if self.marks[at]:
            return False
        self.marks[at] = 1
        self.marked += 1
        return True

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The bytes of all words of each text; words not held are encoded together."""
        unknown: set[str] = set()
        for words in texts:
            unknown.update(filterfalse(self.recent.__contains__, words))
        if len(self.recent) > self.capacity:
            self.older, self.recent = self.recent, {}
            unknown = set().union(*texts)
        known = unknown & self.older.keys()
        self.recent.update((word, self.older[word]) for word in known)
        missing = sorted(unknown - known)
        self.recent.update(zip(missing, self.encode(missing) if missing else ()))
        out = [b"".join(map(self.recent.__getitem__, words)) for words in texts]
        for word in filter(self._first_time, missing):
            del self.recent[word]
        if self.marked > MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        return out


def grouped(texts: list[str | None], chars: int):
    """Runs of texts of about ``chars`` characters; null becomes empty."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    yield group
