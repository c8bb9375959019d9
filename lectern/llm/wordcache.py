"""Tokenising piece by piece with a bounded cache in each Python worker, for tokenisers that never join two pieces."""

from __future__ import annotations

from collections.abc import Callable

from .shared import AT_END

#: Pieces that a cache holds; with their ids they take about 200 bytes each.
LIMIT = 400_000


class WordCache:
    """piece (bytes) -> its token ids as little-endian unsigned 32-bit bytes. Emptied at the end of each task."""

    def __init__(self, encode: Callable[[list[bytes], dict[bytes, bytes]], list[bytes]], limit: int = LIMIT):
        self.encode, self.limit, self.known = encode, limit, {}
        AT_END.append(self.known.clear)

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of pieces."""
        known = self.known
        wanted = set().union(*texts)
        missing = list(wanted.difference(known))
        if len(known) + len(missing) > self.limit:  # the pieces at hand stay, frequent ones among them
            for piece in known.keys() - wanted:
                del known[piece]
        known.update(zip(missing, self.encode(missing, known)))
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]
