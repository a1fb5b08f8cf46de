"""Byte-pair encoding by prefix dynamic programming."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

import regex

#: Fixed value: the public pattern that splits text before merges of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pieces, and token pairs, that a task remembers before it starts anew.
MEMO = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class _Memo(dict):
    """A dictionary that computes what it lacks, and forgets all when it is full."""

    def __init__(self, compute, most: int = MEMO):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PrefixEncoder:
    """Exact byte-pair encoding through the last token of every prefix.

    For each prefix of a piece exactly one token can be the last of its encoding: a suffix of the prefix that may follow the
    last token of what is before it. Two tokens may follow one another if merging their joined bytes gives back these two.
    So one table of last tokens holds the encodings of all prefixes: appended bytes only extend it, and after an edit it is
    valid again as soon as it agrees with the old table over the length of the longest token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = _Memo(self._may_follow)
        self.pieces = _Memo(lambda piece: tuple(self.encode_bytes(piece.encode("utf-8", "surrogatepass"))))

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        parts = [self.tokens[t] for t in pair if t >= 0]
        wanted, joined = list(parts), [bytes([b]) for b in b"".join(parts)]
        while len(joined) > len(wanted):
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(joined, joined[1:], strict=False))))
            if rank == 1 << 60:
                break
            joined[at : at + 2] = [joined[at] + joined[at + 1]]
        if joined != wanted:
            return False
        return len(parts) < 2 or parts[0] + parts[1] not in self.ranks

    def extend(self, data: bytes, last: list[int], start: int, stop: int | None = None) -> None:
        """Fill ``last`` (the last token of each prefix of ``data``, by its end) from the byte ``start`` on, up to ``stop``."""
        ranks, pairs, longest = self.ranks, self.pairs, self.longest
        for end in range(start + 1, (len(data) if stop is None else stop) + 1):
            for begin in range(max(0, end - longest), end):
                token = ranks.get(data[begin:end])
                if token is not None and pairs[(last[begin] if begin else -1), token]:
                    last[end] = token
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def table(self, data: bytes) -> list[int]:
        last = [-1] * (len(data) + 1)
        self.extend(data, last, 0)
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at ``end``."""
        end, out = len(last) - 1 if end is None else end, []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.pairs[-1, whole]:
            return [whole]
        return self.read(self.table(data))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of ``data + more``; nothing of the old table is computed again."""
        joined = data + more
        last = last + [-1] * len(more)
        self.extend(joined, last, len(data))
        return joined, last

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The table after ``data[start:end]`` became ``new``; stops where it agrees with the old one again."""
        joined = data[:start] + new + data[end:]
        shift, table, same = len(joined) - len(data), last[: start + 1], 0
        table += [-1] * (len(joined) - start)
        for at in range(start, len(joined)):
            self.extend(joined, table, at, at + 1)
            old = at + 1 - shift
            same = same + 1 if at + 1 >= start + len(new) and old > end and table[at + 1] == last[old] else 0
            if same >= self.longest:
                table[at + 2 :] = last[old + 1 :]
                break
        return joined, table

    def encode(self, text: str) -> Iterable[int]:
        """The ids of a text, without special tokens."""
        pieces = self.pieces
        return [t for piece in self.split(text) for t in pieces[piece]]


class EncodedText:
    """A text whose encoding stays exact while it is appended to and edited: its pieces with the table of each.

    The pattern looks at most one character ahead and none back, so pieces that end before the last character in front of a change stand,
    and from the first old border behind it on all pieces stand again. Only those between are split anew, and of the first of them
    the table is kept as far as its bytes are the old ones.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder = encoder
        self.pieces = [self._piece(p) for p in encoder.split(text)]

    def _piece(self, piece: str, old: tuple[bytes, list[int]] | None = None) -> tuple[str, bytes, list[int]]:
        data = piece.encode("utf-8", "surrogatepass")
        same = len(os.path.commonprefix([old[0], data])) if old else 0
        last = (old[1][: same + 1] if old else [-1]) + [-1] * (len(data) - same)
        self.encoder.extend(data, last, same)
        return piece, data, last

    @property
    def text(self) -> str:
        return "".join(p for p, _, _ in self.pieces)

    @property
    def ids(self) -> list[int]:
        return [t for _, _, last in self.pieces for t in self.encoder.read(last)]

    def append(self, more: str) -> None:
        n = sum(len(p) for p, _, _ in self.pieces)
        self.edit(n, n, more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters ``start`` to ``end`` by ``new``."""
        kept, at = 0, 0
        while kept < len(self.pieces) and at + len(self.pieces[kept][0]) < start:
            at += len(self.pieces[kept][0])
            kept += 1
        old = "".join(p for p, _, _ in self.pieces[kept:])
        changed, place, borders = old[: start - at] + new + old[end - at :], at, {}
        for k in range(kept, len(self.pieces)):
            if place >= end:
                borders[place - at + len(new) - (end - start)] = k
            place += len(self.pieces[k][0])
        made, rest = [], []
        for hit in self.encoder.pattern.finditer(changed):
            if hit.start() in borders:
                rest = self.pieces[borders[hit.start()] :]
                break
            before = self.pieces[kept][1:] if not made and kept < len(self.pieces) else None
            made.append(self._piece(hit[0], before))
        self.pieces[kept:] = made + rest
