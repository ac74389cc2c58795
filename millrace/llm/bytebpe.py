"""Byte-level BPE: vocabulary files, units of text that are encoded apart, and the replay of merges.

A text is cut wherever white space follows something else. Each unit (a run of white space with the
other characters behind it) is split by the pretokenizer exactly as inside the whole text, if no match
of the pattern has white space behind another character and it looks at most one character ahead: that
character lies in the unit, or the text ends there.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterable

import numpy as np

#: Unicode's White_Space, as the pretokenizers' \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

ID = np.dtype("<u4")


def ranks_of_tiktoken(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 stays, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(text: str) -> dict[bytes, int]:
    """Token bytes to id of a byte-level vocabulary in JSON; its added tokens are left out."""
    spec, letters = json.loads(text), _byte_alphabet()
    added = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


class MergeReplay:
    """Encodes many words together by replaying merges in rank order over an inverted index.

    The index leads from a rank, which names the pairs that merge to it, to the positions of those
    pairs in all words. The lowest rank is applied to all its positions at once, and only the pairs
    beside a merged position are looked up and indexed anew. A word sees its merges in the order in
    which it would see them alone, lowest rank first and from the left: of overlapping pairs every
    other one is merged, and where a merge makes a pair of a lower rank, the rest of that word waits.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = r
        self.pairs = np.fromiter(sorted(merges), np.int64, len(merges))
        self.merged = np.array([*[merges[x] for x in self.pairs.tolist()], -1], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if it doesn't merge; a token of -1 is none."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = -1
        return np.where(self.pairs[at] == pair, self.merged[at], -1) if len(self.pairs) else np.full(len(pair), -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(sizes)
        if not n:
            return [b"" for _ in words]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        token = self.single[raw]
        # a place behind all others, which stands for no neighbour
        token, after, before, now = (np.append(x, -1) for x in (token, after, before, np.full(n, -1)))
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = [*(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            start = 0
            for r, end in zip(rank[[0, *cuts[:-1]]].tolist(), cuts):
                if r in index:
                    index[r].append(at[start:end])
                else:
                    index[r] = [at[start:end]]
                    heapq.heappush(heap, r)
                start = end

        inner = np.flatnonzero(after[:n] >= 0)
        now[inner] = self._ranks(token[inner], token[inner + 1])
        inner = inner[now[inner] >= 0]
        if len(inner):
            add(inner, now[inner])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[now[p] == r]  # the others have lost a token to a neighbour
            if not len(p):
                continue
            q = after[p]
            beside = p[1:] == q[:-1]
            if beside.any():  # of pairs that overlap, the first, the third and so on
                run = np.flatnonzero(np.concatenate([[True], ~beside]))
                nth = np.arange(len(p)) - np.repeat(run, np.diff(np.append(run, len(p))))
                p, q = p[nth % 2 == 0], q[nth % 2 == 0]
            right, left = after[q], before[p]
            joined = np.zeros(len(p), bool)  # the pair merged just before stands on the left
            joined[1:] = right[:-1] == p[1:]
            on_right = self._ranks(np.full(len(p), r), token[right])
            on_left = self._ranks(np.where(joined, r, token[left]), np.full(len(p), r))
            lower = ((on_right >= 0) & (on_right < r)) | ((on_left >= 0) & (on_left < r))
            if lower.any():
                word, passed = owner[p], np.cumsum(lower) - lower
                waits = passed > passed[np.searchsorted(word, word)]
                if waits.any():
                    index[r] = [p[waits]]
                    heapq.heappush(heap, r)
                    go = ~waits
                    p, q, right, left, joined, on_right, on_left = (x[go] for x in (p, q, right, left, joined, on_right, on_left))
            token[p], token[q], now[q] = r, -1, -1
            after[p], before[right] = right, p
            if joined.any():
                on_right = self._ranks(np.full(len(p), r), token[right])
            now[p] = on_right
            alone = ~joined & (left >= 0)
            left, on_left = left[alone], on_left[alone]
            now[left] = on_left
            at, rank = np.concatenate([p, left]), np.concatenate([on_right, on_left])
            some = rank >= 0
            if some.any():
                add(at[some], rank[some])
        kept = np.concatenate([[0], np.cumsum(token[:n] >= 0)])
        flat, out, start = token[token >= 0].astype(ID).tobytes(), [], 0
        for e in (kept[ends] * ID.itemsize).tolist():
            out.append(flat[start:e])
            start = e
        return out


def parted(text: str) -> list[str] | None:
    """The units of a text by its spaces and line feeds: the first as it is, the others without their space.

    None if white space stands at an end, beside other white space, or is of another kind; ``UNIT`` cuts these.
    """
    odd = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in odd) or not text.isascii() and _WIDE.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def whole(part: str) -> str:
    """The unit of any part but the first."""
    return part if part[0] == "\n" else " " + part
