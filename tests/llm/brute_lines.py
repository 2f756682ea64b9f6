"""The content-defined chunks of line dedup again, with dictionaries and loops."""

import re
from collections import Counter

import xxhash

from mediasift.llm import linededup as L

CUT = re.compile(L.LINE_END)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def _long(x, seed=42):
    return signed(xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1))


def lines(text):
    return [x for x in CUT.split(text or "") if x]


def chunks(rows):
    """Set of (id, first, size) of rows (id, text) with distinct ids."""
    texts = {i: lines(t) for i, t in rows}
    times = Counter(x for t in texts.values() for x in t)
    out = set()
    for i, t in texts.items():
        long = [len(x) >= L.LONG_LINE or len(x) >= 2 * L.LONG_WORDS - 1 and len(x.strip(" ").split(" ")) >= L.LONG_WORDS for x in t]
        start, before = None, 0
        for k, x in enumerate(t):
            if times[x] < 2:
                start = None
                continue
            h = signed(xxhash.xxh64_intdigest(x.encode(), 42))
            if start is None:
                start, before = k, 0
            edge = k + 1 == len(t) or times[t[k + 1]] < 2 or long[k] or long[k + 1]
            if edge or _long(h, _long(before)) % L.ENDS_OF == 0:
                if long[start] or k > start and sum(max(len(y), L.WORD * len(y.strip(" ").split(" "))) for y in t[start : k + 1]) >= L.LEAST_MATCH:
                    out.add((i, start, k - start + 1))
                start = k + 1
            before = h
    return out
