"""Boolean trigram queries of regular expressions."""

from __future__ import annotations

import re._constants as sre
import re._parser

#: Alternatives of a rule at most; a rule with more is scanned fully.
MOST = 64
GAP = "\0"
_A, _Z = ord("A"), ord("Z")


def _fold(code: int) -> str:
    return chr(code + 32 if _A <= code <= _Z else code)


def _members(parts: list) -> set[str] | None:
    """The folded characters of a class, or None if there are many."""
    found: set[str] = set()
    for op, arg in parts:
        if op is sre.LITERAL:
            found.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 4:
            found.update(_fold(c) for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return found if len(found) <= 5 else None


def _join(heads: list[str], tails: list[str]) -> list[str]:
    return [h + t for h in heads for t in tails][: MOST + 1]


def _strings(parsed) -> list[str]:
    """What a match consists of: known characters, with a gap for anything else; one string for each alternative."""
    out = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            out = _join(out, [_fold(arg)])
        elif op is sre.IN:
            out = _join(out, sorted(_members(arg) or {GAP}))
        elif op is sre.SUBPATTERN:
            out = _join(out, _strings(arg[3]))
        elif op is sre.BRANCH:
            out = _join(out, [s for branch in arg[1] for s in _strings(branch)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            if low == 0:
                out = _join(out, ["", *_strings(sub)] if high == 1 and len(_strings(sub)) == 1 and GAP not in _strings(sub)[0] else [GAP])
            else:
                for _ in range(min(low, 3)):
                    out = _join(out, _strings(sub))
                out = _join(out, [GAP] if high > 1 else [""])
        elif op is not sre.AT:
            out = _join(out, [GAP])
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams (lower case) that a matching text has to hold; empty: scan fully."""
    strings = _strings(re._parser.parse(pattern))
    found = {frozenset(p[i : i + 3] for p in s.split(GAP) for i in range(len(p) - 2)) for s in strings}
    if len(strings) > MOST or frozenset() in found:
        return []
    return sorted((f for f in found if not any(g < f for g in found)), key=sorted)
