"""Whether every match of a pattern contains one of a rule's keywords, so that texts without them need no search.

The proof walks Python's parse of the pattern. What that parser refuses, or reads in another way than RE2 does, counts
as unproven, which costs time and never a match.
"""

from __future__ import annotations

import re
import re._parser as parser

_OTHER_DIALECT = ("[:", "\\Q", "\\E")


def guarantees_keyword(pattern: str, keywords: tuple[str, ...]) -> bool:
    wanted = [k.lower() for k in keywords if k]
    if not wanted or any(x in pattern for x in _OTHER_DIALECT):
        return False
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return _proven(tree, tree.state.flags, wanted)


def _proven(tree, flags: int, wanted: list[str]) -> bool:
    run = ""
    for op, detail in [*tree, (None, None)]:
        if op is parser.LITERAL:
            run += chr(detail)
            continue
        # Without regard to case, s also matches U+017F, and other alphabets have such pairs: no proof from those.
        sure = not flags & re.IGNORECASE or (run.isascii() and "s" not in run.lower())
        if sure and any(k in run.lower() for k in wanted):
            return True
        run = ""
        if op is parser.SUBPATTERN:
            _, more, fewer, inner = detail
            if _proven(inner, (flags | more) & ~fewer, wanted):
                return True
        elif op is parser.BRANCH:
            if all(_proven(x, flags, wanted) for x in detail[1]):
                return True
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            if detail[0] >= 1 and _proven(detail[2], flags, wanted):
                return True
    return False
