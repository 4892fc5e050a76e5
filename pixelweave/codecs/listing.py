"""Tables of numbers that standards print as C listings: these have thousands of entries, are no part of this package, and come as a
parameter, the listing's text."""

from __future__ import annotations

import re

import numpy as np

from . import CodecError


def listing(text: str) -> dict[str, np.ndarray]:
    """Arrays by name from listings in C's notation: name, [ sizes ], = { numbers }. Sizes may be left out or be names."""
    out = {}
    for name, body in re.findall(r"(\w+)\s*(?:\[[^\]]*\]\s*)+=\s*(\{[^;]*?\})\s*(?:;|(?=\n\s*(?:\w+\s+)*\w+\s*\[)|\Z)", re.sub(r"/\*.*?\*/|//[^\n]*", "", text, flags=re.S)):
        stack: list[list] = [[]]
        for token in re.findall(r"[{}]|-?\d+", body):
            if token == "{":
                stack.append([])
            elif token == "}":
                done = stack.pop()
                stack[-1].append(done)
            else:
                stack[-1].append(int(token))
        try:
            out[name] = np.array(stack[0][0], np.int32)
        except (ValueError, IndexError):
            raise CodecError("invalid_input", f"the listing of {name} isn't regular") from None
    return out
