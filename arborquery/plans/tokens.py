"""Splits expression strings into tokens.

White space separates; ' " ` enclose a token, in which backslashes are ordinary; outside, a backslash takes the next
character as it is. Adjacent quoted and plain parts are one token.
"""

from __future__ import annotations

from .errors import UnbalancedQuotes


def tokenize(text: str) -> list[str]:
    out: list[str] = []
    token: list[str] | None = None
    quote = ""
    chars = iter(text)
    for c in chars:
        if quote:
            if c == quote:
                quote = ""
            else:
                token.append(c)
        elif c.isspace():
            if token is not None:
                out.append("".join(token))
                token = None
        else:
            token = [] if token is None else token
            if c in "'\"`":
                quote = c
            elif c == "\\":
                escaped = next(chars, None)
                if escaped is None:
                    raise UnbalancedQuotes("a backslash ends the expression")
                token.append(escaped)
            else:
                token.append(c)
    if quote:
        raise UnbalancedQuotes(f"no closing {quote}")
    if token is not None:
        out.append("".join(token))
    return out
