"""Character classes with which Java's regular expressions mean what Unicode-aware patterns mean.

Java's own \\w, \\d, \\s and \\b are ASCII or depend on the JDK, and (?U) takes
combining marks for word characters; these fragments state the classes in full.
"""

from __future__ import annotations

#: The inside of a class of word characters: letters, numbers, underscore.
W_IN = r"\p{L}\p{N}_"
W, NOT_W = f"[{W_IN}]", f"[^{W_IN}]"
#: Decimal digits of any script.
D = r"\p{Nd}"
#: The inside of a class of white space.
S_IN = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S, NOT_S = f"[{S_IN}]", f"[^{S_IN}]"
#: A word boundary.
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
#: The same before a word character, and after one.
BEFORE, AFTER = f"(?<!{W})", f"(?!{W})"
#: Case-insensitive, in Unicode; letters beyond ASCII that fold to one of a-z must be listed in ranges.
I = "(?iu)"  # noqa: E741
FOLDED = r"\u017F\u212A"
THAI = r"\u0E00-\u0E7F"
THAI_CONSONANT = r"\u0E01-\u0E2E"


def any_of(words) -> str:
    """A pattern that finds any of words, which share their common beginnings; the first letters are tested at once."""

    def tree(rest: list[str]) -> str:
        tails: dict[str, list[str]] = {}
        for w in rest:
            if w:
                tails.setdefault(w[0], []).append(w[1:])
        parts = [quoted(c) + tree(t) for c, t in tails.items()]
        if not parts:
            return ""
        if "" in rest:
            return f"(?:{'|'.join(parts)})?"
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    words = sorted(set(words))
    first = "".join(quoted(c) for c in dict.fromkeys(w[0] for w in words))
    return f"(?=[{first}]){tree(words)}"


def quoted(word: str) -> str:
    return "".join("\\" + c if c in r".\+*?()[]{}|^$-/" else c for c in word)
