"""Regular expressions that mean the same to Java, RE2 and Python's ``re``.

The rule lists use the usual short classes with their Unicode meaning. Java and
RE2 read ``\\w``, ``\\d`` and ``\\s`` as ASCII only, so `portable` spells them out.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}


def portable(pattern: str) -> str:
    """Spell out the Unicode classes, ``.`` and ``$`` of a rule."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            if nxt.lower() in _CLASSES:
                body = _CLASSES[nxt.lower()]
                if in_class:
                    out.append(body)
                else:
                    out.append(f"[^{body}]" if nxt.isupper() else f"[{body}]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        else:
            out.append({".": r"[^\n]", "$": r"\z"}.get(c, c))
        i += 1
    return "".join(out)


_LEAD = re.compile(r"^(?:\\w\*|\\s\?)+")
_TRAIL = re.compile(r"(?:\\w\*|\\s\*|\\s\?|\\d\*)+$")
_GROUP = re.compile(r"^\(([^()|?*+\[\]{}^$\\.]*)\)$")
# Characters by how rarely European prose has them; others are rarer still.
_RARE_FIRST = "xjßöüäzwkvybpfgmhcdlutsaoren i"
# Alternatives that are tried one by one before a test of one character stands for them.
_AT_ONCE = 4


def core(rule: str) -> str:
    """The part of a rule that decides whether it is found: optional material at its ends cannot."""
    return _GROUP.sub(r"\1", _TRAIL.sub("", _LEAD.sub("", rule)))


def literal_core(rule: str) -> str:
    """A text that every match of the rule contains, empty if there is no such plain text."""
    plain = re.sub(r"\\([^\w\s])", r"\1", core(rule)) if not re.search(r"\\\w", core(rule)) else ""
    return "" if re.search(r"[\\.\[\](){}^$|?+]|(?<!\\)\*", core(rule).replace("\\*", "")) else plain


def _plain_parts(rule: str) -> list[str]:
    """Plain texts that every match of the rule contains."""
    parts = re.split(r"\\[wsd][*?]", core(rule))
    if any(re.search(r"[\\.\[\](){}^$|?+*]", x) for x in parts):
        return [literal_core(rule)]
    return parts


def needed_text(rule: str) -> str:
    """The longest plain text that every match of the rule contains; the rule may ask for more. Empty if none is known."""
    return max(_plain_parts(rule), key=len)


def _escaped(text: str) -> str:
    return re.sub(r"([-.\\+*?()\[\]{}|^$])", r"\\\1", text)


def _one_of(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _rest(words: list[tuple[str, str]]) -> str:
    """What follows the rare character of the words, as ``(rest, word)``; the whole word must have been read at its end."""
    heads: dict[str, list[tuple[str, str]]] = {}
    for rest, word in sorted(words):
        heads.setdefault(rest[:1], []).append((rest[1:], word))
    return _one_of([p for head, tails in heads.items() for p in ([_escaped(head) + _rest(tails)] if head else [f"(?<={_escaped(w)})" for _, w in tails])])


def _any_word(words: list[str]) -> str:
    """Pattern that is found exactly if one of the words is; what it matches is a part of that word.

    The search stops at few characters only: each word is looked for from its rarest character on, and a
    test of one character decides whether a group of alternatives is tried.
    """
    by_rare: dict[str, list[tuple[str, str]]] = {}
    for w in words:
        at = min(range(len(w)), key=lambda i: _RARE_FIRST.find(w[i]))
        by_rare.setdefault(w[at], []).append((w[at + 1 :], w))
    found = sorted(by_rare, key=lambda c: (-_RARE_FIRST.find(c), c))
    groups = [found[i : i + _AT_ONCE] for i in range(0, len(found), _AT_ONCE)]
    any_char = lambda cs: "(?=[" + "".join(map(_escaped, cs)) + "])"
    return any_char(found) + _one_of([any_char(g) + _one_of([_escaped(c) + _rest(by_rare[c]) for c in g]) for g in groups])


def any_of(rules) -> str:
    """One pattern that is found in a text exactly if some rule is found in it.

    A rule that asks for a text with a plain rule inside adds nothing.
    """
    plain = sorted({literal_core(r) for r in rules} - {""}, key=len)
    plain = [w for i, w in enumerate(plain) if not any(v in w for v in plain[:i])]
    others = [r for r in rules if not literal_core(r) and not any(w in part for w in plain for part in _plain_parts(r))]
    return "|".join([_any_word(plain)] * bool(plain) + [f"(?:{c})" for c in dict.fromkeys(portable(core(r)) for r in others)])


def any_literal(words) -> str:
    """Pattern that is found exactly if one of the literal words is found."""
    return "|".join(re.sub(r"([.\\+*?()\[\]{}|^$])", r"\\\1", w) for w in dict.fromkeys(words))
