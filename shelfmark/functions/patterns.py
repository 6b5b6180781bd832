"""Python regular expressions read by their parse tree: as Java patterns, and as needed trigrams.

The tree is the one Python's own ``re`` compiles from, so what is accepted, and what it means, is
decided there. Java's classes, line ends and group references differ, so each node is written out
in full: classes by their Unicode categories, anchors as lookarounds, characters as code points.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser

# What Python counts as a blank; digits and word characters by Unicode category.
_BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {
    "DIGIT": (r"\p{Nd}", "0-9"),
    "SPACE": (_BLANK, r"\x{9}-\x{d}\x{20}"),
    "WORD": (r"\p{L}\p{N}_", "a-zA-Z0-9_"),
}
_ANY = r"[\s\S]"


def parsed(pattern: str, ignore_case: bool = False):
    """The parse tree; ``ValueError`` where Python finds the pattern invalid."""
    flags = re.IGNORECASE if ignore_case else 0
    try:
        with warnings.catch_warnings():
            # Warnings of set notations that a later Python may read otherwise.
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern, flags)
            return _parser.parse(pattern, flags)
    except (re.error, OverflowError, RecursionError) as err:
        raise ValueError(f"invalid regex: {err}") from err


class _Writer:
    """One pattern on its way to Java. Groups keep their order; one that a condition asks for
    gets an empty group inside, which can be referred to exactly when the outer one took part."""

    def __init__(self, tree):
        self.asked = set()
        self._find_asked(tree)
        self.numbers: dict[int, int] = {}
        self.marks: dict[int, int] = {}
        self.groups = 0

    def _find_asked(self, tree) -> None:
        for code, arg in tree:
            if code is op.GROUPREF_EXISTS:
                self.asked.add(arg[0])
            for part in _parts(code, arg):
                self._find_asked(part)

    def sequence(self, tree, flags: int) -> str:
        return "".join(self.node(code, arg, flags) for code, arg in tree)

    def node(self, code, arg, flags: int) -> str:
        if code is op.LITERAL:
            return _char(arg)
        if code is op.NOT_LITERAL:
            return f"[^{_char(arg)}]"
        if code is op.ANY:
            return _ANY if flags & re.DOTALL else r"[^\x{a}]"
        if code is op.IN:
            return _one_of(arg, flags)
        if code is op.BRANCH:
            return "(?:" + "|".join(self.sequence(b, flags) for b in arg[1]) + ")"
        if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, item = arg
            times = f"{{{least},{'' if most is op.MAXREPEAT else most}}}"
            how = {op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}.get(code, "")
            return f"(?:{self.sequence(item, flags)}){times}{how}"
        if code is op.SUBPATTERN:
            return self.group(*arg, flags)
        if code is op.ATOMIC_GROUP:
            return f"(?>{self.sequence(arg, flags)})"
        if code in (op.ASSERT, op.ASSERT_NOT):
            way, item = arg
            mark = ("?<" if way < 0 else "?") + ("=" if code is op.ASSERT else "!")
            return f"({mark}{self.sequence(item, flags)})"
        if code is op.AT:
            return _place(arg, flags)
        if code is op.GROUPREF:
            return rf"(?:\{self.numbers[arg]})"
        if code is op.GROUPREF_EXISTS:
            number, then, other = arg
            if number not in self.marks:
                raise ValueError("invalid regex: a condition on a group that comes later")
            mark = rf"(?:\{self.marks[number]})"
            no = self.sequence(other, flags) if other is not None else ""
            return f"(?:{mark}{self.sequence(then, flags)}|(?!{mark}){no})"
        if code is op.FAILURE:
            return "(?!)"
        raise ValueError(f"invalid regex: {code} is not supported")

    def group(self, number, add: int, drop: int, item, flags: int) -> str:
        inner = (flags | add) & ~drop
        if number is not None:
            self.groups += 1
            self.numbers[number] = self.groups
        body = self.sequence(item, inner)
        case = _case(inner)
        if case != _case(flags):
            body = f"(?{case}:{body})" if case else f"(?-iu:{body})"
        if number is None:
            return f"(?:{body})"
        if number in self.asked:
            self.groups += 1
            self.marks[number] = self.groups
            body += "()"
        return f"({body})"


def _parts(code, arg) -> list:
    """The trees inside a node."""
    if code is op.BRANCH:
        return list(arg[1])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return [arg[2]]
    if code is op.SUBPATTERN:
        return [arg[3]]
    if code is op.ATOMIC_GROUP:
        return [arg]
    if code in (op.ASSERT, op.ASSERT_NOT):
        return [arg[1]]
    if code is op.GROUPREF_EXISTS:
        return [t for t in arg[1:] if t is not None]
    return []


def _case(flags: int) -> str:
    if not flags & re.IGNORECASE:
        return ""
    return "i" if flags & re.ASCII else "iu"


def _char(code: int) -> str:
    shown = chr(code)
    return shown if shown.isascii() and shown.isalnum() else rf"\x{{{code:x}}}"


def _class(name: str, flags: int) -> str:
    """A class such as CATEGORY_NOT_WORD, as a Java class of its own."""
    kind = str(name).removeprefix("CATEGORY_")
    inside = _CLASSES[kind.removeprefix("NOT_")][bool(flags & re.ASCII)]
    return f"[{'^' if kind.startswith('NOT_') else ''}{inside}]"


def _one_of(items, flags: int) -> str:
    """A character class. Negated classes inside it are alternatives, not nested classes."""
    plain, others, negated = "", [], False
    for code, arg in items:
        if code is op.NEGATE:
            negated = True
        elif code is op.LITERAL:
            plain += _char(arg)
        elif code is op.RANGE:
            plain += f"{_char(arg[0])}-{_char(arg[1])}"
        else:
            others.append(_class(arg, flags))
    if plain:
        others.append(f"[{plain}]")
    if len(others) == 1 and not negated:
        return others[0]
    union = "(?:" + "|".join(others) + ")"
    return f"(?:(?!{union}){_ANY})" if negated else union


def _place(code, flags: int) -> str:
    if code is op.AT_BEGINNING:
        return r"(?:\A|(?<=\x{a}))" if flags & re.MULTILINE else r"\A"
    if code is op.AT_BEGINNING_STRING:
        return r"\A"
    if code is op.AT_END:
        return r"(?=\x{a}|\z)" if flags & re.MULTILINE else r"(?=\x{a}?\z)"
    if code is op.AT_END_STRING:
        return r"\z"
    word = _class("CATEGORY_WORD", flags)
    if code is op.AT_BOUNDARY:
        return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    # Between two word characters or between two others; nowhere in an empty text.
    return rf"(?:(?<={word})(?={word})|(?<!{word})(?!{word})(?!\A\z))"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python ``re`` pattern as a Java one that finds the same."""
    tree = parsed(pattern, ignore_case)
    flags = tree.state.flags
    case = _case(flags)
    return (f"(?{case})" if case else "") + _Writer(tree).sequence(tree, flags)


# --- needed trigrams ------------------------------------------------------------

#: Alternatives kept while literal runs are put together; beyond them a run ends.
MOST_RUNS = 32
#: Letters outside ASCII that match an ASCII one when case is ignored, and that one.
FOLDED = ("İſıK", "isik")


def needed_trigrams(pattern: str, ignore_case: bool = False):
    """What the folded text of any match must hold: a trigram, ``("all", parts)``, ``("any",
    parts)``, or None where nothing can be said. Only ASCII characters make trigrams, in lower
    case whether or not case matters, since the index folds its text the same way."""
    return _needs(parsed(pattern, ignore_case))


def _all_of(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _any_of(parts: list):
    if any(p is None for p in parts) or not parts:
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _needs(tree):
    found, runs = [], [""]

    def end_run() -> None:
        nonlocal runs
        found.append(_any_of([_all_of([r[i : i + 3] for i in range(len(r) - 2)]) for r in runs]))
        runs = [""]

    def extend(choices: list[str]) -> None:
        nonlocal runs
        if len(runs) * len(choices) > MOST_RUNS:
            # The last two characters still stand before what follows.
            tails = list(dict.fromkeys(r[-2:] for r in runs))
            end_run()
            runs = tails if len(tails) * len(choices) <= MOST_RUNS else [""]
        runs = [r + c for r in runs for c in choices]

    def walk(items) -> None:
        for code, arg in items:
            if code is op.LITERAL and arg < 128:
                extend([chr(arg).lower()])
            elif code is op.IN and all(c is op.LITERAL and a < 128 for c, a in arg) and len(arg) <= 8:
                extend(list(dict.fromkeys(chr(a).lower() for _, a in arg)))
            elif code is op.SUBPATTERN:
                walk(arg[3])
            elif code is op.ATOMIC_GROUP:
                walk(arg)
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] >= 1:
                # What is repeated stands there once at its start and once at its end.
                walk(arg[2])
                if arg[1] != 1:
                    end_run()
                    if arg[0] > 1:
                        found.append(_needs(arg[2]))
            elif code is op.BRANCH:
                end_run()
                found.append(_any_of([_needs(b) for b in arg[1]]))
            elif code in (op.AT, op.ASSERT, op.ASSERT_NOT):
                pass  # takes no room
            else:
                end_run()

    walk(tree)
    end_run()
    return _all_of(found)
