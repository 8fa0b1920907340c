"""Regular expressions of the browser dialect, rewritten for Java."""

from __future__ import annotations

import re

from gridwright.functions.coerce import BLANK

_LINE = r"\n\r\u2028\u2029"
_WORD = "A-Za-z0-9_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_EDGE = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"


class Pattern:
    """java: the pattern for Spark; groups and names: of its capturing groups.

    What differs between the dialects is rewritten: end of text and line ends,
    white space, word edges (ASCII), the dot, brackets in classes, and escapes of
    letters that mean nothing there. Flags: i, m, s.
    """

    def __init__(self, source: str, flags: str = "") -> None:
        self.source, self.flags = source, flags
        self.groups, self.names = 0, []
        out, at = [], 0
        while at < len(source):
            piece, at = self._one(at)
            out.append(piece)
        self.java = ("(?iu)" if "i" in flags else "") + "".join(out)

    def _one(self, at: int) -> tuple[str, int]:
        s, ch = self.source, self.source[at]
        if ch == "\\":
            return self._escape(at, False)
        if ch == "[":
            return self._class(at)
        if ch == "(":
            named = re.compile(r"\(\?<([A-Za-z_$][\w$]*)>").match(s, at)
            if named:
                self.groups += 1
                self.names.append(named[1])
                return f"(?<{_group_name(named[1])}>", named.end()
            if not s.startswith("(?", at):
                self.groups += 1
            return ch, at + 1
        if ch == "$":
            return (rf"(?=[{_LINE}]|\z)" if "m" in self.flags else r"\z"), at + 1
        if ch == "^":
            return (f"(?:^|(?<=[{_LINE}]))" if "m" in self.flags else "^"), at + 1
        if ch == ".":
            return (r"[\s\S]" if "s" in self.flags else f"[^{_LINE}]"), at + 1
        if ch in "*+?}" and s.startswith("+", at + 1):
            raise ValueError(f"nothing to repeat in {s!r}")
        return (("\\" + ch) if ch in "]}" and not self._counts(at) else ch), at + 1

    def _counts(self, at: int) -> bool:
        """Whether the brace that ends here belongs to a count such as {2,3}."""
        return bool(re.search(r"\{\d+(?:,\d*)?\Z", self.source[:at]))

    def _escape(self, at: int, inside: bool) -> tuple[str, int]:
        s = self.source
        if at + 1 >= len(s):
            raise ValueError("pattern ends with a backslash")
        ch, end = s[at + 1], at + 2
        if ch == "s":
            return (BLANK if inside else f"[{BLANK}]"), end
        if ch == "S":
            return f"[^{BLANK}]", end
        if ch == "b":
            return (r"\x08" if inside else _EDGE), end
        if ch == "B" and not inside:
            return _NO_EDGE, end
        if ch in "dDwWtnrf":
            return "\\" + ch, end
        if ch == "v":
            return r"\x0b", end
        if ch == "0" and not s[end : end + 1].isdigit():
            return r"\x00", end
        if ch.isdigit() and not inside:
            return "\\" + ch, end
        for form in (r"x[0-9a-fA-F]{2}", r"u[0-9a-fA-F]{4}", r"c[A-Za-z]"):
            m = re.compile(form).match(s, at + 1)
            if m:
                return ("\\c" + m[0][1].upper() if ch == "c" else "\\" + m[0]), m.end()
        named = re.compile(r"k<([A-Za-z_$][\w$]*)>").match(s, at + 1)
        if named and not inside:
            return rf"\k<{_group_name(named[1])}>", named.end()
        return (ch if ch.isalpha() else "\\" + ch), end

    def _class(self, at: int) -> tuple[str, int]:
        s, i = self.source, at + 1
        negated = s.startswith("^", i)
        i += negated
        if s.startswith("]", i):
            return (r"[\s\S]" if negated else "(?!)"), i + 1
        out = []
        while i < len(s) and s[i] != "]":
            if s[i] == "\\":
                piece, i = self._escape(i, True)
                out.append(piece)
            else:
                out.append("\\" + s[i] if s[i] in "[&~^" else s[i])
                i += 1
        if i >= len(s):
            raise ValueError(f"unterminated character class in {s!r}")
        return "[" + ("^" if negated else "") + "".join(out) + "]", i + 1

    def replacement(self, text: str) -> str:
        """A replacement text in the same dialect, for Java: $$ $& $1 $<name>.

        The text before or after a match cannot be referred to.
        """
        out, at = [], 0
        while at < len(text):
            ch = text[at]
            if ch == "\\":
                out.append("\\\\")
            elif ch != "$":
                out.append(ch)
            else:
                nxt = text[at + 1 : at + 2]
                number = re.compile(r"\d{1,2}").match(text, at + 1)
                named = re.compile(r"<([^>]*)>").match(text, at + 1)
                if nxt == "$":
                    out.append("\\$")
                    at += 1
                elif nxt == "&":
                    out.append("$0")
                    at += 1
                elif nxt in ("`", "'") and nxt:
                    raise ValueError(f"${nxt} is not supported in a replacement")
                elif number:
                    digits = number[0]
                    if not 1 <= int(digits) <= self.groups:
                        digits = digits[:1]
                    if 1 <= int(digits) <= self.groups:
                        out.append(f"${int(digits)}")
                        at += len(digits)
                        if text[at + 1 : at + 2].isdigit():
                            out.append("\\")
                    else:
                        out.append("\\$")
                elif named and self.names:
                    out.append(f"${{{_group_name(named[1])}}}" if named[1] in self.names else "")
                    at += len(named[0])
                else:
                    out.append("\\$")
            at += 1
        return "".join(out)


def _group_name(name: str) -> str:
    """Java's group names have letters and digits only."""
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}" for c in name)
