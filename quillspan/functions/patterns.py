"""One table of line and inline patterns, in the common subset of Java, Python and RE2 syntax.

The native line predicates and the block parser both read it, so a rule has one home.
"""

from __future__ import annotations

WS = "[ \t]"
BLANK = "^[ \t\n\x0b\f\r]*$"
ATX = "^ {0,3}#+( |$)"
BULLET = f"^{WS}*[-*+]({WS}|$)"
DECIMAL = rf"^{WS}*(\(([0-9]+|#)\)|([0-9]+|#)[.)])({WS}|$)"
ROMAN_BODY = "M*(CM)?D?(CD)?C*(XC)?L?(XL)?X*(IX)?V?(IV)?I*"
FANCY = rf"^{WS}*(\(([A-Za-z]|[MDCLXVI]+|[mdclxvi]+)\)|([A-Za-z]|[MDCLXVI]+|[mdclxvi]+)[.)])({WS}|$)"
#: \w is any letter, digit or underscore here: Java needs (?U) for that, see `java`.
EXAMPLE = rf"^{WS}*(\(@[\w-]*\)|@[\w-]*[.)])({WS}|$)"
FENCE = f"^{WS}*(`{{3,}}|~{{3,}})"
FENCE_OPEN = f"^{WS}*(`{{3,}}[^`]*|~{{3,}}.*)$"
FRONT = f"^---{WS}*$"
FRONT_END = f"^(---|\\.\\.\\.){WS}*$"
HTML_KINDS = {
    "comment": "^ {0,3}<!--",
    "cdata": r"^ {0,3}<!\[CDATA\[",
    "processing": r"^ {0,3}<\?",
    "declaration": "^ {0,3}<![A-Za-z]",
    "script": r"^ {0,3}<([sS][cC][rR][iI][pP][tT]|[pP][rR][eE]|[sS][tT][yY][lL][eE]|[tT][eE][xX][tT][aA][rR][eE][aA])([ \t>]|$)",
}
HTML_ENDS = {
    "comment": "-->",
    "cdata": r"\]\]>",
    "processing": r"\?>",
    "declaration": ">",
    "script": r"</([sS][cC][rR][iI][pP][tT]|[pP][rR][eE]|[sS][tT][yY][lL][eE]|[tT][eE][xX][tT][aA][rR][eE][aA])>",
}
TABLE_ROW = rf"^{WS}*\|"
GRID_BORDER = rf"^{WS}*\+([-=:]+\+)+{WS}*$"
GRID_ROW = rf"^{WS}*\|.*\|{WS}*$"
DASHES_SPACED = f"^{WS}*-{{2,}}({WS}+-{{2,}})+{WS}*$"
DASHES_FULL = f"^{WS}*-{{2,}}{WS}*$"
PIPE_DELIMITER = r"^[-|: \t]*-[-|: \t]*$"
QUOTE = f"^{WS}*>"
SETEXT = f"^(=+|-+){WS}*$"
DEFINITION = r"^ {0,3}\[([^\]]+)\]:"
TITLE_LINE = f"^{WS}+[\"'(]"
BREAK = f"^{WS}*(-({WS}*-){{2,}}|\\*({WS}*\\*){{2,}}|_({WS}*_){{2,}}){WS}*$"
CONTINUATION = "^  "
INITIAL = rf"^{WS}*[A-Z]\. [^ ]"
URL = r"https?://[^ \t<>\"`\]\[)(|]*[^ \t<>\"`\]\[)(|.,;:!?]"
FOOTNOTE_REF = r"\[\^([^\]\[]+)\]"
CITE_KEY = r"@([0-9A-Za-z_]([0-9A-Za-z_]|[:.#$%&+?<>~/-][0-9A-Za-z_])*)"
EXTERNAL = "^([A-Za-z][A-Za-z0-9+.-]*:|//)"
WORD = "[A-Za-z][A-Za-z'’-]*"


def java(pattern: str) -> str:
    """A pattern of this table for Spark."""
    return "(?U)" + pattern if r"\w" in pattern else pattern


def re2(pattern: str) -> str:
    """A pattern of this table for DuckDB."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_")
