"""Words and passages of wiki text."""

from __future__ import annotations

import re
import unicodedata

#: The longest runs of letters or digits.
WORD = re.compile(r"[^\W_]+")
COMMENT = re.compile(r"<!--.*?-->", re.S)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
MAGIC = re.compile(r"__[A-Z]{3,}__")
TARGET = re.compile(r"\[\[[^\[\]|{}]*\|")
URL = re.compile(r"\[(?:https?:)?//[^\s\[\]]*")
#: Attributes of a table or of a row, and of a cell up to its bar.
TABLE = re.compile(r"^[ \t]*(?:\{\||\|-)[^\n\r]*", re.M)
CELL = re.compile(r"(?:^[ \t]*[|!]|\|\||!!)[ \t]*(?:[\w-]+[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s|\"'={}]+)[ \t]*)+\|(?![|}])", re.M)
#: Name of a template, a parser function or a parameter in braces, up to its bar, colon or end.
NAME = re.compile(r"\{\{\{?[ \t\r\n]*(?:#\w+:|[^{}|\[\]<>]*)")
#: Name of a parameter of a template, and a field's name on a line of its own.
PARAMETER = re.compile(r"\|[ \t\r\n]*[^|={}\[\]<>\n\r]*?=")


def fold(text: str) -> str:
    """Text for comparing words without case, decomposed letters composed."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def words(text: str) -> list[str]:
    return WORD.findall(fold(text))


def plain(text: str) -> str:
    """The text without markup, each piece of markup a blank; what a template's parameters hold stays."""
    if "<" in text:
        text = TAG.sub(" ", COMMENT.sub(" ", text))
    if "&" in text:
        text = ENTITY.sub(" ", text)
    if "__" in text:
        text = MAGIC.sub(" ", text)
    if "[" in text:
        text = URL.sub(" ", TARGET.sub(" ", text))
    if "|" in text:
        text = CELL.sub(" ", TABLE.sub(" ", text))
    if "{{" in text:
        text = PARAMETER.sub("| ", NAME.sub(" ", text))
    return text
