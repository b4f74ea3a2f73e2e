"""Running prose of a document: what is left without log excerpts, tables, headings and mark-up, as sentences."""

from __future__ import annotations

import re
from html import unescape

from loomline.operators.log_entries import LAYOUTS

_LOG = re.compile("|".join(f"(?:{x.line.replace('^', '', 1)})" for x in LAYOUTS))
_LOG_TAIL = re.compile(r'^(?:\{"|\{$|\}$|\s+"\w+":|\s+at \S+\(|Caused by:|\s+\.\.\. \d+ more|[0-9a-f]{8}  (?:[0-9a-f]{2}[ $])+|[\w.]+(?:Exception|Fault|Error)\b)')
_TABLE = re.compile(r"^\s*(?:\|.*\||[-+=|: ]{3,}|[^\t]*\t[^\t]*\t.*|.*\S\s*\|\s*\S.*\|.*|\S+(?: {3,}\S+){2,})\s*$")
_MARK = re.compile(r"^\s*(?:#{1,6}|={2,}|>+)\s*")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={1,6}\s|\*\*[^*]+\*\*\s*$|__[^_]+__\s*$)|^.*\n\s*(?:={3,}|-{3,})\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
_TAG = re.compile(r"<(/?)(\w+)[^<>]*>")
_INLINE = frozenset("a b i u s em strong code span tt sub sup mark small font".split())
# Abbreviations whose full stop ends no sentence.
_SHORT = frozenset("e.g. i.e. etc. cf. vs. approx. resp. fig. no. nr. dr. mr. ms. st. incl. ca. z.b. d.h. p.ej. bzw. usw.".split())
_BEFORE = re.compile(r"[\w.]+$")
_END = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")


def strip_markup(text: str) -> str:
    """Tags and entities resolved: block tags become line breaks, inline ones vanish."""
    if "&" in text:
        text = unescape(text)
    return _TAG.sub(lambda m: "" if m[2].lower() in _INLINE else "\n", text) if "<" in text else text


def _is_log(line: str) -> bool:
    return bool(_LOG.match(line) or _LOG_TAIL.match(line))


def _split(body: str) -> list[str]:
    """A body in sentences: after their end marks, but not after an abbreviation."""
    parts = _END.split(body)
    out = parts[:1]
    for x in parts[1:]:
        before = out[-1]
        if before.endswith(".") and (m := _BEFORE.search(before, max(0, len(before) - 8))) and m[0].lower() in _SHORT:
            out[-1] = f"{before} {x}"
        else:
            out.append(x)
    return out


def sentences(text: str) -> list[str]:
    """Sentences of the prose. A list entry is one; a block of a single short line without a closing mark is a heading."""
    out: list[str] = []
    clean = strip_markup(text).replace("\r\n", "\n").replace("\r", "\n")
    for block in re.split(r"\n[ \t ]*\n", clean):
        lines = [x for x in block.split("\n") if x.strip() and not _is_log(x) and not _TABLE.match(x) and not _HEADING.match(x)]
        if not lines:
            continue
        entries: list[str] = []
        plain: list[str] = []
        for line in lines:
            line = _MARK.sub("", line)
            if _ITEM.match(line):
                entries.append(_ITEM.sub("", line))
            elif entries:
                entries[-1] += " " + line
            else:
                plain.append(line)
        body = " ".join(plain).strip()
        if len(plain) == 1 and not entries and not re.search(r"[.!?…:;][\"')\]»”*_]*$", body) and len(body.split()) <= 8:
            body = ""
        if body:
            out += [x for x in _split(body) if _WORD.search(x)]
        out += [x for x in entries if _WORD.search(x)]
    return out
