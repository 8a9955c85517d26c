"""Text of an HTML page, by one walk from tag to tag."""

from __future__ import annotations

import html
import re

#: Elements whose content is no text, and what the others leave behind when they stand or end.
HIDDEN = frozenset(("head", "style", "script", "noscript"))
LEFT = dict.fromkeys(("br", "/p", "/div", "/li", "/tr", "/h1", "/h2", "/h3", "/h4", "/h5", "/h6"), "\n") | {"/td": "\t", "/th": "\t"}
#: White space of all scripts, as Unicode has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def _name(tag: str) -> str:
    """Name of a tag in small letters, with the slash of an end tag."""
    end = tag[:1] == "/"
    i = j = 1 if end else 0
    while j < len(tag) and tag[j].isalnum():
        j += 1
    return tag[:end] + tag[i:j].lower()


def _after(source: str, at: int) -> int:
    """The place behind the next end tag of a hidden element, or -1."""
    while (at := source.find("</", at)) >= 0:
        stop = source.find(">", at)
        if stop < 0:
            return -1
        if source[at + 2 : stop].strip().lower() in HIDDEN:
            return stop + 1
        at += 2
    return -1


def raw_text(source: str) -> str:
    """Characters outside tags; a "<" that no ">" follows, or that one follows at once, is text."""
    out, at = [], 0
    while (start := source.find("<", at)) >= 0:
        stop = source.find(">", start)
        if stop < 0:
            break
        if stop == start + 1:
            out.append(source[at:stop])
            at = stop
            continue
        # a tag that leaves something behind counts from its own bracket, whatever stands open before it
        inner = source.rfind("<", start, stop)
        name = _name(source[inner + 1 : stop])
        if inner > start and name not in LEFT:
            name = _name(source[start + 1 : stop])
            inner = start
        out.append(source[at:inner])
        after = _after(source, stop) if name in HIDDEN else -1
        out.append(LEFT.get(name, ""))
        at = after if after >= 0 else stop + 1
    return "".join(out) + source[at:]


def tidy(text: str) -> str:
    """Lines without outer white space; runs of blank lines become one."""
    lines = [x.strip(SPACES) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub("\n\n\n+", "\n\n", "\n".join(lines)).strip(SPACES)


def text_of(source: str) -> str:
    return tidy(html.unescape(raw_text(source)))
