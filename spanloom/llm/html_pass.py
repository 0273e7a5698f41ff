"""Text, title and links of an HTML page in one linear pass over its tokens.

Tokens are cut as browsers cut them: quotes count only around an attribute's value, the content of scripts, styles
and the like runs to their own end tag, and what isn't closed runs to the end of the page. Every part of the pattern
is possessive or ends at the page's end at the latest, so no page is read more than a fixed number of times.
"""

from __future__ import annotations

import html as html_lib
import re

#: Elements whose text isn't readable text; those of RAW hold no tags.
SILENT = frozenset("head noscript template svg".split())
RAW = frozenset("script style iframe noembed noframes title textarea".split())
#: Elements that end a line of text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title body html".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template noframes".split())
#: Elements and attributes that link to something.
LINKING = frozenset("a area link img script iframe".split())
LINK_ATTRIBUTES = frozenset(("href", "src"))

_VALUE = r"""\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+)"""
TOKEN = re.compile(
    rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|((?!["'])[^\s>]*+)))?+""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: What is to be known of an element: its name, and whether it is linking, raw, silent, a block, and may stand in a head.
KINDS = {n: (n, n in LINKING, n in RAW, n in SILENT, n in BLOCKS, n in IN_HEAD) for n in LINKING | RAW | SILENT | BLOCKS | IN_HEAD}
OTHER = ("", False, False, False, False, False)


def read_page(html: str) -> tuple[str, str | None, list[dict[str, str]]]:
    """(text, title, links) of a page.

    The text has a line for each block, without scripts, styles, comments, the head, and what stands in noscript,
    template and svg; entities are resolved. The title is the first one. Links are in order, each with the path of
    its element and attribute. A tag that the page's end cuts off is no tag.
    """
    out: list[str] = []
    links: list[dict[str, str]] = []
    title: str | None = None
    silent: list[str] = []  # open elements whose text doesn't count, and how many there are of each
    open_now = dict.fromkeys(SILENT, 0)
    at, search = 0, TOKEN.search
    while True:
        found = search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            if silent == ["head"] and not text.isspace():
                open_now[silent.pop()] -= 1
            if not silent:
                out.append(text)
        if not found:
            break
        at = found.end()
        closing, name, attributes, whole = found.groups()
        if not whole or name is None:
            continue
        name, linking, raw, hushed, block, in_head = KINDS.get(name) or KINDS.get(name.lower(), OTHER)
        if block:
            out.append("\n")
        if closing:
            if hushed and open_now[name]:
                while (closed := silent.pop()) != name:
                    open_now[closed] -= 1
                open_now[name] -= 1
            continue
        if silent and not in_head and silent[-1] == "head":
            open_now[silent.pop()] -= 1
        if linking:
            seen = set()
            for m in ATTRIBUTE.finditer(attributes):
                key = m[1].lower()
                if key in LINK_ATTRIBUTES and m.lastindex > 1 and key not in seen:
                    seen.add(key)
                    links.append({"path": f"{name.upper()}@/{key}", "url": html_lib.unescape(m[m.lastindex]).strip()})
        if raw:
            end = RAW_END[name].search(html, at)
            stop = end.start() if end else len(html)
            if name == "title" and title is None and not open_now["svg"]:
                title = " ".join(html_lib.unescape(html[at:stop]).split())
            elif name == "textarea" and not silent:
                out.append(html[at:stop])
            at = stop
        elif hushed and not (name == "svg" and attributes.endswith("/")) and (name != "head" or not open_now["head"]):
            silent.append(name)
            open_now[name] += 1
    lines = (" ".join(line.split()) for line in html_lib.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), title, links
