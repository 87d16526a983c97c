"""Visible text of HTML: a tokenizer for tags, comments, raw text and character references."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag up to its end; a quote opens a value only after "=", and ">" inside such a value is text.
_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_COMMENT_END = re.compile(r"--!?>")
# Elements whose content holds no tags: never shown, shown as it is, shown with references decoded.
_HIDDEN, _PLAIN, _DECODED = {"script", "style"}, {"xmp", "iframe", "noembed", "noframes"}, {"title", "textarea"}
_RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in (*_HIDDEN, *_PLAIN, *_DECODED)
}


def visible_text(html: str) -> str:
    """Text nodes joined by one blank, white space at both ends kept.

    Comments, scripts, styles and templates are left out.  What is never closed lasts to the end:
    a tag, comment, script or style that lacks its end hides the rest, as in a cut summary.  A "<"
    that starts nothing is text.
    """
    nodes: list[str] = []
    text: list[str] = []
    templates, at = 0, 0

    def close() -> None:
        if text and not templates and (node := "".join(text)):
            nodes.append(unescape(node))
        text.clear()

    while (lt := html.find("<", at)) >= 0:
        text.append(html[at:lt])
        follows = html[lt + 1 : lt + 3]
        if follows[:1] in ("!", "?") or follows[:1] == "/" and not (follows[1:].isascii() and follows[1:].isalpha()):
            close()
            if html.startswith("<!--", lt):
                # "<!-->" and "<!--->" are whole comments.
                end = _COMMENT_END.search(html, lt + 2)
                at = end.end() if end else -1
            else:
                at = html.find(">", lt) + 1 or -1
        elif not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/"):
            text.append("<")
            at = lt + 1
        elif (tag := _TAG.match(html, lt)) is None:
            close()
            at = -1
        else:
            close()
            name, at = tag[1].lower(), tag.end()
            opening = follows[0] != "/"
            if name == "template":
                templates = templates + 1 if opening else max(templates - 1, 0)
            elif opening and name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                body = html[at : end.start() if end else len(html)]
                if name in _DECODED:
                    text.append(body)
                    close()
                elif name in _PLAIN and body and not templates:
                    nodes.append(body)
                at = end.start() if end else -1
        if at < 0:
            return " ".join(nodes)
    text.append(html[at:])
    close()
    return " ".join(nodes)


def _visible(html: pa.Array) -> pa.Array:
    return pa.array([None if h is None else visible_text(h) for h in html.to_pylist()], pa.string())


def html_text(col: Column) -> Column:
    """Visible text of an HTML column; null where the column is null.  Arrow batches, no shuffle."""
    return F.arrow_udf(_visible, "string")(col)
