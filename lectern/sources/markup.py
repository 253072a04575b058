"""HTML to blocks, by the standard library's tokeniser."""

from __future__ import annotations

from html.parser import HTMLParser

# -- fixed values that results depend on ---------------------------------------------
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "li", "blockquote", "pre", "dd", "dt"}
CONTAINERS = {"div", "section", "article", "main", "body", "figure", "ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "html"}
SKIPPED = {"img", "svg", "script", "style", "head", "meta", "link", "audio", "video", "source", "use", "br"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "use"}


class _Reader(HTMLParser):
    """Blocks of the open elements: a block begins at the first element that isn't a container; its text runs to that element's end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, id, texts, whether an element is inside]
        self.skipping = 0
        self.found: list[tuple[str, str | None, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID or self.skipping:
            self.skipping += tag not in VOID and tag in SKIPPED
            return
        if tag in SKIPPED:
            self.skipping = 1
            return
        for element in self.open:
            element[3] = True
        self.open.append([tag, dict(attrs).get("id"), [], False])

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_data(self, data):
        if not self.skipping and self.open:
            for element in self.open:
                element[2].append(data)

    def handle_endtag(self, tag):
        if self.skipping:
            self.skipping -= tag in SKIPPED and tag not in VOID
            return
        if any(e[0] == tag for e in self.open):
            while self.open:
                element = self.open.pop()
                self._close(element)
                if element[0] == tag:
                    break

    def _close(self, element):
        tag, anchor, texts, inner = element
        inside_block = any(e[0] not in CONTAINERS for e in self.open)
        if inside_block or tag in ("html", "body") or (tag in CONTAINERS and inner):
            return
        self.found.append(("title" if tag in HEADINGS else "para", anchor, " ".join(texts)))

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open.pop())
        return self.found


def blocks_of(html: str) -> list[tuple[str, str | None, str]]:
    """(kind, anchor, text) of a page's blocks in order: headings are titles; paragraphs, list items and other elements are paragraphs.

    Containers are looked into; one that holds no element is a paragraph itself.
    Text beside the elements of a container is dropped, as are scripts, styles, images and heads.
    """
    reader = _Reader()
    reader.feed(html)
    return reader.finish()
