"""Archives made from the given tables, for the queries that read archives."""

from __future__ import annotations

import io
import zipfile

ITEMS = "<li>2 cups flour</li><li>3 tablespoons sugar</li><li>1 tsp salt</li><li>3 large eggs</li>"
STEPS = "<li>Preheat the oven and mix the flour with the sugar.</li><li>Stir in the eggs, then bake until golden.</li><li>Remove, let it cool and serve warm.</li>"


def archive(key: int, name: str, suppliers: list) -> bytes:
    """A book of a nation with a page per supplier; even ones are in the table of contents, odd ones in a part of it. Every fifth book is cut short, every other fifth has no title or author."""
    out = io.BytesIO()
    suppliers = sorted(suppliers, key=lambda s: s["s_suppkey"])
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{s["s_suppkey"]}" href="s{s["s_suppkey"]}.xhtml" media-type="application/xhtml+xml"/>' for s in suppliers)
        named = "" if key % 5 == 1 else f"<dc:title>Cakes of {name}</dc:title><dc:creator>Baker {key}</dc:creator>"
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="urn:opf" xmlns:dc="urn:dc"><metadata>{named}</metadata><manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
            '<item id="pic" href="a.png" media-type="image/png"/></manifest><spine toc="ncx"/></package>',
        )
        point = lambda label, src, below="": f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{src}"/>{below}</navPoint>'
        even = "".join(point(f"Golden cake of {s['s_name']}", f"s{s['s_suppkey']}.xhtml") for s in suppliers if s["s_suppkey"] % 2 == 0)
        odd = "".join(point(f"Wurzburg pizzazz muffin {s['s_suppkey']}", f"s{s['s_suppkey']}.xhtml#top") for s in suppliers if s["s_suppkey"] % 2)
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="urn:ncx"><navMap>{even}{point("Sweets and more", "more.xhtml", odd) if odd else ""}</navMap></ncx>')
        z.writestr("OEBPS/a.png", b"png")
        for s in suppliers:
            page = f'<section><h2>Golden cake of {s["s_name"]}</h2><p>Serves {s["s_suppkey"] % 9 + 1}</p><p>Prep time: 20 minutes</p><ul class="ingredients">{ITEMS}</ul><ol>{STEPS}</ol></section>'
            z.writestr(f"OEBPS/s{s['s_suppkey']}.xhtml", f"<html xmlns='http://www.w3.org/1999/xhtml'><body>{page}</body></html>")
    return out.getvalue()[: 100 if key % 5 == 0 else None]
