"""HTML, sitemaps, feeds and spreadsheets. Trees are parsed in Arrow batches; what is flat stays in the JVM."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROP = {"script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "form"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr"}
_BLOCK = re.compile(r"(?i)curso|course|asignatura|materia|disciplina|syllabus|silabo|plan|program|content|curric")


class Page(HTMLParser):
    """Title, table rows, course blocks (innermost only), links and text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.text = "", "", []
        self.rows: list[list[str]] = []
        self.links: list[tuple[str, str]] = []
        self.blocks: list[str] = []
        self._path: list[list] = []  # tag, dropped, block text or None, had a nested block
        self._row: list[str] | None = None
        self._cell: list[str] | None = None
        self._link: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("iframe", "embed", "object") and (src := a.get("src") or a.get("data")):
            self.links.append((src, a.get("title", "")))
        if tag in _VOID:
            return
        dropped = tag in _DROP or any(p[1] for p in self._path)
        block = [] if tag in ("div", "article", "section", "li") and _BLOCK.search(a.get("class", "")) else None
        if block is not None:
            for p in self._path:
                p[3] = True
        self._path.append([tag, dropped, block, False])
        if tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []
        elif tag == "a" and a.get("href"):
            self._link = [a["href"], []]

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None and self._row is not None:
            self._row.append(" ".join(" ".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            self.rows.append(self._row)
            self._row = None
        elif tag == "a" and self._link:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())[:200]))
            self._link = None
        for k in range(len(self._path) - 1, -1, -1):
            if self._path[k][0] == tag:
                for _, dropped, block, nested in self._path[k:]:
                    if block and not nested and not dropped:
                        self.blocks.append(" ".join(" ".join(block).split()))
                del self._path[k:]
                break

    def handle_data(self, data):
        tags = [p[0] for p in self._path]
        if "title" in tags:
            self.title += data
        if tags and "h1" in tags and not self.h1:
            self.h1 = data.strip()
        if self._link:
            self._link[1].append(data)
        if any(p[1] for p in self._path) or "title" in tags:
            return
        if self._cell is not None:
            self._cell.append(data)
        for p in self._path:
            if p[2] is not None:
                p[2].append(data)
        if data.strip():
            self.text.append(data.strip())


def parse_page(html: str | None) -> Page:
    page = Page()
    if html:
        page.feed(html)
        page.close()
    return page


def fragments_of(html: str | None, least: int = 30) -> list[tuple[str, str, bool]]:
    """(title, text, coarse): table rows first; else course blocks; the whole page where there are neither."""
    page = parse_page(html)
    out = []
    for row in page.rows[1:]:
        text = " | ".join(c for c in row if c)
        if len([c for c in row if c]) >= 2 and len(text) >= 20:
            out.append((text[:120], text, False))
    title = page.title.strip() or page.h1
    if not out:
        seen = set()
        for b in page.blocks:
            if len(b) >= least and b.lower() not in seen:
                seen.add(b.lower())
                out.append((title[:200], b, False))
    whole = "\n".join(page.text)
    if not out and len(whole) >= least:
        out.append((title[:200], whole, True))
    return out


def html_fragments(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source_url, seq, title, raw_text, coarse) of each page's fragments; null pages have none."""

    def run(batches):
        for pdf in batches:
            rows = [(u, n, *f) for u, h in zip(pdf[url_col], pdf[html_col]) for n, f in enumerate(fragments_of(h))]
            yield pd.DataFrame(rows, columns=["source_url", "seq", "title", "raw_text", "coarse"]).astype({"seq": "int32", "coarse": bool})

    return pages.select(url_col, html_col).mapInPandas(run, "source_url string, seq int, title string, raw_text string, coarse boolean")


def html_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(page_url, href, anchor) of each link, raw; in-page, mail and script links left out."""

    def run(batches):
        for pdf in batches:
            rows = [(u, h, a) for u, x in zip(pdf[url_col], pdf[html_col]) for h, a in parse_page(x).links]
            yield pd.DataFrame(rows, columns=["page_url", "href", "anchor"])

    return pages.select(url_col, html_col).mapInPandas(run, "page_url string, href string, anchor string").where(~F.col("href").rlike(r"(?i)^(#|mailto:|tel:|javascript:)"))


def page_title(html: Column) -> Column:
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title).otherwise(F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


def sitemap_urls(xml: Column) -> Column:
    """Addresses of a sitemap that start with http."""
    return F.filter(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: u.startswith("http"))


def is_child_sitemap(url: Column) -> Column:
    return url.rlike(r"(?i)\.xml(\.gz)?$") | F.lower(F.substring_index(url, "/", -1)).contains("sitemap")


def robots_sitemaps(robots: Column) -> Column:
    return F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def content_kind(content: Column, content_type: Column, url: Column) -> Column:
    """pdf, xlsx, xls or html by type, address and first bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    ct, u = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(ct.contains("pdf") | u.rlike(r"\.pdf($|[?#])") | head.rlike(r"^(20|09|0A|0D|0C|0B)*255044462D"), "pdf")
        .when(ct.contains("spreadsheetml") | u.rlike(r"\.xlsx($|[?#])") | (F.hex(F.substring(content, 1, 4)) == "504B0304") & F.hex(content).contains("786C2F"), "xlsx")
        .when(ct.contains("ms-excel") | u.rlike(r"\.xls($|[?#])") | head.startswith("D0CF11E0A1B11AE1"), "xls")
        .otherwise("html")
    )


def xlsx_sheets(data: bytes, most: int = 2000) -> list[tuple[str, str]]:
    """(sheet, text) of a workbook; cells joined by ' | '. ValueError on what isn't one."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()))
        out = []
        for name, path in zip(names, files):
            lines = []
            for row in list(ElementTree.fromstring(z.read(path)).iter(f"{{{ns['m']}}}row"))[:most]:
                cells = []
                for c in row.findall("m:c", ns):
                    v = c.find("m:v", ns)
                    inline = c.find("m:is", ns)
                    text = strings[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else ""
                    if text and text.strip():
                        cells.append(text.strip())
                if cells:
                    lines.append(" | ".join(cells))
            out.append((name, "\n".join(lines)))
        return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError) as e:
        raise ValueError(f"no workbook: {e}") from e


def document_fragments(files: DataFrame, pdf_engine=None) -> DataFrame:
    """(source_url, media_type, page, raw_text, extraction_status) of binary documents (url, content, kind). A document whose text
    can't be had gives one flagged row, never none. pdf_engine: bytes -> list of page texts; without it PDFs are flagged."""

    def one(url, content, kind):
        try:
            parts = [(n, t) for n, (_, t) in enumerate(xlsx_sheets(content), 1)] if kind == "xlsx" else list(enumerate(pdf_engine(content), 1)) if kind == "pdf" and pdf_engine else []
            status = "needs_manual_review"
        except Exception:  # a spoilt document must not end the job
            parts, status = [], "needs_manual_review" if kind == "xlsx" else "failed_pdf_extraction"
        least = 40 if kind == "xlsx" else 120
        if sum(len(t) for _, t in parts) < least:
            return [(url, kind, None, "", status)]
        return [(url, kind, n, t, "extracted") for n, t in parts if len(t) >= 30]

    def run(batches):
        for pdf in batches:
            rows = [r for u, c, k in zip(pdf["url"], pdf["content"], pdf["kind"]) for r in one(u, bytes(c) if c is not None else b"", k)]
            yield pd.DataFrame(rows, columns=["source_url", "media_type", "page", "raw_text", "extraction_status"]).astype({"page": "Int32"})

    return files.select("url", "content", "kind").mapInPandas(run, "source_url string, media_type string, page int, raw_text string, extraction_status string")
