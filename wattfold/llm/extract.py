"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides each block from its stop-word density, length and link
density, together with the region it lies in (article, menu, footer, ...); blocks too short to decide stay open. Pass
two gives each open block the label of its nearest decided neighbours, or the region's own default.

Where no block has stop words enough (other languages than the lists'), length and link density decide alone. Hints of
a clutter region around the page's only article or main do not count.

Defined cases: null or empty html gives an empty text; pages are whole, whatever their length; repeated pages give
repeated rows; an unclosed comment, script or style runs to the end of the page, as browsers read it; other columns of
the input are kept, but for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tags and words of the markup language and of common page templates.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object noembed noframes xmp".split())
CLUTTER = frozenset("nav header footer aside form menu dialog head select button fieldset".split())
CONTENT = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments disqus reply replies respond related share sharing social widget toolbar copyright pager pagination".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at from this have or an not which but they you were "
    "der die das und in zu den von ist mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un une du que est pour qui dans par sur au plus pas ce il avec se sont ou "
    "el los y las del con una por su para es al lo como más pero sus le ya o este sí porque esta son entre".split()
)
NEGATIONS = frozenset("with without no has have not".split())  # 'no-sidebar' is a page's layout
LINKS_MOST, SHORT, LONG, DENSE, SPARSE = 0.4, 70, 200, 0.28, 0.12

_tag = re.compile(r"""<(?:(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+)>|(?P<other>[!?/][^>]*>?|[A-Za-z][^>]*>?))""")
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_end = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_space = re.compile(r"\s+")


def _is_clutter(name: str, attrs: str) -> bool:
    if name in CLUTTER:
        return True
    if not attrs or name in CONTENT or name in ("html", "body"):
        return False
    if _hidden.search(attrs):
        return True
    return False


def _is_hinted(name: str, attrs: str) -> bool:
    """A class, id or role names a clutter region."""
    if not attrs or name in CONTENT or name in ("html", "body"):
        return False
    for token in " ".join(x for found in _named.findall(attrs) for x in found).split():
        parts = [p.lower() for p in _parts.findall(token)]
        if parts and parts[0] not in NEGATIONS and not HINTS.isdisjoint(parts):
            return True
    return False


def blocks(page: str, hints: bool = True) -> list[tuple[str, int, bool, bool]]:
    """Without ``hints``, those of an article's or main's ancestors don't count inside it. Text, characters inside links, in a cluttered region, in an article: for each block in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, cluttered, article, cluttered by a hint only; what lies outside counts through
    buffer: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _space.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                top = stack[-1] if stack else ("", False, False, False)
                out.append((text, linked, top[1] or top[3], top[2]))
            buffer.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        buffer.append(raw)
        if in_link:
            linked += len(raw.strip())

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        m = _tag.match(page, begin)
        if not m:
            add("<")
            at = begin + 1
            continue
        at = m.end()
        if m["other"] is not None:
            continue
        name, closing = m["name"].lower(), bool(m["close"])
        if name in RAW and not closing:
            end = _end[name].search(page, at)
            if name in BLOCK:
                flush()
            at = end.start() if end else size
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            buffer.append(" ")
        elif name in BLOCK:
            flush()
            in_link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in CONTENT and name not in ("body", "html"):
                        break  # a stray end tag inside an article doesn't end the article
            elif name not in VOID:
                if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends here
                    stack.pop()
                _, bad, article, hinted = stack[-1] if stack else ("", False, False, False)
                hinted = (hinted and (hints or name not in CONTENT)) or _is_hinted(name, m["attrs"])
                stack.append((name, bad or _is_clutter(name, m["attrs"]), article or name in CONTENT, hinted))
    flush()
    return out


def _share(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _foreign(found: list[tuple[str, int, bool, bool]]) -> bool:
    """No block of the page that could be main text looks like one of the languages with stop words."""
    return all(_share(text) < SPARSE for text, linked, bad, _ in found if not bad and len(text) >= SHORT and linked / len(text) <= LINKS_MOST)


def label(text: str, linked: int, cluttered: bool, article: bool, foreign: bool = False) -> bool | None:
    """True: main text. False: clutter. None: undecided. In a foreign page length and links decide alone."""
    if cluttered:
        return False
    if linked / len(text) > LINKS_MOST:
        return None if article else False  # a line of the article may be a link
    if len(text) < SHORT:
        return None if not linked or article else False
    if foreign:
        return True if linked / len(text) <= LINKS_MOST / 2 else None
    dense = _share(text)
    if dense >= DENSE and len(text) >= LONG:
        return True
    if dense >= SPARSE or article:
        return True if article and dense >= SPARSE else None
    return False


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    inside = any(article and not bad for _, _, bad, article in found)
    if not inside and any(article for _, _, _, article in found):  # all articles lie in regions that a hint calls clutter
        found = blocks(page or "", hints=False)
        inside = any(article and not bad for _, _, bad, article in found)
    foreign = _foreign(found)
    first = [False if inside and not b[3] else label(*b, foreign) for b in found]  # a page that marks its article has its text there
    before: list[bool | None] = []
    last: tuple[int, bool] | None = None
    for k, x in enumerate(first):
        last = (k, x) if x is not None else last
        before.append(last)
    keep, ahead = [False] * len(found), None
    for k in range(len(found) - 1, -1, -1):
        x = first[k]
        if x is not None:
            ahead = (k, x)
            keep[k] = x
        elif found[k][3]:
            keep[k] = True  # undecided, but inside the article: the region decides
        else:
            near = [n for n in (before[k], ahead) if n]
            least = min((abs(n[0] - k) for n in near), default=0)
            keep[k] = any(n[1] for n in near if abs(n[0] - k) == least)
    return " ".join(b[0] for b, good in zip(found, keep, strict=True) if good)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The input with ``text`` and ``n_chars`` (code points) of each page's main text instead of the html column."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*kept, "text", "n_chars"],
            )

    return pages.select(*(pages[c] for c in kept), pages[column].cast("string")).mapInArrow(run, schema)
