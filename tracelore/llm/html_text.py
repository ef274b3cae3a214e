"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Menus, forms, scripts, adverts, notices, comments and the like are left out by
their element, role or class. In the first pass stop-word density, length and link density decide blocks as content or
boilerplate; short ones and those of few stop words stay open. In the second pass an open block inherits the label of the nearest
decided neighbour (content where both are as near). Where no block is content by its words, long open blocks are, and where none is
long all open ones are; only a text without any tag needs the words. Where a page has an ``article`` or ``main`` element only blocks in it compete, and the thresholds
are mild; elsewhere they are strict.

Null and empty pages give an empty text; broken, unclosed or cut-off markup is read as far as it goes; repeated rows are
extracted alike; long pages are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.llm.base import in_text_batches

# Elements and words.
SKIPPED = frozenset("nav footer aside form script style noscript template svg math button select textarea iframe object canvas audio video head title dialog menu".split())
RAW = frozenset("script style noscript template svg textarea iframe title math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary"}
ROOTS = frozenset(("article", "main"))
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related "
    "alert copyright disclaimer login masthead outbrain overlay popular recommended recommendations search signup taboola trending "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets toc respond responses replies".split()
)
#: Of a layout that has such a part (``with-sidebar``), not of the part itself.
LAYOUT = frozenset("with without has no is".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form toolbar".split())
STOP_WORDS = frozenset(
    "the of and a to in is that for it on as with was by at from this are be or an not have has but they he she his her their we you "
    "de la le les et en que du des un une est pour dans qui par sur pas au avec ce il elle se plus ne ou son "
    "el los las y una por con para del al no su lo como es más o pero sus "
    "der die das und zu den von mit sich ein eine ist auf für im dem nicht des auch als an aus bei nach wie oder einer".split()
)
TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")
SHORT = 40
#: Stop words per word, characters, and linked share that decide a block: (in a root, elsewhere).
FEW_STOP_WORDS, MANY_LINKS, LONG = (0.0, 0.12), (0.6, 0.33), (40, 120)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    rooted: bool = False
    heading: bool = False
    text: str = ""
    label: bool | None = None


def _boilerplate(name: str, attributes: str, rooted: bool, by_class: bool) -> bool:
    if name in SKIPPED or (name == "header" and not rooted):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if by_class and key in ("class", "id") and name not in ("html", "body", "main"):
            for label in value.split():
                words = set(re.split(r"[^a-z0-9]+", CAMEL.sub("-", label).lower()))
                if LAYOUT.isdisjoint(words) and (not BOILERPLATE.isdisjoint(words) or ("header" in words and not rooted)):
                    return True
    return False


def blocks_of(page: str, by_class: bool = True) -> list[Block]:
    """Blocks outside boilerplate elements, in page order, with their text. Without ``by_class`` classes and ids tell nothing."""
    out, block = [], Block()
    stack: list[tuple[str, bool, bool]] = []  # open element, whether it is left out, whether it is or lies in a root
    at, links = 0, 0

    def flush() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text = text
            out.append(block)
        block = Block()

    def pop(name: str) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                links -= sum(s[0] == "a" for s in stack[k:])
                del stack[k:]
                return

    def text(piece: str) -> None:
        if piece and not (stack and stack[-1][1]):
            said = entities.unescape(piece)
            block.parts.append(said)
            block.rooted = bool(stack and stack[-1][2])
            if links:
                block.linked += len(said.strip())

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at: m.start()])
        if m[1]:
            stop = page.find("-->", m.end())
            at = len(page) if stop < 0 else stop + 3
            continue
        end = END.match(page, m.end())
        if not end:
            stop = page.find(">", m.end())
            if stop < 0:
                break  # cut off inside a tag
            close = stop + 1
        else:
            close = end.end()
        at = close
        if m[4]:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            if name == "br":
                text(" ")
            pop(name)
            continue
        attributes = page[m.end(): close - 1]
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        links -= sum(s[0] == "a" for s in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
        elif name == "br":
            text(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        above = stack[-1] if stack else ("", False, False)
        skipped = above[1] or _boilerplate(name, attributes, above[2], by_class)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE).search(page, at)
            if not stop:
                break  # never closed: the rest is its content
            at = stop.start()
        stack.append((name, skipped, above[2] or name in ROOTS))
        if name == "a":
            links += 1
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            block.heading = True
    flush()
    return out


def first_pass(block: Block) -> bool | None:
    """Content, boilerplate or open."""
    k = 0 if block.rooted else 1
    n = len(block.text)
    if block.linked > MANY_LINKS[k] * n:
        return False
    if n < SHORT or block.heading:
        return None
    words = [w.lower() for w in WORD.findall(block.text)]
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    # Few stop words may also be a table, code or another language: left open.
    return True if n >= LONG[k] and density >= FEW_STOP_WORDS[k] else None


def second_pass(labels: list[bool | None], default: list[bool]) -> list[bool]:
    """Open blocks take the nearest decided label, content on a tie; with none decided their default."""
    last, before = None, []
    for i, label in enumerate(labels):
        last = (i, label) if label is not None else last
        before.append(last)
    nxt, out = None, [False] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        nxt = (i, labels[i]) if labels[i] is not None else nxt
        left, right = before[i], nxt
        if left is None and right is None:
            out[i] = default[i]
        elif left is None or right is None:
            out[i] = (left or right)[1]
        elif i - left[0] == right[0] - i:
            out[i] = left[1] or right[1]
        else:
            out[i] = (left if i - left[0] < right[0] - i else right)[1]
    return out


def main_text(page: str | None) -> str:
    # A class on a wrapper of everything would leave nothing.
    blocks = blocks_of(page or "") or blocks_of(page or "", False)
    if any(b.rooted for b in blocks):
        blocks = [b for b in blocks if b.rooted]
    labels = [first_pass(b) for b in blocks]
    if True not in labels and any(m[3] for m in TAG.finditer(page or "")):
        # Without known words length tells, and where nothing is long all that is open is content.
        known = [len(b.text) >= LONG[not b.rooted] or None if label is None and not b.heading else label for b, label in zip(blocks, labels, strict=True)]
        labels = known if True in known else [label is None for label in labels]
    labels = second_pass(labels, [b.rooted for b in blocks])
    return " ".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


@F.pandas_udf(T.StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype="object")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    return in_text_batches(pages).select("page_id", "url", main_texts("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
