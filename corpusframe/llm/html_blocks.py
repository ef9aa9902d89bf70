"""HTML pages as sequences of leaf blocks with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements within a line of text; all others end a block. Fixed names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements left out with all they hold: scripts, styles, controls of forms, what no reader is shown.
RAW = frozenset("script style template iframe textarea noembed noframes xmp select title".split())
#: Those of RAW that reach to the page's end where no end tag follows; of the others only the start tag falls away then.
TO_END = frozenset("script style textarea".split())
#: Elements of formulas and drawings: within a line of text, a space before what each holds.
FOREIGN = frozenset(
    """math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover
    mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml svg g defs desc metadata symbol use path rect
    circle ellipse line polyline polygon text tspan textpath image switch marker mask clippath pattern lineargradient radialgradient stop filter
    foreignobject animate animatetransform animatemotion set mpath view""".split()
)
#: An opening tag of the key closes an open element of the value, unless a list or table lies between.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table body article section div main aside nav header footer form td th figure details".split())

MARK = re.compile(r"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|[!?/][^>]*+>)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
#: What an element that is not shown says at least; the attributes themselves decide.
MAY_HIDE = re.compile(r"hidden|style", re.I)
#: Parts of a style whose marks separate nothing.
STYLE_VALUE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*+\"|'[^']*+'|\([^()]*+\)", re.S)
NAME_WORD = re.compile(r"[a-z]+|[0-9]+")

INLINE |= FOREIGN


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # t:tag and n:name-word of the block's elements, outermost first
    leaf: str
    depth: int
    linked: int  # characters inside links


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)
    hidden: bool = False


def name_words(attrs: str) -> list[str]:
    said = " ".join(a or b or c for a, b, c in NAMES.findall(attrs))
    return NAME_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", said).lower()) if said else []


def not_displayed(style: str) -> bool:
    """Whether display: none holds in a style attribute: the last display counts, important ones first."""
    said = [(name.strip().lower(), value.lower().split("!")) for name, colon, value in (d.partition(":") for d in STYLE_VALUE.sub(" ", style).split(";")) if colon]
    shown = [(len(v) > 1 and v[1].strip() == "important", v[0].strip()) for name, v in said if name == "display"]
    return bool(shown) and ([v for strong, v in shown if strong] or [v for _, v in shown])[-1] == "none"


def hidden(attrs: str) -> bool:
    """Whether an element has a hidden attribute (other than until-found), aria-hidden true or
    display: none in its style. Names and values are parsed; of a name given twice the first counts."""
    if not MAY_HIDE.search(attrs):
        return False
    said: dict[str, str] = {}
    for name, *value in ATTR.findall(attrs):
        said.setdefault(name.lower(), html.unescape("".join(value)))
    if "hidden" in said and said["hidden"].strip().lower() != "until-found":
        return True
    return said.get("aria-hidden", "").strip().lower() == "true" or not_displayed(said.get("style", ""))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Character references are decoded, white space is one space,
    comments, scripts, styles, hidden elements, the elements of RAW and markup are left out. Broken markup never
    fails: unclosed elements end with their surroundings, unopened ends are ignored, a `<` that
    begins no tag is text."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links: list[str] = []
    at, n, links_open = 0, len(page), 0
    endless: set[str] = set()  # elements of RAW of which no end tag follows any more

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not any(o.hidden for o in stack):
                own = [o for o in stack if o.tag not in INLINE]
                path = tuple(x for o in own for x in (f"t:{o.tag}", *(f"n:{w}" for w in o.names)))
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                out.append(Block(text, path, own[-1].tag if own else "", len(own), linked))
            parts.clear()
            links.clear()

    def say(s: str) -> None:
        parts.append(s)
        if links_open:
            links.append(s)

    last = page.rfind(">")  # behind it no tag ends, and comments need not be looked for
    while at < n:
        m = MARK.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is not None:
                if tag in INLINE:
                    if any(o.tag not in INLINE for o in stack[depth:]):
                        continue
                else:
                    flush()
                del stack[depth:]
                links_open = sum(o.tag == "a" for o in stack)
            continue
        if tag in RAW or tag in ("svg", "math") and hidden(m["attrs"]):
            if tag in RAW and not (stack and stack[-1].tag in FOREIGN):
                flush()
            if not m["attrs"].rstrip().endswith("/") and tag not in endless:
                if close := re.compile(rf"</{tag}\s*>", re.I).search(page, at):
                    at = close.end()
                elif tag in TO_END:
                    at = n
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                say(" " if tag != "wbr" else "")
            elif tag in ("hr", "input"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    links_open = sum(o.tag == "a" for o in stack)
                    if tag != "tr":
                        break
                elif stack[i].tag in SCOPES:
                    break
        if tag in FOREIGN:
            say(" ")
        if not m["attrs"].rstrip().endswith("/") or tag in INLINE and tag not in FOREIGN:
            attrs = m["attrs"]
            stack.append(_Open(tag, name_words(attrs) if attrs else [], bool(attrs and tag not in FOREIGN and hidden(attrs))))
            links_open += tag == "a"
    flush()
    return out
