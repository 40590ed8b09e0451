"""What a reader sees of HTML: visible text, links and images, from a documented part of the hiding rules.

Modelled: elements that never show, the hidden attribute, inline and simple class, id and tag rules for display,
visibility, opacity, font-size 0 and text in the colour of its background. Whatever else a style sheet does sets
``uncertain``, so that a calm verdict can abstain. Work is bounded by the markup's length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENT = frozenset("script style noscript template head title svg math object iframe select textarea canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
#: What a start tag ends without an end tag: elements of these names, up to the first of those that hold them.
ENDED_BY = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (frozenset(["p"]), frozenset("button td th caption object marquee html table".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu td th table".split())), "dt": (frozenset(["dt", "dd", "p"]), frozenset("dl td th table".split())), "dd": (frozenset(["dt", "dd", "p"]), frozenset("dl td th table".split())),
    "td": (frozenset(["td", "th", "p"]), frozenset("tr table".split())), "th": (frozenset(["td", "th", "p"]), frozenset("tr table".split())), "tr": (frozenset(["tr", "td", "th", "p"]), frozenset("table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th p".split()), frozenset(["table"])), "thead": (frozenset("tbody thead tfoot tr td th p".split()), frozenset(["table"])), "tfoot": (frozenset("tbody thead tfoot tr td th p".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())), "optgroup": (frozenset(["option", "optgroup"]), frozenset("select datalist".split())), "body": (frozenset(["head"]), frozenset(["html"])),
}
#: An end tag looks for its element no further out than these.
WALLS = frozenset("table td th body html".split())
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
REFERENCE = re.compile(r"&(#(?:\d+|[xX][\da-fA-F]+);|\w+;)?")
SIMPLE = re.compile(r"^(?:[a-z][a-z0-9]*|[.#][\w-]+)$", re.I)
SCHEMA = "visible string, hidden_chars long, links array<struct<label:string,destination:string>>, data_images long, remote_images long, other_images long, password_form boolean, uncertain boolean"


def declarations(text: str) -> dict[str, str]:
    out = {}
    for part in text.lower().split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip()] = value.replace("!important", "").strip()
    return out


def hides(style: dict[str, str]) -> bool:
    zero = re.compile(r"^0+(?:\.0*)?(?:px|pt|em|rem|%)?$")
    colour = style.get("color")
    return (
        style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")
        or bool(zero.match(style.get("opacity", "1"))) or bool(zero.match(style.get("font-size", "1px"))) or (pixels(style.get("font-size", "9px")) or 9) <= 1
        or bool(colour) and _same(colour, style.get("background-color", style.get("background", "")))
        or (pixels(style.get("text-indent", "0")) or 0) <= -999 or (style.get("position") in ("absolute", "fixed") and min(pixels(style.get("left", "0")) or 0, pixels(style.get("top", "0")) or 0) <= -999)
        or (style.get("overflow") == "hidden" and any(pixels(style.get(k, "9px")) == 0 for k in ("height", "max-height", "width", "max-width")))
    )


def _same(colour: str, ground: str) -> bool:
    """Text that is not told from its background: a contrast of at most 1.1, or the same words for both."""
    if not ground:
        return False
    ratio = contrast(colour, ground)
    return ratio <= 1.1 if ratio is not None else colour == ground


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[dict] = []
        self.images = [0, 0, 0]
        self.rules: dict[str, bool] = {}
        self.uncertain = self.password = False
        self.stack: list[tuple[str, bool]] = []
        self.anchor: tuple[str, int] | None = None
        self.in_style = self.in_form = False

    def _concealed(self, tag: str, attrs: dict) -> bool:
        if tag in SILENT or "hidden" in attrs or attrs.get("type", "").lower() == "hidden" or hides(declarations(attrs.get("style") or "")):
            return True
        keys = [tag, *(f".{c}" for c in (attrs.get("class") or "").split()), f"#{attrs.get('id')}"]
        return any(self.rules.get(k.lower()) for k in keys)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.in_form = True
        if tag == "input" and attrs.get("type", "").lower() == "password" and "disabled" not in attrs and (self.in_form or "form" in attrs):
            self.password = True
        if tag == "img":
            source = attrs.get("src", "").strip().lower()
            self.images[0 if source.startswith("data:") else 1 if source.startswith(("http:", "https:", "//")) else 2] += 1
        if tag in BLOCK:
            self.out.append("\n")
        if tag in ENDED_BY:
            self._imply(*ENDED_BY[tag])
        if tag in VOID:
            return
        above = bool(self.stack) and self.stack[-1][1]
        self.stack.append((tag, above or self._concealed(tag, attrs)))
        if tag == "a" and "href" in attrs:
            self.anchor = (attrs["href"].strip(), len(self.out))
        self.in_style = tag == "style"

    def _imply(self, ended: frozenset, holders: frozenset) -> None:
        """Ends open elements of these names that nothing of the holders encloses, with all inside of them."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in holders:
                return
            if self.stack[i][0] in ended:
                cut = i
                while cut and self.stack[cut - 1][0] in ended:
                    cut -= 1
                del self.stack[cut:]
                return self._imply(ended, holders)

    def handle_endtag(self, tag):
        if tag == "form":
            self.in_form = False
        if tag == "a" and self.anchor:
            label = " ".join("".join(self.out[self.anchor[1]:]).split())
            self.links.append({"label": label, "destination": self.anchor[0]})
            self.anchor = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if self.stack[i][0] in WALLS and tag not in WALLS:
                break
        if tag in BLOCK:
            self.out.append("\n")
        self.in_style = False

    def handle_data(self, data):
        if self.in_style:
            if "@" in data:
                self.uncertain = True
            for selectors, body in RULE.findall(data):
                style = declarations(body)
                for s in (x.strip() for x in selectors.split(",")):
                    if SIMPLE.match(s):
                        if hides(style):
                            self.rules[s.lower()] = True
                    elif hides(style) or "position" in style or "clip" in style:
                        self.uncertain = True
        elif self.stack and self.stack[-1][1]:
            if not any(t in SILENT for t, _ in self.stack):
                self.hidden += len(data.strip())
        else:
            self.out.append(data)


def closed_only(html: str) -> str:
    """html with every ampersand escaped that begins no character reference with a known name or number and its semicolon."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def read(html: str | None, open_references: bool = True) -> dict:
    """What SCHEMA names. open_references: a character reference whose semicolon is missing stands for its character where
    browsers read it so (&amp); if false, it stays as it is written."""
    reader = Reader()
    reader.feed((html or "") if open_references else closed_only(html or ""))
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
    return {
        "visible": "\n".join(x for x in lines if x), "hidden_chars": reader.hidden, "links": reader.links, "data_images": reader.images[0], "remote_images": reader.images[1],
        "other_images": reader.images[2], "password_form": reader.password, "uncertain": reader.uncertain,
    }


def visible(df: DataFrame, *, id_col: str, html_col: str, open_references: bool = True) -> DataFrame:
    """One row for each input row: the id and what SCHEMA names; see read."""
    kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("label", pa.string()), ("destination", pa.string())]))
        types = [pa.string(), pa.int64(), link, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                found = [read(x.as_py(), open_references) for x in batch.column(1).slice(a, 256)]
                names = list(found[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), *(pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True))], names=[id_col, *names])

    return df.select(id_col, F.col(html_col).alias("_html")).mapInArrow(parse, f"`{id_col}` {kind}, {SCHEMA}")


def srgb(colour: str) -> tuple[float, float, float] | None:
    """Red, green and blue from 0 to 1 of #rgb, #rrggbb, rgb() or one of the sixteen basic names; None for others."""
    c = colour.strip().lower()
    c = BASIC.get(c, c)
    if m := re.fullmatch(r"#([0-9a-f])([0-9a-f])([0-9a-f])", c):
        return tuple(int(x * 2, 16) / 255 for x in m.groups())
    if m := re.fullmatch(r"#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})", c):
        return tuple(int(x, 16) / 255 for x in m.groups())
    if m := re.fullmatch(r"rgba?\(\s*(\d{1,3})[\s,]+(\d{1,3})[\s,]+(\d{1,3})(?:[\s,/]+[\d.]+%?)?\s*\)", c):
        return tuple(min(255, int(x)) / 255 for x in m.groups())
    return None


#: The basic colour names.
BASIC = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080", "fuchsia": "#ff00ff",
    "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080", "aqua": "#00ffff",
}


def contrast(a: str, b: str) -> float | None:
    """Contrast of two colours, 1 to 21, by their relative luminance; None if one is not understood."""
    light = []
    for colour in (a, b):
        rgb = srgb(colour)
        if rgb is None:
            return None
        linear = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in rgb]
        light.append(0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2])
    return (max(light) + 0.05) / (min(light) + 0.05)


#: Pixels of a length's unit, with an em of 16 pixels.
UNITS = {"px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6, "em": 16.0, "rem": 16.0, "ex": 8.0, "ch": 8.0}


def pixels(length: str) -> float | None:
    """A length in pixels; None for shares and what is no length."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))(px|pt|pc|in|cm|mm|q|em|rem|ex|ch)?\s*", length.lower())
    if not m or (m[2] is None and float(m[1]) != 0):
        return None
    return float(m[1]) * UNITS[m[2] or "px"]


def image_dominant(remote_images, visible) -> "F.Column":
    """A message that is a picture: a remote image and fewer than 80 visible characters."""
    return (F.coalesce(remote_images, F.lit(0)) > 0) & (F.length(F.regexp_replace(F.coalesce(visible, F.lit("")), "[ \\t\\r\\n]", "")) < 80)


@F.udtf(returnType="label string, destination string")
class ExtractLinks:
    """Links of a page as a table function: SELECT * FROM pages, LATERAL extract_links(html)."""

    def eval(self, html: str):
        for link in read(html)["links"]:
            yield link["label"], link["destination"]


def register(spark) -> None:
    """Makes extract_links known to SQL."""
    spark.udtf.register("extract_links", ExtractLinks)


def model_views(plain, visible, subject, most: int = 16):
    """What a model reads of a message: the subject with each of its bodies, blank ones left out, each once, at most so many;
    a message without bodies is its subject alone."""
    head = F.coalesce(subject, F.lit(""))
    bodies = F.filter(F.concat(F.coalesce(plain, F.array().cast("array<string>")), F.coalesce(visible, F.array().cast("array<string>"))), lambda b: F.trim(F.coalesce(b, F.lit(""))) != "")
    views = F.transform(F.array_distinct(F.transform(bodies, lambda b: F.trim(b))), lambda b: F.regexp_replace(F.concat(head, F.lit("\n\n"), b), r"^\s+", ""))
    return F.slice(F.when(F.size(views) > 0, views).otherwise(F.array(F.trim(head))), 1, most)
