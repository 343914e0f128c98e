"""URLs and raw HTML as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a page whose content is no markup; they do not nest, and one without an end takes the rest.
_RAW = (
    r"(?is)<!--.*?(?:-->|\z)",
    r"(?is)<script\b.*?(?:</script>|\z)",
    r"(?is)<style\b.*?(?:</style>|\z)",
    r"(?is)<title\b.*?(?:</title>|\z)",
)
# Elements that hold blocks and are closed by name; those of the second line never hold article text.
FOREIGN = ("nav", "footer", "aside", "form", "button", "select", "menu")
CONTAINERS = (
    "html", "body", "main", "article", "section", "div", "header", "ul", "ol", "dl", "table", "blockquote", "figure",
    *FOREIGN,
)
# Elements that only begin or end a block, closed or not.
EDGES = ("p", "li", "h[1-6]", "tr", "td", "th", "dt", "dd", "pre", "br", "hr")
STRUCTURE = rf"(?i)<(/?)({'|'.join([*CONTAINERS, *EDGES])})\b[^<>]*>"
# Containers inside more than this many others count as part of the innermost.
MAX_DEPTH = 64
# Marks in a text without tags: before a structural tag, after it, and around a link.
_TAG, _TAG_END, _LINK, _LINK_END = "\x01", "\x02", "\x03", "\x04"

# The ampersand comes last, so that escaped escapes are not opened twice.
_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&apos;", "'"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
)


def url_eligible(url: Column) -> Column:
    """Pages worth fetching: a non-empty address that does not end in ``.pdf``."""
    return (url != "") & ~url.endswith(".pdf")


def host(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


_NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _numeric_character(entity: Column) -> Column:
    """The character of a numeric entity; a number that names none stays as it is."""
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.regexp_extract(entity, r"([0-9a-fA-F]+);", 1)
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    named = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(named, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(c: Column) -> Column:
    """Entities as characters: numeric ones, the named ones below, the ampersand last."""
    numeric = F.array_distinct(F.regexp_extract_all(c, F.lit(_NUMERIC), F.lit(0)))
    c = F.aggregate(numeric, c, lambda text, entity: F.replace(text, entity, _numeric_character(entity)))
    for entity, plain in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def _plain(c: Column) -> Column:
    c = unescape(F.regexp_replace(c, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_title(html: Column) -> Column:
    return _plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def _attribute(html: Column, tag: str, having: str, attribute: str) -> Column:
    """An attribute of the first ``tag`` with another one, in either order and quoting."""
    found = rf"""(?is)<{tag}\b(?=[^>]*\b{having})[^>]*\b{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(html, found, 1), F.regexp_extract(html, found, 2))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    return _plain(_attribute(html, "meta", rf"""{attribute}\s*=\s*["']{value}["']""", "content"))


def canonical_url(html: Column) -> Column:
    return unescape(_attribute(html, "link", r"""rel\s*=\s*["']canonical["']""", "href"))


def _pieces(html: Column) -> Column:
    """Structural tags in page order, each with the text up to the next one.

    Fields: ``name``; ``kind``, 1 where a container opens and -1 where it closes; ``text``;
    ``words``; and ``linked`` where links make up more than half of the text.
    """
    html = F.translate(html, _TAG + _TAG_END + _LINK + _LINK_END, "    ")
    for pattern in _RAW:
        html = F.regexp_replace(html, pattern, " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)<a\b[^<>]*>", _LINK), r"(?i)</a\s*>", _LINK_END)
    html = F.regexp_replace(html, STRUCTURE, f"{_TAG}$1$2{_TAG_END}")
    html = F.regexp_replace(html, r"<[^<>]*>", " ")

    def piece(c: Column) -> Column:
        tag, raw = F.lower(F.substring_index(c, _TAG_END, 1)), F.substring_index(c, _TAG_END, -1)
        name = F.ltrim(tag, F.lit("/"))
        kind = F.when(name.isin(*CONTAINERS), F.when(tag == name, 1).otherwise(-1)).otherwise(0)
        links = F.array_join(F.regexp_extract_all(raw, F.lit(f"{_LINK}[^{_LINK_END}]*{_LINK_END}"), F.lit(0)), "")
        text = F.trim(F.regexp_replace(unescape(F.translate(raw, _LINK + _LINK_END, "  ")), r"\s+", " "))
        return F.struct(
            name.alias("name"), kind.alias("kind"), text.alias("text"), F.size(F.split(text, " ")).alias("words"),
            (F.length(links) * 2 > F.length(raw)).alias("linked"),
        )

    return F.transform(F.split(F.concat(F.lit(_TAG_END), html), _TAG), piece)


def _text_blocks(pieces: Column, min_words: int) -> Column:
    """Blocks of article text: the containers around each (``path``, outermost first), text and words.

    A fold over the tags keeps the open containers. A closing tag ends the innermost open
    container of its name and all in it; without one it is ignored.
    """
    start = F.struct(
        F.lit(0).alias("pos"),
        F.array(F.lit(0)).alias("path"),
        F.array(F.lit("")).alias("names"),
        F.lit(0).alias("deeper"),
        F.array().cast("array<struct<path:array<int>,text:string,words:int>>").alias("blocks"),
    )

    def fold(state: Column, piece: Column) -> Column:
        path, names, kind = state["path"], state["names"], piece["kind"]
        full = F.size(path) > MAX_DEPTH
        back = F.array_position(F.reverse(names), piece["name"]).cast("int")
        opens = (kind == 1) & ~full
        closes = (kind == -1) & (state["deeper"] == 0) & (back > 0)

        def after(stack: Column, entry: Column) -> Column:
            left = F.slice(stack, F.lit(1), F.size(stack) - back)
            return F.when(opens, F.array_append(stack, entry)).when(closes, left).otherwise(stack)

        deeper = F.when((kind == 1) & full, 1).when((kind == -1) & (state["deeper"] > 0), -1).otherwise(0)
        now, inside = after(path, state["pos"]), after(names, piece["name"])
        own = ~F.arrays_overlap(inside, F.array(*map(F.lit, FOREIGN)))
        holds = (piece["words"] >= min_words) & ~piece["linked"] & own
        block = F.struct(now.alias("path"), piece["text"].alias("text"), piece["words"].alias("words"))
        return F.struct(
            (state["pos"] + 1).alias("pos"),
            now.alias("path"),
            inside.alias("names"),
            (state["deeper"] + deeper).alias("deeper"),
            F.when(holds, F.array_append(state["blocks"], block)).otherwise(state["blocks"]).alias("blocks"),
        )

    return F.aggregate(pieces, start, fold, lambda state: state["blocks"])


def _best_container(blocks: Column) -> Column:
    """The container of greatest score, the first of equal ones.

    A block gives twice its words to its container and its words to the next one.
    """

    def shares(block: Column) -> Column:
        path, size = block["path"], F.size(block["path"])
        own = F.struct(F.element_at(path, -1).alias("node"), (block["words"] * 2).alias("score"))
        outer = F.struct(F.get(path, size - 2).alias("node"), block["words"].alias("score"))
        return F.array(own, outer)

    given = F.filter(F.flatten(F.transform(blocks, shares)), lambda share: share["node"].isNotNull())

    def fold(state: Column, share: Column) -> Column:
        total = share["score"] + F.when(share["node"] == state["node"], state["total"]).otherwise(0)
        better = total > state["most"]
        return F.struct(
            share["node"].alias("node"),
            total.alias("total"),
            F.when(better, share["node"]).otherwise(state["best"]).alias("best"),
            F.when(better, total).otherwise(state["most"]).alias("most"),
        )

    names = ("node", "total", "best", "most")
    start = F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (-1, 0, 0, 0), strict=True)))
    return F.aggregate(F.array_sort(given), start, fold, lambda state: state["best"])


def main_text(html: Column, min_words: int = 5) -> Column:
    """Text of the article: blocks of at least ``min_words`` words, one per line.

    Blocks score for the containers around them, and those inside the best container are
    kept. Navigation, footers, asides and forms hold no article text at any depth, nor do
    blocks that are mostly links. A null page stays null.
    """

    def kept(blocks: Column) -> Column:
        # A lambda's variable is computed once, however often it is used.
        best = F.transform(F.array(_best_container(blocks)), lambda node: F.filter(blocks, lambda b: F.array_contains(b["path"], node)))
        return F.array_join(F.transform(best[0], lambda b: b["text"]), "\n")

    return F.transform(F.array(_text_blocks(_pieces(html), min_words)), kept)[0]
