"""Plain text of web pages by rewriting tags: a chain of expressions, for indexing whole pages (see tests for its limits)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

#: White space that collapses, by character: a no-break space counts, bytes inside other characters don't.
SPACE = r"[ \n\t\f\r\x0B\xA0]+"


def _either(*names: str) -> str:
    """Lower or upper case as a whole, never mixed."""
    return "(?:" + "|".join(x for n in names for x in (n, n.upper())) + ")"


_HEADINGS = [f"h{i}" for i in range(1, 7)]
#: What tags turn into, in this order; every tag that is left then goes.
REWRITES = [
    (r"<!--.*?-->", ""),
    *((rf"<{n}(?:\s[^>]*)?>.*?(?:</{n}\s*>|$)", "") for tag in ("style", "script", "noscript") for n in (tag, tag.upper())),
    (rf"</{_either('title', 'ul')}\s*>", "\n\n"),
    (rf"</{_either('td')}\s*>", " "),
    (rf"<{_either('li')}(?:\s[^>]*)?/?>", "\n* "),
    (rf"</{_either('tr', 'table', 'p', 'div', *_HEADINGS)}\s*>", "\n"),
    (rf"<{_either('br', 'hr', *_HEADINGS)}(?:\s[^>]*)?/?>", "\n"),
    (r"<[/!?a-zA-Z][^>]*>", ""),
]
#: Named character references; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "deg": "°", "euro": "€"}


def collapse_whitespace(text: Column | str) -> Column:
    """Runs of white space become one space, at the ends too."""
    return F.regexp_replace(as_column(text), SPACE, " ")


def decode_entities(text: Column | str) -> Column:
    """Named references of ENTITIES, numeric ones, and last the ampersand; unknown ones stay."""
    out = as_column(text)
    for name, c in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("bigint")
        known = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.substring(piece, F.length(number) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&#"), piece))

    parts = F.split(out, "&#")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
    out = F.when(F.contains(out, F.lit("&#")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def html_to_text(page: Column | str) -> Column:
    """Text of a page: styles and scripts go with what they hold (to the end where they are not closed), tags become
    line breaks, spaces, bullets or nothing. A null page stays null."""
    out = collapse_whitespace(page)
    for pattern, text in REWRITES:
        out = F.regexp_replace(out, "(?s)" + pattern, text)
    return decode_entities(out)
