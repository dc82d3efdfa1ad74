"""Scalar functions on text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.schemas import ID_ALPHABET, ID_DIGITS, ID_PREFIXES

#: Ranges of code points that take two columns.
WIDE = "[\\u1100-\\u115F\\u2E80-\\uA4CF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFE30-\\uFE4F\\uFF00-\\uFF60\\uFFE0-\\uFFE6]"
SPACE = "[ \\t\\n\\r\\f\\x0B]"


def visual_width(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def unescape_html(text: Column) -> Column:
    """The five named entities and decimal references to printable ASCII are left to the readers; here the named ones."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def longest_run(text: Column, char: str) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({char}+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence_length(text: Column) -> Column:
    return F.greatest(F.lit(3), longest_run(text, "`") + 1)


def inline_code(text: Column) -> Column:
    ticks = F.repeat(F.lit("`"), F.length(F.regexp_replace(text, "[^`]", "")) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(ticks, pad, text, pad, ticks)


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def indent_lines(text: Column, prefix: str) -> Column:
    return F.regexp_replace(text, "(?m)^(?=.)", prefix)


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def context_of(text: Column, exact: Column, width: int = 8) -> tuple[Column, Column]:
    """Up to width characters before and after the first match; null where there is none."""
    at = F.instr(text, exact)
    start = F.greatest(at - width, F.lit(1))
    before = F.when(at > 0, F.substring(text, start, at - start))
    return before, F.when(at > 0, F.substring(text, at + F.length(exact), F.lit(width)))


def split_author(author: Column) -> tuple[Column, Column]:
    """Type and id at the first colon; a missing id is empty."""
    return F.trim(F.substring_index(author, ":", 1)), F.trim(F.when(F.instr(author, ":") > 0, F.substring(author, F.instr(author, ":") + 1, F.length(author))).otherwise(""))


def find_all(text: Column, query: str) -> Column:
    """Number of non-overlapping matches of a literal."""
    return F.when(F.lit(len(query)) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, F.lit(query), F.lit("")))) / len(query)).cast("int"))


def recovery_name(key: Column, suffix: str = ".draft.json") -> Column:
    return F.concat(F.substring(F.sha2(key, 256), 1, 24), F.lit(suffix))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fenced_json(text: Column) -> Column:
    """JSON object of a fenced block, else the text itself; null if it is no object."""
    inner = F.regexp_extract(text, "(?s)```json\\s*(.*?)\\s*```", 1)
    found = F.trim(F.when(inner == "", text).otherwise(inner))
    return F.when(found.startswith("{") & F.try_parse_json(found).isNotNull(), found)


def front_matter(text: Column, key: str) -> Column:
    """Value of a key in a leading --- block; null without one."""
    block = F.regexp_extract(text, "(?s)^---\\n(.*?)\\n---", 1)
    found = F.regexp_extract(block, f"(?m)^{key}:\\s*(.*)$", 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, "^[\"']|[\"']$", "")))


def text_pieces(text: Column) -> Column:
    """Words and blanks of a text: Str and Space of a document tree."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def percent_encoded(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


# formats


def points(value: Column, per_point: int) -> Column:
    """Half points (2) or twips (20) as points with a unit: whole, or one decimal."""
    pt = value / per_point
    return F.when(pt == F.floor(pt), F.concat(F.floor(pt).cast("string"), F.lit("pt"))).otherwise(F.concat(F.format_string("%.1f", pt), F.lit("pt")))


def heading_level(outline: Column, name: Column, style_id: Column) -> Column:
    by = lambda c: F.regexp_extract(c, "(?i)^heading ?([1-6])$", 1).try_cast("int")
    return F.coalesce(F.when(outline.between(0, 5), outline + 1), by(name), by(style_id))


def detect_format(path: Column) -> Column:
    """markdown, html or docx by extension; null for others, and for text, which is written only."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").when(ext == "docx", "docx")


#: Where each cached format lies.
COMPAT = {
    "markdown": "compatibility/markdown/document.md",
    "text": "compatibility/text/document.txt",
    "html": "compatibility/html/index.html",
    "docx": "compatibility/docx/document.docx",
}


def compat_path(fmt: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, v in COMPAT.items():
        found = F.when(fmt == k, v).otherwise(found)
    return found


def css_string(text: Column) -> Column:
    """Text inside a quoted CSS content value."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\A "))


def character_css(bold: Column, italic: Column, size: Column, color: Column) -> Column:
    return F.concat_ws(
        "; ", F.when(bold, "font-weight: bold"), F.when(italic, "font-style: italic"), F.concat(F.lit("font-size: "), size.cast("string"), F.lit("pt")), F.concat(F.lit("color: "), color)
    )


def page_css(width: Column, height: Column, margin: Column) -> Column:
    """Page rule with a margin clamped to 5-60 mm."""
    clamped = F.least(F.greatest(F.coalesce(margin, F.lit(20.0)), F.lit(5.0)), F.lit(60.0))
    orientation = F.when(width > height, "landscape").otherwise("portrait")
    return F.format_string("@page { size: %.1fmm %.1fmm; margin: %.1fmm } /* %s */", width.cast("double"), height.cast("double"), clamped.cast("double"), orientation)


# identifiers


def identifier(n: Column, prefix: str) -> Column:
    """A counter in base 32, least significant digit first; the powers stop before they overflow."""
    power = F.lit(1).cast("long")
    digits = []
    for i in range(ID_DIGITS):
        value = F.lit(0) if i >= 12 else F.pmod(F.floor(n / F.lit(32**i)), F.lit(32)).cast("int")
        digits.append(F.substring(F.lit(ID_ALPHABET), value + 1, F.lit(1)))
    del power
    return F.concat(F.lit(prefix + "_"), *digits)


def valid_id(value: Column) -> Column:
    return value.rlike(f"^({'|'.join(ID_PREFIXES)})_[0-9A-HJKMNP-TV-Z]{{{ID_DIGITS}}}$")


def is_active(name: Column) -> Column:
    return F.lower(name).isin("script", "iframe", "object", "embed", "applet")


def safe_url(url: Column, kind: str = "link") -> Column:
    schemes = ["http", "https"] if kind == "image" else ["http", "https", "mailto", "tel"]
    value = F.trim(url)
    scheme = F.lower(F.regexp_extract(value, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    bitmap = value.rlike("(?i)^data:image/(png|jpeg|jpg|gif|webp|avif|bmp|x-icon)[;,]") if kind == "image" else F.lit(False)
    return F.when(value == "", False).when(value.rlike("^[#/.]") | (scheme == ""), True).otherwise(scheme.isin(schemes) | bitmap)


def safe_part(name: Column) -> Column:
    return ~name.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~name.rlike(r"^[/\\]|^[A-Za-z]:") & (name != "")


def has_class(classes: Column, name: str) -> Column:
    return F.array_contains(F.split(F.trim(classes), r"\s+"), name)


def class_language(classes: Column) -> Column:
    found = F.regexp_extract(classes, r"(?:^|\s)language-(\S+)", 1)
    return F.when(found != "", found)


def inject_attribute(html: Column, name: str, value: Column) -> Column:
    """An attribute before the first > of a fragment that begins with a tag."""
    at = F.instr(html, ">")
    put = F.concat(F.substring(html, F.lit(1), at - 1), F.lit(f' {name}="'), escape_html(value, True), F.lit('"'), F.substring(html, at, F.length(html)))
    return F.when(html.startswith("<") & (at > 0) & (value != ""), put).otherwise(html)


def inject_before_last(html: Column, mark: str, added: str) -> Column:
    """Text before the last occurrence of a mark; at the end without one."""
    parts = F.split(html, mark, -1)
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), mark)
    return F.when(F.size(parts) > 1, F.concat(head, F.lit(added + mark), F.element_at(parts, -1))).otherwise(F.concat(html, F.lit(added)))


def largest_number_after(text: Column, mark: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(mark + r"\s*(\d+)"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.try_cast("long")))


def resolve_entity(name: Column) -> Column:
    """Named and numeric character references; unknown ones stay as they are."""
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    out = F.when(name.rlike("^#[0-9]+$"), F.chr(F.substring(name, 2, 9).try_cast("long")))
    for k, v in named.items():
        out = out.when(name == k, v)
    return out.otherwise(F.concat(F.lit("&"), name, F.lit(";")))


# print themes and fingerprints

#: Page margins where a theme gives none, and their bounds, in millimetres.
MARGINS, LEAST_MARGIN, MOST_MARGIN = {"top": 22.0, "right": 18.0, "bottom": 22.0, "left": 18.0}, 5.0, 60.0


def normal_theme(theme: Column) -> Column:
    """Page settings of a theme, a JSON object, as a struct: page_size, orientation, four margins, header and footer.

    A margin is the theme's own, else that of its default page (one to four numbers, as CSS has them), else a fixed one; it is rounded
    to a tenth and clamped. Header and footer end after 200 characters. What is no object gives the defaults.
    """
    at = lambda path: F.get_json_object(theme, path)
    spec = F.split(F.coalesce(at("$.defaults.page.size"), F.lit("")), r"\s+")
    given = F.transform(F.regexp_extract_all(F.coalesce(at("$.defaults.page.margin"), F.lit("")), F.lit(r"([\d.]+)")), lambda x: x.try_cast("double"))
    page = lambda *places: F.coalesce(*[F.get(given, F.lit(i)) for i in places])
    own = {"top": page(0), "right": page(3, 1), "bottom": page(2, 0), "left": page(3, 1)}
    letter = (at("$.pageSize") == "Letter") | (F.get(spec, F.lit(0)) == "Letter")
    landscape = (at("$.orientation") == "landscape") | (F.get(spec, F.lit(1)) == "landscape")

    def margin(side: str) -> Column:
        value = F.coalesce(at(f"$.margins.{side}").try_cast("double"), own[side], F.lit(MARGINS[side]))
        return F.greatest(F.lit(LEAST_MARGIN), F.least(F.lit(MOST_MARGIN), F.round(value, 1))).alias(side)

    return F.struct(
        F.when(F.coalesce(letter, F.lit(False)), "Letter").otherwise("A4").alias("page_size"), F.when(F.coalesce(landscape, F.lit(False)), "landscape").otherwise("portrait").alias("orientation"),
        *[margin(side) for side in MARGINS], F.coalesce(F.substring(at("$.header"), 1, 200), F.lit("")).alias("header"), F.coalesce(F.substring(at("$.footer"), 1, 200), F.lit("")).alias("footer"),
    )


def inline_first_script(html: Column, body: Column) -> Column:
    """The first script element with a body of its own instead of what it had or loaded; a page without one stays."""
    pattern = r"(?s)^(.*?)<script\b[^>]*>.*?</script>(.*)$"
    made = F.concat(F.regexp_extract(html, pattern, 1), F.lit("<script>\n"), body, F.lit("\n</script>"), F.regexp_extract(html, pattern, 2))
    return F.when(html.rlike(pattern), made).otherwise(html)


def little_endian(n: Column) -> Column:
    """A whole number as eight bytes, the least first."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))]))


def file_fingerprint(path: Column, length: Column, seconds: Column) -> Column:
    """Hash of a file's path, length and time of change."""
    return F.sha2(F.concat(path.cast("binary"), little_endian(F.coalesce(length, F.lit(0))), little_endian(F.coalesce(seconds, F.lit(0)))), 256)


def preview_hash(content: Column, theme: Column, css_version: str, engine: str) -> Column:
    """Hash of all that a page preview depends on."""
    return F.sha2(F.concat(content, F.coalesce(theme, F.lit("")), F.lit(css_version), F.lit(engine)), 256)


# JSON members


def json_pointer(value: Column, pointer: str) -> Column:
    """The member that a JSON pointer names, as text; null where there is none."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return F.get_json_object(value, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts))


def unknown_members(value: Column, known: tuple[str, ...]) -> Column:
    """Members of a JSON object that are not among the known ones, as an object; null if there is none."""
    rest = F.map_filter(F.from_json(value, "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def spread_members(value: Column, extra: Column) -> Column:
    """A JSON object with the members of another put back; its own go before them."""
    own, more = (F.coalesce(F.from_json(x, "map<string,variant>"), F.create_map().cast("map<string,variant>")) for x in (value, extra))
    return F.to_json(F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(own, k)), own))


def replace_all(text: Column, query: str, by: str) -> Column:
    """All matches of a literal replaced in one step; an empty query replaces nothing."""
    return F.replace(text, F.lit(query), F.lit(by)) if query else text


def layout_hash(fingerprint: Column, content_hash: Column, css_version: str, mode: str) -> Column:
    """Hash of what the layout of a publication depends on; a theme is part of the content's own hash or of none."""
    return F.sha2(F.concat(fingerprint, content_hash, F.lit(css_version), F.lit(mode)), 256)


def converter_name(fmt: Column) -> Column:
    """Name of the reader of a format; null for a format that is not read."""
    return F.when(fmt.isin("markdown", "html", "docx"), F.concat(F.lit("parchment-"), fmt))
