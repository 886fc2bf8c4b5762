"""Text functions as Column expressions: tokens, links, tags, years, sentences, slugs, HTML. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stop word lists that decide which tokens count.
RETRIEVAL_STOP_WORDS = "the and for with that this from what which who how are was were into your about have has does say says where when why can could would".split()
CORE_STOP_WORDS = "the and for with that this from what which who how are was were into your about have has".split()

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_-]{1,}"
LINK = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
TAG = r"(^|\s)#([\p{L}\p{N}_/-]+)"
FRONTMATTER = r"^---\s*\n([\s\S]*?)\n---\s*(?:\n|$)"
YEAR = r"(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}(?![A-Za-z0-9_])"
#: JavaScript's white space, which Java's \s leaves out in part
SPACE = r"[\s   -     　﻿]"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column, stop_words: list[str] = RETRIEVAL_STOP_WORDS) -> Column:
    """Distinct lower-cased tokens of two characters and more, in order of appearance, without stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), _words(stop_words))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize(text: Column) -> Column:
    return F.lower(js_trim(text))


def normalize_spaces(text: Column) -> Column:
    return F.regexp_replace(normalize(text), f"{SPACE}+", " ")


def slug(text: Column) -> Column:
    """Letters and digits with hyphens between, 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(normalize_spaces(text), r"[^\p{L}\p{N}]+", "-"), r"^-|-$", ""), 1, 80)


def frontmatter(markdown: Column) -> Column:
    return F.regexp_extract(markdown, FRONTMATTER, 1)


def body(markdown: Column) -> Column:
    return F.regexp_replace(markdown, FRONTMATTER, "")


def scalar(raw: Column) -> Column:
    """A property value, tagged by kind: b, n, list or s; text holds it as a string, items the list's members."""
    value = js_trim(raw)
    bare = F.regexp_replace(value, "^['\"]|['\"]$", "")
    is_list = value.startswith("[") & value.endswith("]")
    inner = F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
    items = F.filter(F.transform(F.split(inner, ","), lambda v: F.regexp_replace(js_trim(v), "^['\"]|['\"]$", "")), lambda v: v != "")
    kind = F.when(value.rlike("(?i)^(true|false)$"), "b").when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "n").when(is_list, "list").otherwise("s")
    text = F.when(kind == "b", F.lower(value)).when(kind == "list", F.array_join(items, ", ")).when(kind == "n", value).otherwise(bare)
    return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind == "list", items).alias("items"))


def properties(markdown: Column) -> Column:
    """Front matter as an array of key and tagged value; of equal keys the last stands."""
    line = r"^([A-Za-z0-9_.-]+)\s*:\s*(.*)$"
    lines = F.filter(F.split(frontmatter(markdown), r"\r?\n"), lambda x: x.rlike(line))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("key"), scalar(F.regexp_extract(x, line, 2)).alias("value")))
    later = lambda p, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.filter(pairs, later)


def links(markdown: Column) -> Column:
    """Wiki links of the body: target, heading, alias (empty where absent)."""
    text = body(markdown)
    parts = [F.regexp_extract_all(text, F.lit(LINK), i) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("target", "heading", "alias"), strict=True)])
    return F.transform(zipped, lambda x: F.struct(js_trim(x["target"]).alias("target"), js_trim(x["heading"]).alias("heading"), js_trim(x["alias"]).alias("alias")))


def tags(markdown: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body(markdown), F.lit(TAG), 2))


def mentioned_years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(YEAR), 0), lambda y: y.cast("int"))))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, js_trim), lambda s: s != "")


def decode_entities(text: Column) -> Column:
    """Six entities, the ampersand before the angle brackets, so that a doubly escaped bracket is decoded twice."""
    for pattern, put in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'")):
        text = F.regexp_replace(text, pattern, put)
    return text


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<script\b[^>]*>[\s\S]*?</script>", " "), r"(?i)<style\b[^>]*>[\s\S]*?</style>", " ")


def strip_html(html: Column) -> Column:
    blocks = r"(?i)</?(?:p|div|section|article|main|aside|header|footer|li|tr|h[1-6]|br)\b[^>]*>"
    return decode_entities(F.regexp_replace(F.regexp_replace(without_scripts(html), blocks, "\n"), "<[^>]+>", " "))


def normalize_lines(text: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+\n", "\n"))


def excerpt(text: Column, terms: Column, limit: int = 280) -> Column:
    """A stretch of the text around the first term found, with an ellipsis where it is cut."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^---[\s\S]*?---\s*", ""), r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", "$2$1")
    found = F.filter(F.transform(terms, lambda t: F.instr(F.lower(plain), t)), lambda p: p > 0)
    pivot = F.coalesce(F.array_min(found), F.lit(1)) - 1
    start = F.greatest(F.lit(0), pivot - limit // 3)
    cut = F.regexp_replace(js_trim(F.substr(plain, start + 1, F.lit(limit))), r"\s+", " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + limit < F.length(plain), "…").otherwise(""))


def rename_links(markdown: Column, old: Column, new: Column) -> Column:
    """Links to the title old, in any case, lead to new; headings and aliases stay."""
    parts = F.split(markdown, r"\[\[")
    wanted = F.lower(js_trim(old))

    def one(p: Column, i: Column) -> Column:
        head = F.substr(p, F.lit(1), F.length(js_trim(old)))
        follows = F.substr(p, F.length(js_trim(old)) + 1)
        hit = (i > 0) & (F.lower(head) == wanted) & follows.rlike(r"^(#|\||\]\])")
        return F.when(hit, F.concat(new, follows)).otherwise(p)

    return F.when((js_trim(old) == "") | (old == new), markdown).otherwise(F.array_join(F.transform(parts, one), "[["))


def expand_template(template: Column, variables: dict[str, Column]) -> Column:
    """{{key}} replaced where the key is known."""
    for k, v in variables.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v)
    return template


def detect_format(name: Column, mime: Column) -> Column:
    """The import format by extension, else by MIME type; null if unknown."""
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    return (
        F.when((ext == "md") | (mime == "text/markdown"), "markdown")
        .when((ext == "txt") | (mime == "text/plain"), "text")
        .when((ext == "csv") | mime.contains("csv"), "csv")
        .when(ext.isin("html", "htm") | mime.contains("html"), "html")
        .when((ext == "pdf") | (mime == "application/pdf"), "pdf")
        .when((ext == "docx") | mime.contains("wordprocessingml"), "docx")
    )


def temporal_constraint(question: Column) -> Column:
    """struct(from_year, to_year, reason) of the first time phrase by kind, else null. ``after`` includes its year."""
    q, y = F.lower(question), "((?:19|20)[0-9]{2})"
    b, e = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"
    pick = lambda p, i: F.regexp_extract(q, p, i)
    num = lambda p, i: F.nullif(pick(p, i), F.lit("")).cast("int")
    none = F.lit(None).cast("int")
    struct = lambda f, t, p: F.struct(f.alias("from_year"), t.alias("to_year"), pick(p, 0).alias("reason"))
    between = rf"{b}between\s+{y}\s+(?:and|to)\s+{y}{e}"
    span = rf"{b}from\s+{y}\s+(?:to|through|until)\s+{y}{e}"
    before, after, during = rf"{b}before\s+{y}{e}", rf"{b}(?:after|since)\s+{y}{e}", rf"{b}(?:in|during)\s+{y}{e}"
    out = F.when(q.rlike(between), struct(F.least(num(between, 1), num(between, 2)), F.greatest(num(between, 1), num(between, 2)), between))
    out = out.when(q.rlike(span), struct(F.least(num(span, 1), num(span, 2)), F.greatest(num(span, 1), num(span, 2)), span))
    out = out.when(q.rlike(before), struct(none, num(before, 1) - 1, before))
    out = out.when(q.rlike(after), struct(num(after, 1), none, after))
    return out.when(q.rlike(during), struct(num(during, 1), num(during, 1), during))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
