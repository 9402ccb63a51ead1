"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a token, a special character, a code and a keyword
TOKEN = r"[\x{4e00}-\x{9fa5}]+|[A-Za-z0-9._-]+"
SPECIAL = r"[A-Z0-9._\-#()《》]"
CODE = r"^[A-Za-z0-9._\-+#]+$"
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"
MDLINK = r"\[([^\]]*)\]\(([^)]+)\)"


def normalize_text(text: Column) -> Column:
    """White space of any kind becomes single blanks, none at the ends; null becomes empty."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, "^ | $", "")


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def timestamp(text: Column) -> Column:
    """ISO 8601 as a timestamp; null for what isn't one."""
    return F.try_to_timestamp(text)


def tokenize(text: Column) -> Column:
    """Lower-case tokens of two characters or more, in order, repeats included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower)


_TOKEN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), TOKEN))


def token_list(text: str | None) -> list[str]:
    """The same for code that runs in Arrow batches; tokens are ASCII or CJK, so one pass lowers them all."""
    return " ".join(t for t in _TOKEN.findall(text or "") if len(t) > 1).lower().split()


def keywords(text: Column) -> Column:
    """CJK runs of two characters or more, then Latin words in lower case."""
    cjk = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fa5}]{2,}"), F.lit(0))
    latin = F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))
    return F.concat(cjk, F.transform(latin, F.lower))


def _bound(value: Column, body) -> Column:
    """``body(value)``, the value taken once and not again for every element that a lambda in it visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _until_last(text: Column, closer: str, rewrite) -> Column:
    """``rewrite`` applied up to the last ``closer`` (a pattern), the rest as it is: nothing that opens there is closed, and none of it is gone over."""

    def run(t: Column) -> Column:
        head = F.regexp_extract(t, f"(?s)^(.*{closer})", 1)
        return _bound(head, lambda h: F.concat(rewrite(h), F.substring(t, F.char_length(h) + 1, F.char_length(t))))

    return _bound(text, run)


def token_entropy(tokens: Column) -> Column:
    """Entropy of the token distribution relative to its maximum, from 0 to 1; one sort, so for texts of any length."""
    n = F.size(tokens)

    def spread(s: Column) -> Column:  # ascending
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        count = lambda b, at, j: F.coalesce(F.get(b, j + 1), F.size(s)) - at
        shares = _bound(starts, lambda b: F.transform(b, lambda at, j: count(b, at, j) / F.size(s)))
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log(p + 1e-9))

    total = _bound(F.array_sort(tokens), spread)
    return F.when(n > 1, F.least(F.lit(1.0), total / F.log(F.greatest(F.lit(2), n)))).otherwise(F.lit(0.0))


def query_complexity(text: Column) -> Column:
    """``struct(entropy, specificity, length_factor)`` of a query, each from 0 to 1."""
    clean = normalize_text(text)
    tokens = tokenize(clean)
    specific = F.regexp_count(clean, F.lit(SPECIAL)) / F.greatest(F.lit(1), F.length(clean)) * 5
    return F.struct(
        F.round(token_entropy(tokens), 4).alias("entropy"),
        F.round(F.least(F.lit(1.0), specific), 4).alias("specificity"),
        F.round(F.least(F.lit(1.0), F.size(tokens) / 12.0), 4).alias("length_factor"),
    )


def adaptive_weights(text: Column) -> Column:
    """``struct(dense, sparse, colbert)``: fusion weights by the kind of query."""
    clean = normalize_text(text)
    c = query_complexity(text)
    weights = lambda d, s, k: F.struct(F.lit(d).alias("dense"), F.lit(s).alias("sparse"), F.lit(k).alias("colbert"))
    return (
        F.when(clean == "", weights(0.45, 0.35, 0.20))
        .when(clean.rlike(CODE) | (F.size(tokenize(clean)) <= 2), weights(0.20, 0.55, 0.25))
        .when((c["specificity"] > 0.4) & (c["length_factor"] < 0.4), weights(0.30, 0.45, 0.25))
        .when(c["length_factor"] > 0.6, weights(0.55, 0.20, 0.25))
        .otherwise(weights(0.40, 0.35, 0.25))
    )


def lexicon(tokens: Column) -> Column:
    """Map of token to its share of all tokens, in order of first places; one sort, so for texts of any length."""

    def shares(s: Column) -> Column:  # ascending by token and place
        placed = F.transform(s, lambda x, i: F.struct(x["token"].alias("token"), x["first"].alias("first"), i.alias("at")))
        starts = F.filter(placed, lambda x, i: (i == 0) | (x["token"] != F.get(s, i - 1)["token"]))
        n = lambda b, x, j: F.coalesce(F.get(b, j + 1)["at"], F.size(s)) - x["at"]
        counts = _bound(starts, lambda b: F.transform(b, lambda x, j: F.struct(x["first"].alias("first"), x["token"].alias("token"), n(b, x, j).alias("n"))))
        return F.transform(F.array_sort(counts), lambda x: F.struct(x["token"].alias("key"), F.round(x["n"] / F.size(s), 6).alias("value")))

    ordered = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("first"))))
    return F.map_from_entries(_bound(ordered, shares))


def multi_vector_tokens(tokens: Column) -> Column:
    """Tokens as ``array<struct<token>>``, repeats kept."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token")))


def hybrid_metadata(text: Column) -> Column:
    """``struct(sparse_lexicon, colbert_tokens)``, both as JSON strings."""
    tokens = tokenize(text)
    return F.struct(F.to_json(lexicon(tokens)).alias("sparse_lexicon"), F.to_json(multi_vector_tokens(tokens)).alias("colbert_tokens"))


def short_hash(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def row_id(prefix: str, key: Column, index: Column) -> Column:
    """``prefix_hash_index``: an id that follows from what a row is made of."""
    return F.concat_ws("_", F.lit(prefix), short_hash(key, 8), index.cast("string"))


def preview(text: Column, width: int = 70) -> Column:
    """The first characters of the normalised text, with an ellipsis if it goes on."""
    clean = normalize_text(text)
    return F.when(F.length(clean) > width, F.concat(F.substring(clean, 1, width), F.lit("…"))).otherwise(clean)


def snippet(text: Column, query: Column, before: int = 100, after: int = 200, width: int = 200) -> Column:
    """The surroundings of the first keyword of the query, else the beginning of the text."""

    def first(low: Column) -> Column:  # every keyword is looked for only before the first hit so far
        earlier = lambda at, k: F.nullif(F.instr(F.substring(low, F.lit(1), at + F.length(k) - 2), k), F.lit(0))
        return F.aggregate(F.array_distinct(keywords(query)), F.length(low) + 1, lambda at, k: F.coalesce(earlier(at, k), at))

    hit = _bound(F.lower(text), first)
    at = F.when(hit <= F.length(F.lower(text)), hit)
    start = F.greatest(F.lit(1), at - before)
    around = normalize_text(F.substring(text, start, at + after - start))
    return F.when(at.isNotNull(), around).otherwise(F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit(" ")))


def concept_id(name: Column) -> Column:
    return F.lower(normalize_text(name))


def wikilinks(text: Column) -> Column:
    """``[[target]]`` links as ``struct(concept_id, display)``; targets with a leading dot are left out."""
    whole = F.filter(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(0)), lambda m: ~m.startswith("[[."))
    target = lambda m: F.regexp_extract(m, WIKILINK, 1)
    shown = lambda m: F.element_at(F.split(F.regexp_replace(m, r"^\[\[|\]\]$", ""), r"\|"), -1)
    return F.transform(whole, lambda m: F.struct(concept_id(target(m)).alias("concept_id"), normalize_text(shown(m)).alias("display")))


def mdlinks(text: Column) -> Column:
    """``[label](target)`` links to local targets as ``struct(concept_id, display)``; an empty label shows the target."""
    whole = F.regexp_extract_all(text, F.lit(MDLINK), F.lit(0))
    target = _group(2)
    label = _group(1)
    local = F.filter(whole, lambda m: ~target(m).rlike(r"^(http|#|\.)"))
    named = lambda m: F.when(label(m) != "", label(m)).otherwise(target(m))
    return F.transform(local, lambda m: F.struct(concept_id(named(m)).alias("concept_id"), normalize_text(named(m)).alias("display")))


def _group(n: int):
    def pick(m: Column) -> Column:
        return F.regexp_extract(m, MDLINK, n)

    return pick


def links(text: Column) -> Column:
    """All links of a text, wiki links first."""
    return F.concat(wikilinks(text), mdlinks(text))


def convert_wikilinks(text: Column) -> Column:
    """Wiki links as readable text: the alias, else ``page > heading``, else the page."""

    def readable(t: Column) -> Column:
        t = F.regexp_replace(t, r"\[\[([^\]|]*+)\|([^\]|]*+)(?:\|[^\]]*+)?\]\]", "$2")
        t = F.regexp_replace(t, r"\[\[([^\]#]*+)#([^\]#]*+)(?:#[^\]]*+)?\]\]", "$1 > $2")
        return F.regexp_replace(t, r"\[\[([^\]]++)\]\]", "$1")

    return _until_last(text, r"\]\]", readable)


# fixed values: the rewriting rules of Markdown to plain text, in the order in which they apply
_MARKDOWN = (
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"<[^>]+>", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^[-*+]\s+", "• "),
    (r"\n{3,}", "\n\n"),
    (r"(?U)^\s+|\s+$", ""),
)


def clean_markdown(text: Column) -> Column:
    """Markdown as plain text: links, images, tags, headings, emphasis, code and bullets."""
    text = convert_wikilinks(text)
    for pattern, by in _MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip_html(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    scripts = lambda x: F.regexp_replace(x, r"(?is)<(script|style)[^>]*+>.*?</(script|style)>", " ")
    plain = _until_last(html, r"(?i)</(?:script|style)>", scripts)
    return normalize_text(_until_last(plain, ">", lambda x: F.regexp_replace(x, r"<[^>]++>", " ")))


def note_text(text: Column) -> Column:
    """A note without embeds and with its wiki links as text."""
    text = F.regexp_replace(text, r"!\[\[[^\[\]]+\]\]", "")
    text = F.regexp_replace(text, r"\[\[([^\[\]|]+)\|([^\[\]]+)\]\]", "$2")
    return F.regexp_replace(text, r"\[\[([^\[\]|]+)\]\]", "$1")


def note_links(text: Column) -> Column:
    """Distinct link targets of a note in order, embeds left out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\[\]|]+)(?:\|[^\[\]]+)?\]\]"), F.lit(1)), F.trim))


FRONT_MATTER = r"\A---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter(text: Column) -> Column:
    """``key: value`` lines of a note's front matter as a map; quotes go, lists and empty values stay out."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), FRONT_MATTER, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^\s:#-][^:]*:\s*\S"))
    key = lambda x: F.trim(F.regexp_extract(x, "^([^:]+):", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)), "^['\"]|['\"]$", "")
    pairs = F.transform(lines, lambda x, i: F.struct(key(x).alias("key"), (-i).alias("at"), value(x).alias("value")))
    return F.map_from_entries(_bound(F.array_sort(pairs), _first_of_key))  # the last line of a key holds


def _first_of_key(ordered: Column) -> Column:
    """Entries of a map from ``struct(key, at, value)`` in order: the first of each key; one pass."""
    first = F.filter(ordered, lambda p, i: (i == 0) | (p["key"] != F.get(ordered, i - 1)["key"]))
    return F.transform(first, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))


def front_matter_lists(text: Column) -> Column:
    """A note's front matter as a map of lists: block lists, ``[a, b]`` lists, and single values as lists of one; the first of a key holds."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), FRONT_MATTER, 1)
    blocks = F.filter(F.split(head, r"\r?\n(?=[^\s:#-][^:\r\n]*:)"), lambda b: b.rlike(r"^[^\s:#-][^:\r\n]*:"))
    bare = lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")

    def items(block: Column) -> Column:
        inline = F.trim(F.regexp_extract(block, r"^[^:]+:[ \t]*([^\r\n]*)", 1))
        listed = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+([^\r\n]*)"), F.lit(1))
        found = F.when(inline.startswith("["), F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")).when(inline != "", F.array(inline)).otherwise(listed)
        return F.filter(F.transform(found, bare), lambda x: x != "")

    pairs = F.transform(blocks, lambda b, i: F.struct(F.trim(F.regexp_extract(b, "^([^:]+):", 1)).alias("key"), i.alias("at"), items(b).alias("value")))
    return F.map_from_entries(_bound(F.array_sort(pairs), _first_of_key))


def tags(text: Column) -> Column:
    """Front-matter tags, from a list, an inline list or a comma string (ASCII or full width)."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), FRONT_MATTER, 1)
    inline = F.regexp_replace(F.regexp_extract(head, r"(?m)^tags:[ \t]*(.*)$", 1), r"[\[\]]", "")
    block = F.regexp_extract(head, r"(?m)^tags:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|\z))+)", 1)
    items = F.when(F.trim(inline) != "", F.split(inline, "[,，]")).otherwise(F.transform(F.split(block, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*- ", "")))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.filter(clean, lambda x: x != "")


def body(text: Column) -> Column:
    """A note without its front matter."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), FRONT_MATTER, "")


def title(text: Column, fallback: Column) -> Column:
    """The first top-level heading, else the fallback."""
    found = F.regexp_extract(text, r"(?m)^#\s+(.*?)\s*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def cross_references(raw_links: Column, most: int = 10) -> Column:
    """A line that names the first links of a document, empty without links."""
    return F.when(F.size(raw_links) > 0, F.concat(F.lit("\n[交叉引用: "), F.array_join(F.slice(raw_links, 1, most), ", "), F.lit("]"))).otherwise(F.lit(""))
