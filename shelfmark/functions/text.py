"""Text columns: Markdown, keywords, snippets, hashes, language guess, prompts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .lookup import lookup

ENTITY_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
BLANK = r"[ \t\r\f\x{A0}]"


def code_point(number: Column) -> Column:
    """One character from its code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Decode named and numeric character references in one pass over the pieces between ampersands."""

    def piece(part: Column, i: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        decimal = F.regexp_extract(ref, r"^#([0-9]+)$", 1)
        hexa = F.regexp_extract(ref, r"^#[xX]([0-9a-fA-F]+)$", 1)
        number = F.when(decimal != "", decimal.cast("bigint")).when(hexa != "", F.conv(hexa, 16, 10).cast("bigint"))
        decoded = F.when(number.isNull(), lookup(ref, ENTITY_NAMES)).when(number <= 0x10FFFF, code_point(number))
        rest = F.substr(part, F.length(ref) + F.lit(2))
        return F.when(i == 0, part).when(decoded.isNotNull(), F.concat(decoded, rest)).otherwise(
            F.concat(F.lit("&"), part))

    return F.when(
        text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), piece), "")
    ).otherwise(text)


def tidy_markdown(text: Column) -> Column:
    """At most one blank line in a row, lines trimmed, runs of spaces reduced to one."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, rf"{BLANK}*\n{BLANK}*", "\n")
    text = F.regexp_replace(text, r" {2,}", " ")
    return F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def html_to_markdown(html: Column) -> Column:
    """Headings, list items, paragraphs, breaks and table rows as Markdown; other tags dropped."""
    steps = [
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<h1[^>]*>([^\n]*?)</h1>", "# $1\n"),
        (r"(?i)<h2[^>]*>([^\n]*?)</h2>", "## $1\n"),
        (r"(?i)<h3[^>]*>([^\n]*?)</h3>", "### $1\n"),
        (r"(?is)<li[^>]*>(.*?)</li>", "- $1\n"),
        (r"(?is)<p[^>]*>(.*?)</p>", "$1\n\n"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<tr[^>]*>", "| "),
        (r"(?i)</tr>", " |\n"),
        (r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", "$1 | "),
        (r"<[^>]+>", ""),
    ]
    for pattern, replacement in steps:
        html = F.regexp_replace(html, pattern, replacement)
    return tidy_markdown(unescape(html))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_keywords(query: Column, limit: int = 6) -> Column:
    """Up to six query words longer than two characters that are not stopwords."""
    words = F.split(F.regexp_replace(F.lower(query), r"[?!]", ""), r"\s+")
    stop = F.array(*[F.lit(word) for word in V.QUERY_STOPWORDS])
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.slice(kept, 1, limit)


def snippet(text: Column, size: int) -> Column:
    """First ``size`` characters, marked with an ellipsis when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def smart_context(name: Column, text: Column) -> Column:
    """Name, start and middle of a text for encoding; at most 2000 characters."""
    middle = F.when(
        F.length(text) > 1600, F.substr(text, F.floor(F.length(text) / 2).cast("int") + F.lit(1), F.lit(800))
    ).otherwise(F.lit(""))
    joined = F.concat(F.lit("Filename: "), name, F.lit("\nContent: "), F.substring(text, 1, 800), F.lit(" ... "), middle)
    return F.substring(joined, 1, 2000)


def name_tags(filename: Column) -> Column:
    """Distinct lower-case words of a file name, longer than two characters."""
    words = F.transform(F.split(filename, r"[ \-_]+"), lambda w: F.lower(F.trim(w)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def url_extension(value: Column) -> Column:
    """Extension of a URL or path, ignoring query and fragment."""
    path = F.split_part(F.split_part(F.coalesce(value, F.lit("")), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.lower(F.regexp_extract(path, r"(?i)\.([a-z0-9]+)$", 1))


def guess_language(text: Column) -> Column:
    """German or English by the function words among the first hundred words."""
    words = F.slice(F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != ""), 1, 100)

    def hits(vocabulary: list[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary])))

    german, english = hits(V.GERMAN_WORDS), hits(V.ENGLISH_WORDS)
    return F.when(german > english, "de").when(english > german, "en").otherwise("unknown")


def render_prompt(template: str, name: Column, mime: Column, text: Column) -> Column:
    """Fill a printf-style prompt with name, type and at most 3000 characters of text."""
    body = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.substring(text, 1, V.MAX_PROMPT_CHARS)).otherwise(V.NO_TEXT)
    return F.format_string(template, name, F.coalesce(mime, F.lit("unknown")), body)


def normalise_person(name: Column) -> Column:
    """Name without title, lower case, single spaces."""
    plain = F.lower(F.regexp_replace(name, V.NAME_TITLES, ""))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def word_set(text: Column, shortest: int = 4) -> Column:
    """Distinct lower-case words of at least ``shortest`` characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{V.WORD}{{{shortest},}}"), F.lit(0)))


def follow_ups(excerpt: Column) -> Column:
    """Up to four follow-up questions, one template per capitalised topic word."""
    words = F.filter(
        F.split(excerpt, r"\s+"), lambda w: (F.length(w) > 5) & F.substring(w, 1, 1).rlike(r"^\p{Lu}$"))
    topics = F.slice(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""))), 1, 4)
    frames = F.array(*[F.lit(frame) for _, frame in V.FOLLOW_UP_TEMPLATES])
    return F.transform(topics, lambda t, i: F.replace(F.get(frames, i), F.lit("{}"), t))


def golden_check(answer: Column, markers: Column, match: str, shortest: Column) -> Column:
    """Answer long enough and holding any (or all) of the expected markers."""
    test = F.exists if match == "any" else F.forall
    held = test(markers, lambda m: F.lower(answer).contains(F.lower(m)))
    return held & (F.length(answer) >= shortest)


def number_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(V.NUMBER_PATTERN), F.lit(0)))
