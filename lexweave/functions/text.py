"""Text functions as column expressions; only what calls back into code for a match is a pandas UDF."""

from __future__ import annotations

import bisect
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _fold_table() -> tuple[str, str]:
    """Characters of the Basic Multilingual Plane that are a letter with marks, or one form of a letter, and the bare letters for them; then the
    marks, which have none and so go. By rule from Unicode's own decompositions."""
    bare, marks = {"ς": "σ"}, []
    for c in map(chr, range(0x80, 0xD800)):
        if unicodedata.combining(c):
            marks.append(c)
        elif c == c.lower():
            left = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(left) == 1 and left != c:
                bare[c] = left
    return "".join(bare) + "".join(marks), "".join(bare.values())


#: The one table by which texts and queries are folded.
FOLD_FROM, FOLD_TO = _fold_table()
_FOLD = {ord(c): FOLD_TO[i] if i < len(FOLD_TO) else None for i, c in enumerate(FOLD_FROM)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between tokens: all but letters and numbers.
BETWEEN = r"[^\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case without marks, whether a letter carries them or they stand after it."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def folded_text(text: str) -> str:
    """The same of a query that is at hand."""
    return text.lower().translate(_FOLD)


def tokens(text: Column) -> Column:
    """Splitting takes time in proportion to the text; extracting each match takes the square of it."""
    return F.array_remove(F.split(folded(text), BETWEEN), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def trimmed(text: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def number_or_null(text: Column) -> Column:
    """The number that a text holds; null for none, for the empty text and for 0."""
    return F.nullif(trimmed(text).try_cast("double"), F.lit(0.0)).try_cast("int")


def without_braces(text: Column) -> Column:
    """Drops ``{a: b}`` with the space before it, keeps the words of ``{was}``, from the innermost outwards until nothing changes: each
    round that changes anything takes a brace away, so there are as many rounds as opening braces."""

    def once(t: Column) -> Column:
        t = F.regexp_replace(t, r"\s*\{([^{]*:[^{]*)\}", "")
        return F.regexp_replace(t, r"\s*\{([^{:]*)\}", " $1")

    rounds = F.sequence(F.lit(0), F.regexp_count(text, F.lit(r"\{")))
    out = F.aggregate(rounds, text, lambda t, _: once(t))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[{}]", ""), r"\s+", " "))


def _ranges_of(chars: str) -> str:
    """The characters as ranges for a class of a pattern."""
    codes = sorted(map(ord, chars))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: A token as it is written: letters, numbers, and marks that folding drops. What may stand between a sentence's end and the next one's start.
_WRITTEN = re.compile(rf"(?:[^\W_]|[{_ranges_of(FOLD_FROM[len(FOLD_TO):])}])+")
_SENTENCE = re.compile(r"[.:!?][\s\"'”’)\]]*$")


def fragment(tokens_: list[str], starts: set[int], phrases: list[list[str]], width: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the best ``width`` tokens of a text start, and all places [first, end) of the phrases in it.

    Best is what has the most unlike phrases whole, then the most places, where starting with a sentence (``starts``) counts more than places but less
    than a phrase; then what comes first. The first place and the sentence before it are as good a start as any before them, so only these are tried.
    """
    at = {p[0]: [q for q in phrases if q[0] == p[0]] for p in phrases}
    found = [(i, i + len(p), k) for i, t in enumerate(tokens_) for k, p in enumerate(at.get(t, ())) if tokens_[i : i + len(p)] == p]
    found = sorted((i, e, phrases.index(at[tokens_[i]][k])) for i, e, k in found)
    firsts, best = sorted(starts), (-1, 0)
    for j, (i, _, _) in enumerate(found):
        before = bisect.bisect_right(firsts, i)
        for s in {i, *firsts[max(before - 1, 0) : before]}:
            lo = bisect.bisect_left(found, (s,))
            here = [k for a, e, k in found[lo : lo + width * len(phrases)] if a < s + width and e <= s + width]
            score = 1000 * len(set(here)) + len(here) + (100 if s in starts else 0)
            if (score, -s) > (best[0], -best[1]):
                best = score, s
    s = best[1] if len(tokens_) > width else 0
    here = [(a, e) for a, e, _ in found if s <= a and e <= s + width]
    if here and s not in starts:  # centred about its places
        room = width - (max(e for _, e in here) - s)
        s = max(min(s - room // 2, len(tokens_) - width), 0)
    return s, [(a, e) for a, e, _ in found]


def snippet_of(text: str | None, phrases: list[list[str]], width: int = 16) -> str | None:
    """The part of a text that :func:`fragment` chooses, with whole phrases marked and an ellipsis where the text goes on. Without a place: its start."""
    if text is None:
        return None
    words = [(t, m.start(), m.end()) for m in _WRITTEN.finditer(text) if (t := folded_text(m[0]))]
    if not words:
        return text
    tokens_ = [t for t, _, _ in words]
    starts = {i for i, (_, a, _) in enumerate(words) if not i or _SENTENCE.search(text[words[i - 1][2] : a])}
    s, found = fragment(tokens_, starts, phrases, width)
    end = min(s + width, len(words))
    marks: list[list[int]] = []
    for a, e in sorted((a, e) for a, e in found if s <= a and e <= end):
        if marks and a < marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], e)
        else:
            marks.append([a, e])
    out, at = "", words[s][1] if s else 0
    for a, e in marks:
        out += f"{text[at : words[a][1]]}<mark>{text[words[a][1] : words[e - 1][2]]}</mark>"
        at = words[e - 1][2]
    return ("…" if s else "") + out + (text[at:] if end == len(words) else text[at : words[end - 1][2]] + "…")


def snippet(text: Column, phrases: list[list[str]], width: int = 16) -> Column:
    """:func:`snippet_of` of each text, by batches: for rows that are capped already. Null stays null."""

    @F.pandas_udf(StringType())
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: snippet_of(x, phrases, width))

    return shown(text)


def escaped_but_marks(text: Column) -> Column:
    """Escaped for HTML, with ``<mark>`` let in again."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def _first_line(content: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(content, "\n"), lambda x: trimmed(x) != ""), 0), F.lit(""))


# What stands where a note has no text, title or anchor.
EMPTY_NOTE, UNTITLED, FREE = "(empty note)", "Untitled note", "Freeform"


def preview(title: Column, content: Column) -> Column:
    """The title, else the first line with anything in it, without its Markdown marks, 60 characters of it; else ``(empty note)``."""
    line = F.regexp_replace(F.regexp_replace(_first_line(content), r"[#>*_`~]", ""), r"^\s*[-+]\s+", "")
    shown = F.substring(trimmed(line), 1, 60)
    return F.when(F.coalesce(title, F.lit("")) != "", title).when(shown != "", shown).otherwise(EMPTY_NOTE)


def menu_label(title: Column, content: Column, book: Column, chapter: Column, verse: Column) -> Column:
    """The title, else the place, else the start of the first line."""
    line = F.substring(trimmed(F.regexp_replace(_first_line(content), r"[#>*_`]", "")), 1, 40)
    place = F.when(book.isNotNull(), place_of(book, chapter, verse))
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.coalesce(place, F.when(line != "", line), F.lit(UNTITLED)))


def place_of(book: Column, chapter: Column, verse: Column) -> Column:
    """``Book 3:16``, ``Book 3`` or ``Book``, by what is there."""
    at = F.concat(book, F.lit(" "), chapter.cast("string"))
    return F.when(verse.isNotNull(), F.concat(at, F.lit(":"), verse.cast("string"))).when(chapter.isNotNull(), at).otherwise(book)


def hit_ref(book: Column, chapter: Column, verse: Column, position_ref: Column) -> Column:
    """Where a hit stands: its place down to the chapter, else its label, else its book."""
    full = F.when(book.isNotNull() & (verse.isNotNull() | chapter.isNotNull()), place_of(book, chapter, verse))
    return F.coalesce(full, position_ref, book, F.lit(""))


def lemma_numbers(lemma: Column) -> Column:
    """``strong:H0430 ...`` to ``[H430]``; order and repeats stay."""
    parts = F.filter(F.split(lemma, r"(?U)\s+"), lambda x: x.rlike(r"(?i)^strong:[HG]0*\d+$"))
    return F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 8, 1)), F.regexp_replace(F.regexp_extract(x, r"(\d+)$", 1), r"^0+(?=\d)", "")))


# Fixed value: a letter and a number that is not 0.
NUMBER_QUERY = r"^([HGhg])0*([1-9]\d*)$"


def number_query(term: Column) -> Column:
    """``h02`` to ``H2``; null for what is no number query."""
    part = lambda i: F.regexp_extract(trimmed(term), NUMBER_QUERY, i)
    return F.when(part(1) != "", F.concat(F.upper(part(1)), part(2)))


def anchor_label(book: Column, chapter: Column, verse: Column) -> Column:
    """What a note is anchored to; says so where it is a whole chapter or book, or nothing."""
    place = place_of(book, chapter, verse)
    whole = F.when(verse.isNotNull(), "").when(chapter.isNotNull(), " (chapter)").otherwise(" (book)")
    return F.when(book.isNull(), F.lit(FREE)).otherwise(F.concat(place, whole))


def aligned(text: Column, surfaces: Column) -> Column:
    """1-based starts of the surfaces that are found in reading order, 0 for those that are not."""
    low = F.lower(text)

    sub = lambda a: F.substr(low, a["at"], F.greatest(F.length(low) - a["at"] + 1, F.lit(0)))

    def put(a: Column, s: Column) -> Column:
        near = F.when(F.length(s) > 0, F.instr(sub(a), F.lower(s))).otherwise(0)
        at = F.when(near > 0, near + a["at"] - 1).otherwise(0)
        return F.struct(F.when(at > 0, at + F.length(s)).otherwise(a["at"]).alias("at"), F.concat(a["starts"], F.array(at)).alias("starts"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(surfaces, start, put, lambda a: a["starts"])


def segments(text: Column, surfaces: Column) -> Column:
    """The text cut at the surfaces that are found in reading order: array of struct<text, slot>, slot null for what stands between. Surfaces that are
    not found are left out and move nothing; put together, the pieces are the text."""
    low = F.lower(text)
    piece = lambda first, end, slot: F.filter(F.array(F.struct(F.substr(text, first, F.greatest(end - first, F.lit(0))).alias("text"), slot.cast("int").alias("slot"))), lambda x: x["text"] != "")

    def put(a: Column, s: Column) -> Column:
        rest = F.substr(low, a["at"], F.greatest(F.length(low) - a["at"] + 1, F.lit(0)))
        near = F.when(F.length(s["x"]) > 0, F.instr(rest, F.lower(s["x"]))).otherwise(0)
        at, end = near + a["at"] - 1, near + a["at"] - 1 + F.length(s["x"])
        found = F.struct(end.alias("at"), F.concat(a["parts"], piece(a["at"], at, F.lit(None)), piece(at, end, s["i"])).alias("parts"))
        return F.when(near > 0, found).otherwise(a)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,slot:int>>").alias("parts"))
    slots = F.transform(surfaces, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(slots, start, put, lambda a: F.concat(a["parts"], piece(a["at"], F.length(text) + 1, F.lit(None))))


def _at_each(text: Column, pattern: str, put) -> Column:
    """``put`` of each piece that starts with a match of ``pattern``; what stands before the first stays."""
    pieces = F.split(text, f"(?={pattern})")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^(?:{pattern})"), put(x)).otherwise(x)), "")


#: Numbers from 0xD800 to 0xDBFF, as they are or less 65536.
_HIGH = r"(?:5529[6-9]|55[3-9]\d\d|56[0-2]\d\d|563[01]\d|-10240|-102[0-3]\d|-10[01]\d\d|-9[3-9]\d\d|-92[2-9]\d|-921[7-9])"


def strip_rtf(raw: Column) -> Column:
    """The plain text of RTF; a text without a backslash is only trimmed, its braces stay. Null is empty."""
    text = F.coalesce(raw, F.lit(""))
    out = F.regexp_replace(text, r"\\(?:pard?|line)\b", "\n")
    out = _at_each(out, r"\\'[0-9a-fA-F]{2}", lambda x: F.concat(F.decode(F.unhex(F.concat(F.lit("00"), F.substring(x, 3, 2))), "UTF-16BE"), F.substring(x, 5, 1 << 30)))
    unit = lambda x, i: F.pmod(F.regexp_extract(x, r"^\\u(-?\d+)\??(?:\\u(-?\d+)\??)?", i).try_cast("long"), F.lit(65536))
    hexed = lambda x, i: F.lpad(F.hex(unit(x, i)), 4, "0")
    # Two units of one character, then all others; half of such a pair alone stands for no character.
    pair = lambda x: F.when(unit(x, 2).between(0xDC00, 0xDFFF), F.concat(F.decode(F.unhex(F.concat(hexed(x, 1), hexed(x, 2))), "UTF-16BE"), F.regexp_replace(x, r"^(?:\\u-?\d+\??){2}", ""))).otherwise(x)
    out = _at_each(out, rf"\\u{_HIGH}(?!\d)\??\\u-?\d+", pair)
    letter = lambda x: F.when(unit(x, 1).between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(hexed(x, 1)), "UTF-16BE"))
    out = _at_each(out, r"\\u-?\d+", lambda x: F.concat(letter(x), F.regexp_replace(x, r"^\\u-?\d+\??", "")))
    out = F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+-?\d*\s?", ""), r"[{}]", "")
    return F.when(~F.contains(text, F.lit("\\")), trimmed(text)).otherwise(trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n")))


class _Markdown(HTMLParser):
    """The tree of a page from its leaves up: an element that ends becomes one string in the element around it."""

    # How elements are written in Markdown.
    HEADS = {"h1": "#", "h2": "##", "h3": "###", "h4": "####", "h5": "####", "h6": "####"}
    AROUND = {"strong": "**", "b": "**", "em": "*", "i": "*"}
    ALONE = {"br": "\n", "hr": "\n---\n\n"}
    VOID = set("area base col embed img input link meta source track wbr".split())
    ENDED_BY = {"p": {"p", "ul", "ol", "blockquote", "pre", "hr", "div", "h1", "h2", "h3", "h4", "h5", "h6"}, "li": {"li"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None, list[str]]] = [("", None, [])]

    def written(self, tag: str, href: str | None, inner: str) -> str:
        bare = inner.strip()
        if tag in self.HEADS:
            return f"\n{self.HEADS[tag]} {bare}\n\n"
        if tag in self.AROUND:
            return f"{self.AROUND[tag]}{bare}{self.AROUND[tag]}" if bare else ""
        if tag == "p":
            return f"{bare}\n\n"
        if tag == "a":
            return f"[{bare}]({href})" if href else inner
        if tag == "li":
            return f"{'1.' if self.open[-1][0] == 'ol' else '-'} {bare}\n"
        if tag in ("ul", "ol"):
            return f"{inner}\n"
        if tag == "blockquote":
            return "\n".join(f"> {x}" for x in bare.split("\n")) + "\n\n"
        if tag == "code":
            return f"`{inner}`"
        if tag == "pre":
            return f"\n```\n{bare}\n```\n\n"
        return "" if tag == "head" else inner

    def ended(self) -> None:
        tag, href, parts = self.open.pop()
        self.open[-1][2].append(self.written(tag, href, "".join(parts)))

    def handle_starttag(self, tag, attrs):
        if tag in self.ALONE:
            self.open[-1][2].append(self.ALONE[tag])
        elif tag not in self.VOID:
            if tag in self.ENDED_BY.get(self.open[-1][0], ()):
                self.ended()
            self.open.append((tag, dict(attrs).get("href"), []))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open[1:]):
            while self.open[-1][0] != tag:
                self.ended()
            self.ended()

    def handle_data(self, data):
        self.open[-1][2].append(re.sub(r"\s+", " ", data))

    def result(self) -> str:
        self.close()
        while len(self.open) > 1:
            self.ended()
        return re.sub(r"\n{3,}", "\n\n", "".join(self.open[0][2])).strip()


def html_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    return parser.result()


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(html_markdown)


#: Characters for the bytes 0x80 to 0x9F in Windows-1252, which ISO-8859-1 has as controls.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def from_windows(raw: Column) -> Column:
    """Bytes as Windows-1252."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _CONTROLS, _WINDOWS)


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8, without its mark, else as Windows-1252. Null stays null."""
    raw = F.col(content) if isinstance(content, str) else content
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(from_windows(raw))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))
