"""Text functions of the engine as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import MARKERS

# Texts that are no recovery.
PLACEHOLDERS = ("unspecified", "recipient name", "sender name", "name redacted", "n/a", "unknown", "withheld")
LABELS = (
    "item", "description", "field", "value", "date", "details", "name", "notes", "type", "status", "number",
    "e-ticket number", "category", "[blank]", "[blank]\n-", "blank", "(usanys)",
)
DESCRIPTIONS = (
    "blacked out", "blackened out", "blackened box", "blanked out", "blocked out", "covered", "obscured", "whited out",
    "crossed out",
)
IMAGE_PREFIXES = ("the image ", "this image ", "this page ", "this is an image", "this appears to be")
HEADERS = ("From", "To", "Date", "Subject")
# Signs of layout that anchors are compared without, in order, and what stands for them.
LAYOUT = (
    (r"\|[-—–]+\|", " "), ("[-—–]{3,}", " "), (r"\|", " "), (r"(?m)^#{1,6}\s+", ""), (r"\*\*", ""), ("__", ""), (r"\*", ""),
    (r"(?m)^\s*[-•*]\s+", ""),
)


def lit_replace(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by))


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_markers(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    return reduce(lambda t, m: lit_replace(t, m, " "), markers, text)


def clean_text(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """For fingerprints: no markers, lower case, single blanks."""
    return collapse(F.lower(without_markers(text, markers)))


def strip_markers(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """For verification: no markers or runs of full blocks, single blanks."""
    return collapse(F.regexp_replace(without_markers(text, markers), "█+", " "))


def looks_like_email(text: Column) -> Column:
    return text.ilike("%From:%") | text.ilike("%To:%")


def like_literal(text: str) -> str:
    """The text with the signs that LIKE reads escaped."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def has_marker(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Whether any marker occurs, whatever its case."""
    return reduce(lambda a, b: a | b, [text.ilike(f"%{like_literal(m)}%") for m in markers])


def complementary(a: Column, b: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Whether some marker occurs in exactly one of the texts."""
    return reduce(lambda x, y: x | y, [a.contains(m) != b.contains(m) for m in markers])


def marker_count(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Occurrences of all markers, each counted by itself."""
    text = F.coalesce(text, F.lit(""))
    each = [((F.length(text) - F.length(lit_replace(text, m, ""))) / len(m)).cast("long") for m in markers]
    return reduce(lambda a, b: a + b, each)


def running_sums(values: Column) -> Column:
    """Sums of an array's values up to each of them: in each step of the fold, sums over twice as many are made of two."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int") - 1, F.lit(0)))
    add = lambda sums, far: F.transform(sums, lambda x, i: F.when(i >= far, x + F.get(sums, i - far)).otherwise(x))
    return F.aggregate(steps, values, lambda sums, j: add(sums, F.call_function("shiftleft", F.lit(1), j)))


def marker_positions(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Array of (pos, marker), from 0, in order of place; markers may overlap each other.

    The pieces before a marker's occurrences give their places as running sums.
    """

    def of(m: str) -> Column:
        pieces = F.split(text, F.lit(r"\Q" + m + r"\E"), -1)
        before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p).cast("long") + len(m))
        found = F.transform(running_sums(before), lambda end: F.struct((end - len(m)).alias("pos"), F.lit(m).alias("marker")))
        return F.when(text.contains(m), found).otherwise(F.array().cast("array<struct<pos:bigint,marker:string>>"))

    return F.array_sort(F.concat(*[of(m) for m in markers]))


def left_anchor(text: Column, pos: Column, length: int = 50, markers: Sequence[str] = MARKERS) -> Column:
    """Up to ``length`` characters before ``pos``, from the last marker in them on."""
    start = F.greatest(pos - length, F.lit(0))
    part = F.trim(F.substr(text, (start + 1).cast("int"), (pos - start).cast("int")), F.lit(_SPACES))
    return reduce(lambda t, m: F.trim(F.substring_index(t, m, -1), F.lit(_SPACES)), markers, part)


def right_anchor(text: Column, end: Column, length: int = 50, markers: Sequence[str] = MARKERS) -> Column:
    """Up to ``length`` characters from ``end`` on, up to the first marker in them."""
    part = F.trim(F.substr(text, (end + 1).cast("int"), F.lit(length)), F.lit(_SPACES))
    return reduce(lambda t, m: F.trim(F.substring_index(t, m, 1), F.lit(_SPACES)), markers, part)


_SPACES = " \t\n\r\x0b\x0c"


def normalize_anchor(text: Column) -> Column:
    """Text without the signs of tables, headings, emphasis and lists; lines end at newlines alone."""
    return collapse(reduce(lambda t, x: F.regexp_replace(t, x[0].replace("(?m)", "(?dm)"), x[1]), LAYOUT, text))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^a-zA-Z0-9]", ""))


def is_real_recovery(text: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Whether a candidate holds content, rather than masks, labels, layout or descriptions of images."""
    own = F.trim(text, F.lit(_SPACES))
    low = F.lower(own)
    blocks = F.length(own) - F.length(F.translate(own, "█■", ""))
    letters = F.regexp_replace(F.trim(F.translate(own, "█■", ""), F.lit(_SPACES)), "[<>()\\[\\]\"'\\s,;:+\\-]+", "")
    refused = [
        F.length(own) < 2,
        *[low.contains(m.lower()) for m in markers],
        low.contains("redact"),  # holds for escaped markers too
        (blocks > 0) & (blocks > 0.10 * F.length(own)),
        F.length(letters) < 4,
        low.isin(*PLACEHOLDERS),
        F.regexp_replace(own, r"[-—–|#*_:\s\\]+", "") == "",
        own.rlike(r"(?i)^</?[a-z]+/?>$"),
        low.isin(*LABELS),
        F.trim(F.regexp_replace(low, r"[\[\]<>]", "")).isin(*DESCRIPTIONS),
        own.rlike("^[Xx]+$"),
        own.rlike(r"^\d{4}$"),
        *[low.startswith(p) for p in IMAGE_PREFIXES],
    ]
    return ~reduce(lambda a, b: a | b, refused)


def clean_words(clean: Column) -> Column:
    return F.filter(F.split(clean, r"\s+"), lambda x: x != "")


def shingles(words: Column, size: int = 8) -> Column:
    """Windows of so many words, repeats included; none if there are fewer words.

    ``words`` has to be a column, not an expression: it is read again for each window.
    """
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(
        F.array().cast("array<string>")
    )


def email_headers(text: Column) -> Column:
    """Values of all header lines in a text, whatever the header."""
    each = [F.regexp_extract_all(text, F.lit(rf"(?imd)^{h}:\s*(.+)$"), F.lit(1)) for h in HEADERS]
    return F.transform(F.concat(*each), lambda v: F.trim(v, F.lit(_SPACES)))


def highlight_strings(texts: Column) -> Column:
    """What to search for to find recovered texts on a page: their lines without blocks, cut to 70 characters."""
    lines = F.flatten(F.transform(texts, lambda t: F.split(t, "\n")))
    clean = F.transform(lines, lambda x: F.trim(F.translate(x, "█■", ""), F.lit(_SPACES)))
    return F.array_distinct(F.transform(F.filter(clean, lambda x: F.length(x) >= 4), lambda x: F.substring(x, 1, 70)))


def wrapped_lines(text: Column, width: float, size: int = 10) -> Column:
    """Lines of a text cut to what a page of that width holds."""
    n = max(int(width / (size * 0.52)), 40)
    return F.flatten(
        F.transform(F.split(text, "\n"), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(n)), lambda i: F.substr(x, i + 1, F.lit(n))))
    )
