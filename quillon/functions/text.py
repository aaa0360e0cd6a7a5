"""Column functions on text: normal forms, tokens, hashes, redaction, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in every script, spelt out because the default class differs between engines.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one by one: those of one byte, and the others.
NARROW_SPACES, WIDE_SPACES = " \t\n\v\f\r", "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HAN = r"[\x{4E00}-\x{9FFF}]"


def squash(text: Column) -> Column:
    """Text without any white space: the normal form of cells, column names and hashed content."""

    def without(text: Column, marks: str) -> Column:
        return F.aggregate(F.array(*map(F.lit, marks)), text, lambda x, c: F.when(F.contains(x, c), F.replace(x, c, F.lit(""))).otherwise(x))

    # characters are searched as bytes, which costs less than half of a regular expression
    return F.transform(F.array(without(text, NARROW_SPACES)), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(without(x, WIDE_SPACES)))[0]


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(NARROW_SPACES + WIDE_SPACES))


def analyze(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of Han characters gives its overlapping pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def pairs(run: Column) -> Column:
        pair = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^{HAN}"), pair).otherwise(F.array(run))

    mixed = F.regexp_extract_all(low, F.lit(rf"{HAN}+|(?:(?!{HAN})[\p{{L}}\p{{N}}])+"), F.lit(0))
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))  # most texts have no Han
    return F.when(~low.rlike(HAN), plain).otherwise(F.flatten(F.transform(mixed, pairs)))


def content_hash(text: Column) -> Column:
    return F.sha2(squash(text), 256)


def section_prefix(section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit("## "), section, F.lit("\n")))


def clause_no(section: Column) -> Column:
    """Dotted number in the last part of a section path, null if there is none."""
    last = strip(F.element_at(F.split(section, "/"), -1))
    return F.nullif(F.regexp_extract(last, r"(\d+(?:\.\d+){1,3})(?:[ \t]|$)", 1), F.lit(""))


def formula_no(content: Column) -> Column:
    """Number of a formula in brackets; a form with a hyphen comes before a plain dotted one."""
    hyphen = F.regexp_extract(content, r"[（(](\d+(?:\.\d+){0,3}-\d+)[）)]", 1)
    plain = F.regexp_extract(content, r"[（(](\d+\.\d{1,3})[）)]", 1)
    return F.coalesce(F.nullif(hyphen, F.lit("")), F.nullif(plain, F.lit("")))


def contains_clause(text: Column, clause: Column) -> Column:
    """The clause number stands in the text, not inside a longer number."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])\Q"), clause, F.lit(r"\E(?!\d)")))


def iso_date_cell(cell: Column) -> Column:
    """A spreadsheet cell: dates as yyyy-mm-dd without a midnight time, anything else trimmed, null as ''."""
    s = F.regexp_replace(strip(F.coalesce(cell, F.lit(""))), r"\s+00:00:00(?:\.\d+)?$", "")
    part = lambda i: F.regexp_extract(s, r"^(\d{4})[.-](\d{1,2})[.-](\d{1,2})$", i)
    dated = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | s.rlike(r"^\d{4}\.\d{1,2}\.\d{1,2}$")
    return F.when(dated, F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise(s)


#: What is masked in logs, in order; groups are kept.
MASKS = [
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "***"),
    (r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;'\"\\]+", "$1***"),
    (r"(?i)(\bbearer\s+)[^\s,;'\"\\]+", "$1***"),
    (r"(?i)(x-api-key\s*[:=]\s*)[^\s,;'\"\\]+", "$1***"),
    (r"(?i)(api[_-]?key\s*[:=]\s*)[^\s,;'\"\\]+", "$1***"),
    (r"(?i)(password\s*[:=]\s*)[^\s,;'\"\\]+", "$1***"),
    (r"(?i)sk-[A-Za-z0-9_-]{6,}", "sk-***"),
    (r"(://[^:/@\s]+:)[^@\s]+(@)", "$1***$2"),
]


def redact(text: Column, secrets: list[str] = ()) -> Column:
    """Text with keys, tokens, passwords and the given secrets masked."""
    out = text
    for pattern, mask in MASKS:
        out = F.regexp_replace(out, pattern, mask)
    for secret in secrets:
        if len(secret) >= 6:
            out = F.replace(out, F.lit(secret), F.lit("***"))
    return out


def path_template(path: Column) -> Column:
    """A request path with its numbers replaced, for metrics labels."""
    return F.regexp_replace(path, r"/\d+(?=/|$)", "/{id}")


def bad_citations(answer: Column, n_sources: Column) -> Column:
    """Citation marks [n] of the answer that point to no source, ascending, each once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n < 1) | (n > n_sources))))


def cited_pieces(answer: Column, n_sources: Column) -> Column:
    """The answer in pieces (text, source), cut at citation marks that point to a source; source is null for plain text."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]|\z"), F.lit(0))
    plain = F.split(answer, r"\[\d+\]")
    number = lambda m: F.nullif(F.regexp_extract(m, r"(\d+)", 1), F.lit("")).try_cast("long")
    valid = lambda m: number(m).isNotNull() & number(m).between(1, n_sources)
    none = F.lit(None).cast("long")
    parts = F.flatten(F.zip_with(plain, marks, lambda p, m: F.array(F.struct(p.alias("text"), none.alias("source")), F.when(valid(m), F.struct(m.alias("text"), number(m).alias("source"))).otherwise(F.struct(F.coalesce(m, F.lit("")).alias("text"), none.alias("source"))))))
    # plain pieces that stand side by side, around a mark that points nowhere, are one
    join = lambda done, x: F.when((F.size(done) > 0) & F.try_element_at(done, F.lit(-1))["source"].isNull() & x["source"].isNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.concat(F.try_element_at(done, F.lit(-1))["text"], x["text"]).alias("text"), none.alias("source"))))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.filter(parts, lambda x: F.coalesce(x["text"], F.lit("")) != ""), F.array().cast("array<struct<text:string,source:bigint>>"), join)


def grams(text: Column) -> Column:
    """Pairs of neighbouring characters, each once; a single character is its own. A text that holds another one of two
    characters or more has all of its pairs."""
    one = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    # by a list of the characters, as finding each in a long text by its place takes time by the square of its length
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    pair = F.transform(F.array(one), pairs)[0]
    return F.when(F.length(text) > 1, F.array_distinct(pair)).when(F.length(text) == 1, F.array(text)).otherwise(F.array().cast("array<string>"))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def head_and_tail(text: Column, head: int = 2400, tail: int = 1600, mark: str = "\n…\n") -> Column:
    """Long text as its beginning and its end."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -tail, tail)))


def first_json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def garble_ratio(text: Column) -> Column:
    """Share of replacement and private-use characters; 0 for the empty text."""
    bad = F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x{E000}-\x{F8FF}]", ""))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def common_han_ratio(text: Column, common: str) -> Column:
    """Of the Han characters, the share that is in ``common``; 0 without any."""
    han = F.length(text) - F.length(F.regexp_replace(text, HAN, ""))
    known = F.length(text) - F.length(F.translate(text, common, ""))
    return F.when(han > 0, known / han).otherwise(F.lit(0.0))


def needs_ocr(text: Column, common: str, min_chars: int = 50, garble: float = 0.02, han: float = 0.2) -> Column:
    """A page's text layer is missing or broken."""
    return (F.length(squash(text)) < min_chars) | (garble_ratio(text) > garble) | (common_han_ratio(text, common) < han)


def profile_fingerprint(**profile) -> Column:
    """32 hex digits naming an embedding configuration; keys in sorted order."""
    import json

    return F.substring(F.sha2(F.lit(json.dumps(profile, sort_keys=True)), 256), 1, 32)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for an embedding: bytes of the sha256, repeated, over 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def sse_frame(event: Column) -> Column:
    """A struct as one server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def in_pieces(text: Column, size: int = 50) -> Column:
    """Text cut into pieces of ``size`` characters; none for the empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
