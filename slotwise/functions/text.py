"""Names as text: accents, annotations, rooms, filler, canonical forms and slugs, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.binding import let, spaced, strip

#: Words that do not tell names apart, prefixes that a name may carry, spellings taken as one.
STOPWORDS = ["de", "del", "la", "el", "y", "en", "los", "las", "of", "the", "and", "for", "in", "to", "a"]
PREFIXES = ["i and e basics", "hci basics", "hci"]
EQUIVALENCES = [("e health", "ehealth"), ("e mail", "email")]
FILLER = [r"actividades\s+de\s+evaluaci[oó]n", r"uso\s+extraordinario", r"to\s+be\s+used\s+sporadically", r"complementary\s*/?\s*(?:and\s+)?evaluation\s+activities", r"complementary\s+activities", r"^\s*[/\s]*$"]


def _bases(last: int) -> tuple[str, str]:
    """Characters up to ``last`` whose canonical decomposition is one base letter and marks, and those letters."""
    pairs = []
    for k in range(0xA0, last):
        n = "".join(x for x in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(x) != "Mn")
        if len(n) == 1 and n != chr(k) and not 0xD800 <= k < 0xE000:
            pairs.append((chr(k), n))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTS = _bases(0x10000)


def deaccent(c: Column) -> Column:
    """Without accents: letters with marks become their base, loose marks go."""
    return F.regexp_replace(F.translate(c, *_ACCENTS), r"\p{Mn}", "")


def _vectorised(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """``change`` of texts that are not plain ASCII, in Arrow batches. No built-in knows the normal forms; not for use inside a lambda."""

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else change(t), na_action="ignore")

    return changed


#: Dashes and quotes that are taken as one.
_MARKS = str.maketrans("–—‐‑‒‘’", "-----''")


def compatible(c: Column) -> Column:
    """Full-width, styled, ligature and composite forms as their plain characters (NFKC), dashes and single quotes as one each."""
    return _vectorised(lambda t: unicodedata.normalize("NFKC", t).translate(_MARKS))(c)


def composed(c: Column) -> Column:
    """Letters and their marks as one character where there is one (NFC), as paths are compared."""
    return _vectorised(lambda t: unicodedata.normalize("NFC", t))(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, spaced(r"\s+"), " "))


#: Patterns of what is printed beside a name, in the order in which they are taken out.
PRINTED_RANGE = spaced(r"(?i)\(\s*(\d{1,2}(?::\d{2})?\s*(?:-|–|to)\s*\d{1,2}(?::\d{2})?\s*h?\.?)\s*\)")
START_OVERRIDE = spaced(r"(?:^|\s)(\d{1,2}:\d{2})\s*h\.?(?=\s|$)")
WEEK_RANGE = spaced(r"(?i)\(\s*(weeks?\s+\d{1,2}\s*-\s*\d{1,2})\s*\)")
MONTH_RANGE = spaced(r"(?i)\(\s*([a-z]{3}\s*-\s*[a-z]{3})\s*\)")
ELECTIVE = spaced(r"(?i)\(\s*(?:elective|\*)\s*\)")
PLACEHOLDER = r"/{3,}"
STAR = spaced(r"\*+\s*$")

_ANNOTATION = "struct<kind: string, start_min: int, end_min: int, label: string, raw: string>"


def _annotation(kind: str, raw: Column, start: Column | None = None, end: Column | None = None, label: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (start if start is not None else null).cast("int").alias("start_min"), (end if end is not None else null).cast("int").alias("end_min"), (label if label is not None else null).cast("string").alias("label"), raw.alias("raw"))


def _as(kind: str) -> Callable[[Column], Column]:
    """A match as an annotation of a kind that has no value."""
    return lambda raw: _annotation(kind, strip(raw) if kind == "star" else raw)


def strip_annotations(c: Column) -> Column:
    """struct(name, annotations): what is printed beside a name, taken out in a fixed order and kept as values.

    Time ranges in parentheses (only those that parse go), a bare start time with ``h``, week and month ranges
    in parentheses, ``(elective)`` or ``(*)``, runs of three or more slashes, and a trailing star.
    """
    from slotwise.functions.times import parse_time_range

    inner = lambda raw: F.regexp_replace(raw, spaced(r"^\(\s*|\s*\)$"), "")
    minute = lambda t: F.split(t, ":")[0].cast("int") * 60 + F.substring(F.split(t, ":")[1], 1, 2).cast("int")

    def printed(raw: Column) -> Column:
        return let(parse_time_range(inner(raw)), lambda r: F.when(r.isNotNull(), _annotation("explicitRange", raw, r["start_min"], r["end_min"])))

    def timed(state: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(state["name"], F.lit(PRINTED_RANGE), F.lit(0)), printed), lambda a: a.isNotNull())
        return let(found, lambda f: F.struct(F.aggregate(f, state["name"], lambda acc, a: F.replace(acc, a["raw"], F.lit(" "))).alias("name"), f.cast(f"array<{_ANNOTATION}>").alias("annotations")))

    def taken(pattern: str, made: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def step(state: Column) -> Column:
            found = F.transform(F.regexp_extract_all(state["name"], F.lit(pattern), F.lit(0)), made).cast(f"array<{_ANNOTATION}>")
            return F.struct(F.regexp_replace(state["name"], pattern, " ").alias("name"), F.concat(state["annotations"], found).alias("annotations"))

        return step

    steps = [
        timed,
        taken(START_OVERRIDE, lambda raw: _annotation("startOverride", strip(raw), minute(strip(raw)))),
        taken(WEEK_RANGE, lambda raw: _annotation("weekRange", raw, label=inner(raw))),
        taken(MONTH_RANGE, lambda raw: _annotation("dateRange", raw, label=F.lower(F.regexp_replace(inner(raw), spaced(r"\s+"), "")))),
        taken(ELECTIVE, _as("elective")),
        taken(PLACEHOLDER, _as("placeholder")),
        taken(STAR, _as("star")),
    ]
    state = F.struct(c.alias("name"), F.array().cast(f"array<{_ANNOTATION}>").alias("annotations"))
    for step in steps:
        state = let(state, step)
    return let(state, lambda s: F.struct(collapse(s["name"]).alias("name"), s["annotations"].alias("annotations")))


def normalise_inline(c: Column, equivalences: list[tuple[str, str]] = EQUIVALENCES) -> Column:
    """As ``normalise``, by built-in functions alone: some ten passes over the text, for short names."""
    return _forms(strip_annotations(compatible(c))["name"], equivalences)


def normalise(c: Column, equivalences: list[tuple[str, str]] = EQUIVALENCES) -> Column:
    """struct(full, tokens, key, candidates): a name's canonical forms, made in one go over each Arrow batch, block by block. Not for use inside a lambda.

    ``full``: annotations, accents, case and punctuation gone, & and hyphens read as words and spaces, equivalent
    spellings as one (by substring). ``tokens``: its words without stopwords. ``key``: with hyphens. ``candidates``:
    the form without a known prefix before a colon, where there is one.
    """
    made = canonical_forms(equivalences)

    def of(texts: pa.Array) -> pa.Array:
        rows = [(None, None, None, []) if t is None else made(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), _FORMS.values(), strict=True)], list(_FORMS))

    @F.arrow_udf(FORMS)
    def forms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(of, blocks(batch))

    return forms(c)


FORMS = "full string, tokens array<string>, key string, candidates array<string>"
_FORMS = {"full": pa.string(), "tokens": pa.list_(pa.string()), "key": pa.string(), "candidates": pa.list_(pa.string())}

#: Bytes of texts that are made into words at a time: the words of a whole Arrow batch (10,000 texts or 64 MB) would take many times its memory in each task.
BLOCK_BYTES = 1 << 20


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts in slices of about ``BLOCK_BYTES``, beside one text of any length each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    cuts = np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1
    for a, b in pairwise(np.unique([0, *cuts, len(texts)]).tolist()):
        yield texts.slice(a, b - a)


def canonical_forms(equivalences: list[tuple[str, str]] = EQUIVALENCES) -> Callable[[str], tuple[str, list[str], str, list[str]]]:
    """A function of one text that gives the fields of ``normalise``: the patterns are compiled once, and only those are tried whose marks the text has."""
    import regex

    # as the built-in patterns have it: digits and (?i) are of ASCII, a dot is no line's end
    build = lambda p: re.compile(spaced(p).replace(r"(.+)", r"([^\n\r\u0085\u2028\u2029]+)"), re.ASCII)
    printed, inner, override, weeks, months, elective, star = map(build, (PRINTED_RANGE, r"^\(\s*|\s*\)$", START_OVERRIDE, WEEK_RANGE, MONTH_RANGE, ELECTIVE, STAR))
    blanks, slashes, prefixes = build(r"\s+"), build(PLACEHOLDER), [build(rf"^{p}\s*:\s*(.+)$") for p in PREFIXES]
    other, plain_other = regex.compile(spaced(r"[^\p{L}\p{N}\s]")), build(r"[^0-9A-Za-z\s]")
    bases = str.maketrans(*_ACCENTS) | {k: None for k in range(0x110000) if unicodedata.category(chr(k)) == "Mn"}
    stop = frozenset(STOPWORDS)

    def unannotated(t: str) -> str:
        if "(" in t:
            for raw in [m.group() for m in printed.finditer(t)]:
                if _is_range(inner.sub("", raw)):
                    t = t.replace(raw, " ")
        if ":" in t:
            t = override.sub(" ", t)
        if "(" in t:
            t = elective.sub(" ", months.sub(" ", weeks.sub(" ", t)))
        if "///" in t:
            t = slashes.sub(" ", t)
        return star.sub(" ", t) if "*" in t else t

    def collapsed(t: str) -> str:
        return blanks.sub(" ", t).strip(" ")

    def made(t: str) -> tuple[str, list[str], str, list[str]]:
        ascii_ = t.isascii()
        if not ascii_:
            t = unicodedata.normalize("NFKC", t).translate(_MARKS)
        t = collapsed(unannotated(t)).lower()
        if not ascii_:
            t = t.translate(bases)
        t = collapsed(t.replace("&", " and ").replace("-", " "))
        for old, new in equivalences:
            t = t.replace(old, new)
        drop = (lambda x: collapsed(plain_other.sub(" ", x))) if t.isascii() else (lambda x: collapsed(other.sub(" ", x)))
        full, rest = drop(t), next((m.group(1) for p in prefixes if (m := p.search(t))), None)
        rest = None if rest is None else drop(rest)
        return full, [w for w in full.split(" ") if w and w not in stop], full.replace(" ", "-"), [rest] if rest and rest != full else []

    return made


#: The notations of ``times``, for one text.
def _is_range(t: str) -> bool:
    from slotwise.functions import times

    if not _PATTERNS:
        _PATTERNS.update({n: re.compile(p, re.ASCII) for n, p in (("range", times._RANGE), ("twelve", times._TWELVE), ("clock", times._CLOCK), ("hour", times._HOUR), ("ends", spaced(r"^\s+|\s+$")))})
    ends = lambda x: _PATTERNS["ends"].sub("", x)

    def minutes(x: str) -> int | None:
        x = ends(x)
        if m := _PATTERNS["twelve"].search(x):
            return (int(m[1]) % 12 + 12 * (m[3].lower() == "p")) * 60 + int(m[2])
        if m := _PATTERNS["clock"].search(x):
            return int(m[1]) * 60 + int(m[2])
        return int(m[1]) * 60 if (m := _PATTERNS["hour"].search(x)) else None

    m = _PATTERNS["range"].search(ends(t))
    if not m:
        return False
    a, b = (x if (x := minutes(g)) is not None else minutes(f"{g}:00") for g in m.groups())
    return a is not None and b is not None and b > a


_PATTERNS: dict[str, re.Pattern] = {}


def _forms(name: Column, equivalences: list[tuple[str, str]]) -> Column:
    drop = lambda t: collapse(F.regexp_replace(t, spaced(r"[^\p{L}\p{N}\s]"), " "))

    def forms(full: Column, rest: Column) -> Column:
        tokens = F.filter(F.split(full, " "), lambda t: (t != "") & ~t.isin(STOPWORDS))
        candidates = F.when(rest.isNotNull() & (rest != "") & (rest != full), F.array(rest)).otherwise(F.array().cast("array<string>"))
        return F.struct(full.alias("full"), tokens.alias("tokens"), F.replace(full, F.lit(" "), F.lit("-")).alias("key"), candidates.alias("candidates"))

    def rest_of(s: Column) -> Column:
        return drop(F.coalesce(*[F.nullif(F.regexp_extract(s, spaced(rf"^{p}\s*:\s*(.+)$"), 1), F.lit("")) for p in PREFIXES]))

    s = deaccent(F.lower(name))
    s = collapse(F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(" ")))
    for old, new in equivalences:
        s = F.replace(s, F.lit(old), F.lit(new))
    return let(s, lambda v: let(drop(v), lambda full: let(rest_of(v), lambda rest: forms(full, rest))))


#: Lines that name a room.
ROOMS = [r"(?i)^\s*(?:Aulas?|Rooms?|Classroom)\s+([\dA-Za-z]+(?:\s*-\s*\d+)?)\s*$", r"^\s*\[([^\]]+)\]\s*$", r"(?i)^\s*\(Classroom\s+([^)]+)\)\s*$"]


def room_of(line: Column) -> Column:
    """The room that a whole line names; null if it names none."""
    return F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract(line, spaced(p), 1), F.lit("")) for p in ROOMS]), spaced(r"\s+"), "")


def extract_room(lines: Column) -> Column:
    """The room of the last line that is one."""
    rooms = F.filter(F.transform(lines, room_of), lambda r: r.isNotNull())
    return F.try_element_at(rooms, F.lit(-1))


def name_lines(lines: Column) -> Column:
    """The lines but the last that names a room; all of them if nothing would be left."""
    flags = F.transform(lines, lambda x: room_of(x).isNotNull())
    at = F.size(lines) - F.array_position(F.reverse(flags), True).cast("int")  # from 0; the size if there is none
    rest = F.filter(lines, lambda x, k: (k != at) | ~F.array_contains(flags, True))
    return F.when(F.size(rest) > 0, rest).otherwise(lines)


def assemble_name(lines: Column) -> Column:
    """A name from array<struct(y, x, text)>: top to bottom, left to right, without its room line."""
    ordered = F.transform(F.array_sort(F.transform(lines, lambda r: F.struct((-r["y"]).alias("y"), r["x"].alias("x"), r["text"].alias("text")))), lambda r: r["text"])
    return collapse(F.array_join(name_lines(ordered), " "))


def classify_block(name: Column, extra: list[str] | None = None) -> Column:
    """``filler`` for blank names and those of the filler patterns, else ``course``."""
    filler = name.rlike(spaced("(?i)" + "|".join(FILLER + (extra or []))))
    return F.when((strip(name) == "") | filler, "filler").otherwise("course")


def slug(path: Column) -> Column:
    """A file's path as a name of plain characters: no .pdf, -- for /, - for other runs."""
    s = F.replace(F.regexp_replace(path, r"(?i)\.pdf$", ""), F.lit("/"), F.lit("--"))
    s = F.regexp_replace(F.lower(deaccent(s)), "[^a-z0-9.-]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-{3,}", "--"), "^-+|-+$", "")
