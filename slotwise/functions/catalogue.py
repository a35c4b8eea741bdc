"""Catalogue cells: credits, plan and code pairs, guide links and languages; and how an exam's time is derived."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.binding import strip

#: Minutes of an exam whose end is not printed, and how much each source of a duration is worth, the languages and the form of a guide's link.
DEFAULT_EXAM_MINUTES = 120
STRENGTH = {"curated": 5, "explicit_range": 4, "start_override_default2h": 3, "vision_default2h": 2, "slot_default2h": 1}
LANGUAGES = ("EN", "ES")
GUIDE = r"GA_([^_/]+)_(\d+)_(EN|ES)_"


def clean_cell(c: Column) -> Column:
    """A trimmed cell; missing and broken ones are empty."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "#REF!", "").otherwise(t)


def credit_value(c: Column) -> Column:
    """The number at the start of a cell with a decimal comma; null if there is none."""
    digits = F.regexp_extract(strip(F.replace(c, F.lit(","), F.lit("."))), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def _cells(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def plan_code_pairs(plans: Column, codes: Column) -> Column:
    """array<struct(plan, code)>: the lists side by side to the end of the shorter, numeric codes only, each pair once."""
    p, k = _cells(plans), _cells(codes)
    n = F.least(F.size(p), F.size(k))
    pairs = F.zip_with(F.slice(p, 1, n), F.slice(k, 1, n), lambda a, b: F.struct(a.alias("plan"), b.alias("code")))
    return F.array_distinct(F.filter(pairs, lambda x: x["code"].rlike(r"^\d+$")))


def guide_url(base: str, year: str, plan: Column, code: Column, language: Column) -> Column:
    return F.concat(F.lit(f"{base}/{year}/GA_"), plan, F.lit("_"), code, F.lit("_"), language, F.lit(f"_{year}.pdf"))


def candidate_guides(base: str, year: str, plans: Column, codes: Column) -> Column:
    """The links of every pair, in each language."""
    both = lambda x: F.array(*[guide_url(base, year, x["plan"], x["code"], F.lit(v)) for v in LANGUAGES])
    return F.flatten(F.transform(plan_code_pairs(plans, codes), both))


def guide_pair(url: Column) -> Column:
    """struct(plan, code) of a link; null if it is none."""
    return F.when(url.rlike(GUIDE), F.struct(F.regexp_extract(url, GUIDE, 1).alias("plan"), F.regexp_extract(url, GUIDE, 2).alias("code")))


def guide_label(url: Column) -> Column:
    """struct(language, plan) of a link; null if it is none."""
    return F.when(url.rlike(GUIDE), F.struct(F.when(F.regexp_extract(url, GUIDE, 3) == "EN", "English").otherwise("Spanish").alias("language"), F.regexp_extract(url, GUIDE, 1).alias("plan")))


def guide_language(lines: Column) -> Column:
    """EN or ES: the first line with the keyword that has a value on it or on the next; null if none has."""
    keyed = lambda x: x.rlike(r"(?i)\b(LANGUAGE|IDIOMA)\b")
    both = F.transform(lines, lambda x, k: F.when(keyed(x), F.concat(x, F.lit("\n"), F.coalesce(F.get(lines, k + 1), F.lit("")))))
    value = lambda w: F.when(w.rlike(r"(?iu)(?<![\p{L}\p{N}_])(ENGLISH|INGL[ÉE]S)(?![\p{L}\p{N}_])"), "EN").when(w.rlike(r"(?iu)(?<![\p{L}\p{N}_])(ESPA[ÑN]OL|SPANISH)(?![\p{L}\p{N}_])"), "ES")
    return F.try_element_at(F.filter(F.transform(both, value), lambda v: v.isNotNull()), F.lit(1))


def is_assumed(source: Column) -> Column:
    return source.endswith("default2h")


def strength(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), source)


def derive_exam_time(annotations: Column, slot_start: Column, slot_end: Column, vision_start: Column | None = None, vision_end: Column | None = None) -> Column:
    """struct(start_min, end_min, duration_source, outside_slot): a printed range, else a printed start, else a transcribed time, else the slot's start.

    What has no printed end runs ``DEFAULT_EXAM_MINUTES``. Only a printed range can lie outside its slot.
    """
    first = lambda kind: F.try_element_at(F.filter(annotations, lambda a: a["kind"] == kind), F.lit(1))
    made = lambda s, e, how, out=None: F.struct(s.cast("int").alias("start_min"), e.cast("int").alias("end_min"), F.lit(how).alias("duration_source"), (out if out is not None else F.lit(False)).alias("outside_slot"))
    printed, start = first("explicitRange"), first("startOverride")
    vs = vision_start if vision_start is not None else F.lit(None).cast("int")
    ve = vision_end if vision_end is not None else F.lit(None).cast("int")
    return (
        F.when(printed.isNotNull(), made(printed["start_min"], printed["end_min"], "explicit_range", (printed["start_min"] < slot_start) | (printed["end_min"] > slot_end)))
        .when(start.isNotNull(), made(start["start_min"], start["start_min"] + DEFAULT_EXAM_MINUTES, "start_override_default2h"))
        .when(vs.isNotNull() & ve.isNotNull(), made(vs, ve, "explicit_range"))
        .when(vs.isNotNull(), made(vs, vs + DEFAULT_EXAM_MINUTES, "vision_default2h"))
        .otherwise(made(slot_start, slot_start + DEFAULT_EXAM_MINUTES, "slot_default2h"))
    )
