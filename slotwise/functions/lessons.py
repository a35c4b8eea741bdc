"""User-made lessons in a link: ``name|day|start|end|room``, joined by ``~``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.binding import spaced, strip

DAY_START, DAY_END, STEP, NAME_MAX, ROOM_MAX = 540, 1260, 30, 60, 20
LESSON = "struct<id: string, name: string, day: int, start: int, end: int, room: string>"


def _encode(c: Column) -> Column:
    """Percent encoding that leaves ``! ' ( ) *`` as they are, has %20 for a space and hides the separator."""
    e = F.url_encode(F.coalesce(c, F.lit("")))
    for form, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("~", "%7E")):
        e = F.replace(e, F.lit(form), F.lit(plain))
    return e


def encode(lessons: Column) -> Column:
    """array<struct(name, day, start, end, room)> as a link's value."""
    one = lambda x: F.concat_ws("|", _encode(x["name"]), x["day"].cast("string"), x["start"].cast("string"), x["end"].cast("string"), _encode(x["room"]))
    return F.array_join(F.transform(lessons, one), "~")


def _decode(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def decode(value: Column) -> Column:
    """The lessons of a link's value; entries that are broken, off the grid or out of the day's bounds are dropped.

    Ids tell the entry's place, dropped ones counted.
    """
    number = lambda x: F.when(x.rlike(spaced(r"^\s*[+-]?\d+\s*$")), strip(x).try_cast("int"))

    def one(part: Column, k: Column) -> Column:
        f = F.split(part, r"\|")
        at = lambda n: F.get(f, F.lit(n))
        name, room = strip(_decode(at(0))), strip(_decode(at(4)))
        day, start, end = number(at(1)), number(at(2)), number(at(3))
        good = (part != "") & (F.size(f) == 5) & (name != "") & room.isNotNull() & day.between(1, 5) & (start >= DAY_START) & (end <= DAY_END) & (start < end) & (start % STEP == 0) & (end % STEP == 0)
        made = F.struct(F.concat(F.lit("shared-"), k.cast("string")).alias("id"), F.substring(name, 1, NAME_MAX).alias("name"), day.alias("day"), start.alias("start"), end.alias("end"), F.when(room != "", F.substring(room, 1, ROOM_MAX)).alias("room"))
        return F.when(F.coalesce(good, F.lit(False)), made)

    return F.filter(F.transform(F.split(value, "~"), one), lambda x: x.isNotNull())
