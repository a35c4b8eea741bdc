"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line goes if an earlier line (by document id, then place) equals it or is one edit (insertion, deletion or
substitution of a character) away, judged on the input. Lines under ``MIN_CHARS`` characters stay; with
``exact_all``, as in the registered queries, they go where an earlier line equals them and they have a word.

1. Equal lines meet by a 128-bit hash; only the earliest of each goes on.
2. Two lines one edit apart agree in their first or in their second half. Lines whose halves (four keys a
   line) nobody shares have no partner and leave; that loses no pair.
3. The rest emit their deletion variants as hashed keys, over the half where the edit must be. A key names
   how it arose, so that equal keys are one edit apart: a substitution key has the place and the length; a
   deletion key of a line meets the line that it spells. So a minimum a key finds the earliest partner,
   and no group is ever paired out.
4. Each line and its earliest partner by each key are compared by edit distance before the line goes. A line
   none of whose partners holds (keys can collide) is compared with all that share a key with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.suffix_dedup import _power, _span_hash, _sums
from slotwise.llm.textblock import U64, Block, mix, slices

MIN_CHARS = 16
#: Bits of a variant's key. Fewer make more keys collide and more pairs to compare, but no other result.
KEY_BITS = 64
#: Bits of the filter with which the texts of lines that may have a partner are picked from the scan: a fixed size.
FILTER_BITS = 24
#: Variants that are made at once, however long a line is.
VARIANTS = 1 << 18


class Lines:
    """The lines of a block that are long enough (or, with ``words``, have a word): bytes, place, text number, characters, hashes."""

    def __init__(self, block: Block, min_chars: int, words: bool = False):
        self.block = block
        ls, le = block.lines()
        doc = np.searchsorted(block.off, ls, "right") - 1
        empty = np.diff(block.off) == 0  # an empty text shares its offset with the next
        if empty.any():
            per = np.ones(block.n, np.int64)
            np.add.at(per, np.searchsorted(block.off, np.flatnonzero(block.buf == 10), "right") - 1, 1)
            doc = np.repeat(np.arange(block.n), per)
        place = np.arange(len(ls)) - np.searchsorted(doc, doc)
        self.chars_at = np.flatnonzero((block.buf & 0xC0) != 0x80)
        first, last = np.searchsorted(self.chars_at, ls), np.searchsorted(self.chars_at, le)
        counts = last - first >= min_chars
        if words:
            start = block.words()[0]
            counts |= np.searchsorted(start, le) > np.searchsorted(start, ls)
        at = np.flatnonzero(counts & (le > ls))
        self.start, self.end, self.doc, self.place = ls[at], le[at], doc[at], place[at]
        self.first, self.n = first[at], (last - first)[at]
        self.total = np.bincount(doc, minlength=block.n)
        self.sums = _sums(block.buf)
        self.key = _span_hash(self.sums, self.start, self.end)
        self.key2 = block.hashes(self.start, self.end)

    def byte(self, char: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The byte at which the given character of each line starts (its end for the one past the last)."""
        k = self.first[at] + char
        return np.where(char >= self.n[at], self.end[at], self.chars_at[np.minimum(k, len(self.chars_at) - 1)])

    def halves(self) -> np.ndarray:
        """Keys of the halves, a column a kind: first and second as the longer of a pair (or its equal), first and second as the shorter."""
        out = np.zeros((len(self.n), 4), U64)
        for longer in (True, False):
            m = self.n if longer else self.n + 1
            h = m // 2
            cut = (self.byte(h), self.byte(h if longer else h - 1))
            for k, (a, b) in enumerate(((self.start, cut[0]), (cut[1], self.end))):
                with np.errstate(over="ignore"):
                    out[:, k if longer else 2 + k] = mix(_span_hash(self.sums, a, b) + m.astype(U64) * U64(2) + U64(k))
        return out

    def variants(self, at: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(line, key, role) of the variants of the lines ``at``, in batches of about ``VARIANTS``: role 0 the line as the shorter of a pair, 1 a deletion, 2 a place for a substitution. A deletion may come twice."""
        lines, keys, roles, held = [], [], [], 0
        short = at[(kinds & 12) > 0]
        lines.append(short), keys.append(mix(self.key[short] + U64(1))), roles.append(np.zeros(len(short), np.int8))
        _, down = _power(len(self.block.buf) + 1)
        s = self.sums
        for k in np.flatnonzero(kinds & 3):
            i, n = at[k], int(self.n[at[k]])
            h, start, end = n // 2, self.start[at[k]], self.end[at[k]]
            first, last = 0 if kinds[k] & 2 else h, n if kinds[k] & 1 else h
            for q in range(first, last, VARIANTS):
                p = np.arange(q, min(q + VARIANTS, last))
                a, b = self.byte(p, np.full(len(p), i)), self.byte(p + 1, np.full(len(p), i))
                with np.errstate(over="ignore"):
                    # the polynomial of the line without the character: the part behind it moves down by its bytes
                    spelt = ((s[a] - s[start]) + (s[end] - s[b]) * down[b - a]) * down[start]
                    deleted = np.unique(mix(spelt + (end - start - (b - a)).astype(U64)))
                    place = mix(mix((s[a] - s[start]) * down[start] + U64(3)) + mix((s[end] - s[b]) * down[b] + U64(5)) + p.astype(U64) * U64(1 << 32) + U64(n))
                    keys += [mix(deleted + U64(1)), mix(place + U64(2))]
                lines += [np.full(len(deleted), i), np.full(len(place), i)]
                roles += [np.ones(len(deleted), np.int8), np.full(len(place), 2, np.int8)]
                held += len(deleted) + len(place)
                if held >= VARIANTS:
                    yield np.concatenate(lines).astype(np.int64), np.concatenate(keys), np.concatenate(roles)
                    lines, keys, roles, held = [], [], [], 0
        if lines:
            yield np.concatenate(lines).astype(np.int64), np.concatenate(keys), np.concatenate(roles)


def _i64(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), mask=null)


def _lines(rows: DataFrame, min_chars: int, exact_all: bool) -> DataFrame:
    """dkey, id, place, key, key2 and the four half keys of every line that counts; the half keys of a line under ``min_chars`` are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in slices(batch, "text", 1 << 19):
                x = Lines(block, min_chars, exact_all)
                doc, halves, short = pa.array(x.doc), x.halves(), x.n < min_chars
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(x.place), _i64(x.key), _i64(x.key2), *(_i64(halves[:, k], short) for k in range(4))], names)

    names = ["id", "dkey", "place", "key", "key2", "h0", "h1", "h2", "h3"]
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - FILTER_BITS)


def _near(rows: DataFrame, firsts: DataFrame, min_chars: int) -> DataFrame:
    """(id, dkey, place) of the lines, at their earliest occurrence, that have an earlier line one edit away."""
    spark = rows.sparkSession
    halves = firsts.select("key", "key2", F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("kind", "half")).where("half is not null")
    shared = runtime.materialize(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), "halves")
    kinds = runtime.join_maybe_hot(halves, shared, ["half"], "n", 4 * firsts.count()).groupBy("key", "key2").agg(F.expr("bit_or(shiftleft(1, kind))").alias("kinds"))
    able = runtime.materialize(firsts.select("key", "key2", "at").join(kinds, ["key", "key2"]), "able")
    words = able.groupBy((_bit(F.col("key")) / 64).cast("bigint").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) % 64 as int)))").alias("bits")).collect()  # at most 2 ** FILTER_BITS / 64 rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w in words:
        table[w["word"]] = w["bits"]
    filled = spark.sparkContext.broadcast(table)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = filled.value.view(U64)
        for batch in batches:
            for _, block in slices(batch, "text", 1 << 19):
                x = Lines(block, min_chars)
                bit = x.key >> U64(64 - FILTER_BITS)
                at = np.flatnonzero(t[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1))
                at = at[np.unique(x.key[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([_i64(x.key[at]), _i64(x.key2[at]), pa.array([block.text(a, b) for a, b in zip(x.start[at].tolist(), x.end[at].tolist(), strict=True)], pa.string())], ["key", "key2", "line"])

    found = rows.mapInArrow(texts, "key bigint, key2 bigint, line string").dropDuplicates(["key", "key2"])
    lines = runtime.materialize(able.join(found, ["key", "key2"]), "able-lines")

    kept_bits = U64((1 << KEY_BITS) - 1)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.asarray(batch.column(1)).astype(np.int64)
            done = 0
            for part, block in slices(batch, "line", 1 << 18):
                x = Lines(block, 0)
                for at, key, role in x.variants(np.arange(len(x.n)), kinds[done : done + part.num_rows]):
                    yield pa.RecordBatch.from_arrays([_i64(key & kept_bits), pa.array(role), part.column(2).take(pa.array(at))], ["variant", "role", "at"])
                done += part.num_rows

    at_type = firsts.schema["at"].dataType.simpleString()
    emitted = lines.select("line", "kinds", "at").mapInArrow(variants, f"variant bigint, role tinyint, at {at_type}")
    emitted = runtime.materialize(emitted, "variants")
    shared = emitted.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    met = runtime.materialize(emitted.join(shared, "variant"), "met")
    least = met.groupBy("variant").agg(F.min(F.when(F.col("role") != 1, F.col("at"))).alias("other"), F.min(F.when(F.col("role") == 1, F.col("at"))).alias("deleted"))
    # a line as the shorter looks at the deletions that spell it, a deletion at the line it spells, a place at its like
    partner = F.when(F.col("role") == 0, F.col("deleted")).otherwise(F.col("other"))
    text = runtime.materialize(lines.select("at.id", "at.dkey", "at.place", "line"), "able-texts")

    def judged(pairs: DataFrame) -> DataFrame:
        """Of the pairs (at, p) of places, at's place and whether its line is one edit away from p's."""
        apart = pairs.select("at.id", "at.dkey", "at.place", F.col("p.id").alias("i"), F.col("p.dkey").alias("k"), F.col("p.place").alias("n")).distinct()
        both = apart.join(text, _same(apart, text, "id", "dkey", "place")).select(*[apart[c] for c in apart.columns], "line")
        other = text.toDF("i", "k", "n", "other")
        both = both.join(other, _same(both, other, "i", "k", "n")).select(both["id"], "dkey", "place", "line", "other")
        return both.select("id", "dkey", "place", (F.levenshtein("line", "other", 1) == 1).alias("near"))

    first = judged(met.join(least, "variant").withColumn("p", partner).where("p < at").select("at", "p"))
    first = runtime.materialize(first.groupBy("id", "dkey", "place").agg(F.bool_or("near").alias("near")), "judged")
    doubtful = met.join(first.where("not near"), F.col("at.id").eqNullSafe(F.col("id")) & (F.col("at.dkey") == F.col("dkey")) & (F.col("at.place") == F.col("place"))).select("variant", "role", "at")
    others = met.select("variant", F.col("role").alias("r"), F.col("at").alias("p"))
    second = judged(doubtful.join(others, "variant").where("p < at and (role = 1) <> (r = 1) or p < at and role = 2 and r = 2").select("at", "p"))
    return first.where("near").select("id", "dkey", "place").union(second.where("near").select("id", "dkey", "place"))


def _same(a: DataFrame, b: DataFrame, id_: str, *keys: str) -> Column:
    """Rows of one document: the id may be null."""
    out = a[id_].eqNullSafe(b[id_])
    for k in keys:
        out &= a[k] == b[k]
    return out


def removed_lines(docs: DataFrame, *, bound: int = 1, min_chars: int = MIN_CHARS, exact_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dkey, places): for each document that loses lines, the places (from 0) of those; a document is told by its id together with ``document_key``. Only the result's table stays in the shared folder."""
    if bound not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    spark = docs.sparkSession
    runtime.ship(spark)
    since = runtime.mark()
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), document_key(docs[id_col], docs[text_col]).alias("dkey"), docs[text_col].cast("string").alias("text"))
    lines = runtime.materialize(_lines(rows, min_chars, exact_all), "lines")
    halves = [F.min(h).alias(h) for h in ("h0", "h1", "h2", "h3")]
    firsts = runtime.materialize(lines.groupBy("key", "key2").agg(F.min(F.struct("id", "dkey", "place")).alias("at"), F.count("*").alias("n"), *halves), "firsts")
    own = lines.select("key", "key2", F.struct("id", "dkey", "place").alias("own"))
    met = runtime.join_maybe_hot(own, firsts.where("n > 1").select("key", "key2", "at", "n"), ["key", "key2"], "n", lines.count())
    goes = met.where("own <> at or own is null or at is null").select("own.id", "own.dkey", "own.place").where("place is not null")
    if bound:
        goes = goes.union(_near(rows, firsts, min_chars))
    out = runtime.materialize(goes.distinct().groupBy("id", "dkey").agg(F.collect_list("place").alias("places")), "removed-lines")
    runtime.discard(spark, since=since, keep=1)
    return out


def document_key(id_col: Column, text_col: Column) -> Column:
    """A hash of a document's id and text. Rows equal in both are one document and fare alike; documents of different ids are told apart by these, whatever the hash."""
    return F.xxhash64(id_col.cast("bigint"), text_col.cast("string"))


def dedup_lines(docs: DataFrame, *, bound: int = 1, min_chars: int = MIN_CHARS, exact_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines gone from ``text_col``, and n_lines and n_removed beside its own columns.

    All rows and columns stay (those two names and ``_id``, ``_dkey``, ``_places`` must be free). A removed line goes with
    its line feed. Null texts stay null, with no line; a text that loses every line is empty. A null id comes
    before every other. Of equal documents (id and text) the lines are removed alike. An empty table stays so.
    With ``exact_all`` equal lines of any length go, if they have a word, and ``min_chars`` is for the edits only.
    """
    names = [*docs.columns, "n_lines", "n_removed"]
    if len({n.lower() for n in [*names, "_id", "_dkey", "_places"]}) < len(names) + 3:
        raise ValueError("the input has repeated column names, or one of the result's")
    gone = removed_lines(docs, bound=bound, min_chars=min_chars, exact_all=exact_all, id_col=id_col, text_col=text_col).toDF("_id", "_k", "_places")
    keyed = docs.withColumn("_dkey", document_key(docs[id_col], docs[text_col]))
    both = keyed.join(gone, keyed[id_col].cast("bigint").eqNullSafe(gone["_id"]) & (keyed["_dkey"] == gone["_k"]), "left").select(*[f"`{c}`" for c in docs.columns], "_places")
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_removed = [], [], []
            for text, places in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is None or not places:
                    out.append(text), n_lines.append(0 if text is None else text.count("\n") + 1), n_removed.append(0)
                    continue
                lines, drop = text.split("\n"), set(places)
                out.append("\n".join(x for k, x in enumerate(lines) if k not in drop)), n_lines.append(len(lines)), n_removed.append(len(drop))
            cols = list(batch.columns[:-1])
            cols[text_at] = pa.array(out, cols[text_at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names)

    return both.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_removed bigint")
