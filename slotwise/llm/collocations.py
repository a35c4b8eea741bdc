"""Phrases of two to five words that occur more often than their parts would by chance, mined level by level with hashed counts.

Pass k over the corpus counts phrases of k words exactly and, at the same time, counts phrases of k + 1 words in hashed
buckets (the method of Park, Chen and Yu, with direct hashing and pruning): 2 ** BITS counters a task, which saturate at the support. Merged,
the buckets that reach the support are a bitmap of fixed size, which the next pass takes as a broadcast together with one of the hashes
of the frequent phrases of k words (Apriori: both phrases of k words in one of k + 1 must be frequent). Only phrases that pass both are counted
exactly, and only phrases of k + 2 words made of two such go to buckets. The bitmaps let some others through, never lose one, and
the exact counts decide.

Within a task equal phrases are found by hash, compared byte by byte and summed before they leave it. The frequent phrases then meet
their parts in one join; nothing but the bitmaps is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import U64, Block, mix, of_array, same_bytes, slices

#: Buckets (as a power of 2), and rows in which a task hands over its counters.
BITS, PARTS = 22, 256
#: Distinct phrases that a task sums up before they leave it, and languages whose totals may be a broadcast.
HELD_ROWS, MAX_LANGS = 1 << 18, 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", 10, 11, 12, 13]] = True
_OUT = _SPLIT.copy()
_OUT[[0x20, 9]] = True


class Phrases:
    """The words of a block's texts in lower case, with the hash of the phrase of any length that starts at each.

    ``group``: a number for each text, whose phrases are told apart by it; ``seed``: its hash.
    """

    def __init__(self, block: Block, group: np.ndarray, seed: np.ndarray):
        self.buf = _LOWER[block.buf]
        words = Block(self.buf, block.off)
        self.start, self.end = words.spans(~_OUT[self.buf])
        self.hashes = words.hashes(self.start, self.end)
        text = np.repeat(np.arange(block.n), words.per_text(self.start))
        self.group, self._seed = group[text], seed[text]
        marks = np.cumsum(_SPLIT[self.buf], dtype=np.int64)
        n = max(len(self.start) - 1, 0)
        #: whether the next word is of the same piece
        self.joint = (text[1:] == text[:-1]) & (marks[self.start[1:]] == marks[self.start[:-1]]) if n else np.zeros(0, bool)

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase of k words starts at each word, its hash)."""
        n = max(len(self.start) - k + 1, 0)
        ok, h = np.ones(n, bool), self._seed[:n]
        for j in range(k):
            if j:
                ok &= self.joint[j - 1 : j - 1 + n]
            h = chain(h, self.hashes[j : j + n])
        return ok, h

    def counted(self, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number) of each distinct phrase of k words among those at the given places, whose hashes are ``h``."""
        _, first, same, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        like = at[first][same]
        equal = self.group[at] == self.group[like]
        for j in range(k):
            equal &= same_bytes(self.buf, self.start[at + j], self.end[at + j], self.start[like + j], self.end[like + j])
        if equal.all():
            return at[first], n
        by_bytes: dict[tuple, list[int]] = {}  # two phrases of one hash
        for i in at.tolist():
            by_bytes.setdefault((int(self.group[i]), self.buf_of(i, k)), []).append(i)
        return np.array([x[0] for x in by_bytes.values()]), np.array([len(x) for x in by_bytes.values()])

    def buf_of(self, i: int, k: int) -> bytes:
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[i : i + k], self.end[i : i + k], strict=True))

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at these places, with one space between words."""
        word = (at[:, None] + np.arange(k)).ravel()
        size = self.end[word] - self.start[word] + 1
        size[k - 1 :: k] -= 1
        to = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(to[-1]) - np.repeat(to[:-1], size)
        inside = place < np.repeat(self.end[word] - self.start[word], size)
        out = np.full(to[-1], 32, np.uint8)
        out[inside] = self.buf[(place + np.repeat(self.start[word], size))[inside]]
        off = to[::k].astype(np.int32) if to[-1] < 1 << 31 else to[::k]
        kind = pa.string() if off.dtype == np.int32 else pa.large_string()
        return pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(off), pa.py_buffer(out)]).cast(pa.string())


def chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    with np.errstate(over="ignore"):
        return mix(h * U64(0xD1342543DE82EF95) + word)


def seeds(groups: list[str]) -> np.ndarray:
    b = of_array(pa.array([f"{g}\x00" for g in groups], pa.string()))
    return b.hashes(b.off[:-1], b.off[1:])


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def has(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Whether the bucket of each hash is set."""
    at = bucket(h)
    return np.frombuffer(bitmap, np.uint8)[at >> 3] & (U64(1) << (7 - (at & 7)).astype(U64)).astype(np.uint8) > 0


def survivors(p: Phrases, k: int, frequent: bytes | None, full: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether the phrase of k words at each word may be frequent, its hash) by the bitmaps of the pass before."""
    ok, h = p.level(k)
    if k > 1:
        known = has(frequent, p.level(k - 1)[1])
        ok &= known[: len(ok)] & known[1 : 1 + len(ok)] & has(full, h)
    return ok, h


def parts_of(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The counters' parts that are not all 0."""
    for part, some in enumerate(np.split(counts, PARTS)):
        if some.any():
            yield part, some.tobytes()


#: What a pass gives: numbers of phrases (the phrase of no word has the number of all words), or parts of the counters.
SCHEMA = "lang string, phrase string, n bigint, part int, counts binary"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def rows(lang: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, n, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=_ARROW)


def one_pass(docs: DataFrame, k: int, last: int, support: int, frequent: bytes | None, full: bytes | None) -> DataFrame:
    """Pass k over (lang, text): see ``SCHEMA``; written, as two jobs read it."""
    runtime.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, full))  # two bitmaps of 2 ** BITS bits
    kind, top = (np.uint8, support) if support < 128 else (np.uint32, support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, b = shared.value
        counts = np.zeros(1 << BITS, np.uint32)
        held: list[pa.Table] = []

        def total() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            return t.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).combine_chunks()

        for batch in batches:
            for some, block in slices(batch, "text"):
                coded = some.column(0).dictionary_encode()
                names = coded.dictionary.to_pylist()
                group = np.asarray(coded.indices).astype(np.int64)
                p = Phrases(block, group, seeds(names)[group])
                ok, h = survivors(p, k, f, b)
                at = np.flatnonzero(ok)
                first, n = p.counted(at, h[at], k)
                lang = [coded.dictionary.take(pa.array(p.group[first]))]
                phrase, number = [p.strings(first, k)], [n]
                if k == 1:
                    words = np.bincount(p.group, minlength=len(names))
                    lang, phrase, number = [*lang, coded.dictionary], [*phrase, pa.array([""] * len(names))], [*number, words]
                held.append(pa.table([pa.concat_arrays(lang), pa.concat_arrays(phrase), pa.array(np.concatenate(number).astype(np.int64))], ["lang", "phrase", "n"]))
                if k < last:
                    longer, h = p.level(k + 1)
                    longer &= ok[: len(longer)] & ok[1 : 1 + len(longer)]
                    counts += np.bincount(bucket(h[longer]), minlength=1 << BITS).astype(np.uint32)
                    np.minimum(counts, top, out=counts)
                if sum(map(len, held)) > 2 * HELD_ROWS:
                    held = [total()]
                    if len(held[0]) > HELD_ROWS:
                        for x in held.pop().to_batches():
                            yield rows(*x.columns)
        if held:
            for x in total().to_batches():
                yield rows(*x.columns)
        for part, data in parts_of(counts.astype(kind)):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], schema=_ARROW)

    return runtime.materialize(docs.mapInArrow(run, SCHEMA), f"phrases-{k}")


def bitmap(parts: DataFrame, support: int) -> bytes | None:
    """The buckets whose counters, summed over all rows of (part, counts), reach the support; None if there is none."""
    kind = np.uint8 if support < 128 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(data, kind).astype(np.uint32)
                sums[part] = np.minimum(sums[part] + one, support) if part in sums else one
        if sums:
            bits = [np.packbits(x >= support).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    n = min(PARTS, runtime.tasks(parts.sparkSession))
    got = parts.where("part is not null").select("part", "counts").repartition(n, "part").mapInArrow(run, "part int, bits binary").collect()  # at most 2 ** BITS bits
    out = np.zeros((PARTS, (1 << BITS) // PARTS // 8), np.uint8)
    for part, bits in got:
        out[part] = np.frombuffer(bits, np.uint8)
    return out.tobytes() if out.any() else None


def marked(frequent: DataFrame, support: int) -> DataFrame:
    """(part, counts) with counters at the support for the hashes of these phrases."""
    kind = np.uint8 if support < 128 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, kind)
        for batch in batches:
            block = of_array(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            start, end = block.words()
            words, h = block.hashes(start, end), seeds(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
            size = block.per_text(start)
            first = np.cumsum(size) - size
            for j in range(int(size.max(initial=0))):
                more = size > j
                h[more] = chain(h[more], words[first[more] + j])
            counts[bucket(h)] = support
        for part, data in parts_of(counts):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "counts"])

    return frequent.select("lang", "phrase").mapInArrow(run, "part int, counts binary")


def frequent_phrases(docs: DataFrame, *, support: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, n_words) of every phrase of up to ``longest`` words that occurs ``support`` times or more in its language.

    The phrase of no word, with n_words 0, has the number of all words of its language (whatever the support).
    """
    source = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    levels, known, full = [], None, None
    for k in range(1, longest + 1):
        found = one_pass(source, k, longest, support, known, full)
        sums = found.where("part is null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        words = F.when(F.col("phrase") == "", 0).otherwise(k)
        levels.append(runtime.materialize(sums.where((F.col("a") >= support) | (F.col("phrase") == "")).select("lang", "phrase", "a", words.cast("int").alias("n_words")), f"frequent-{k}"))
        if k < longest:
            known, full = bitmap(marked(levels[-1].where("n_words > 0"), support), support), bitmap(found, support)
            if known is None or full is None:
                break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _words(k: Column, start: Column) -> Column:
    """k words of the phrase from the given one on, as a phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), start, k), " ")


def scored(phrases: DataFrame, *, longest: int = 5, inside_percent: int = 100) -> DataFrame:
    """The phrases of two words or more with l and r of their lowest-scoring cut and score, without those inside a longer one.

    ``phrases`` as ``frequent_phrases`` gives them. The score of a cut is floor(1000 a n / (l r)), worked out in decimals of 38 digits; it is
    at most 1000 n / max(l, r), so a long holds it. A phrase goes if a longer one that has its words in a row occurs at least
    ``inside_percent`` / 100 times as often.
    """
    total = phrases.where("n_words = 0").select("lang", F.col("a").alias("n"))
    if total.limit(MAX_LANGS + 1).count() <= MAX_LANGS:
        total = F.broadcast(total)  # a row a language
    both = phrases.where("n_words > 1")
    part = lambda words, slot, k: F.struct(words.alias("part"), F.lit(f"{slot}{k}").alias("slot"), F.lit(k).alias("k"))
    cuts = [part(_words(F.lit(k), F.lit(1)), "l", k) for k in range(1, longest)]
    cuts += [part(_words(F.greatest(F.col("n_words") - k, F.lit(0)), F.lit(k + 1)), "r", k) for k in range(1, longest)]
    exploded = both.select("lang", "phrase", "a", "n_words", F.explode(F.array(*cuts)).alias("c")).where("c.k < n_words").select("lang", "phrase", "a", "c.part", "c.slot")
    numbers = phrases.where("n_words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    met = exploded.join(numbers, ["lang", "part"]).select("lang", "phrase", "a", "slot", "f")
    places = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i")) for m in range(2, longest) for i in range(1, longest - m + 2)]
    inner = both.where("n_words > 2").select("lang", "phrase", "a", "n_words", F.explode(F.array(*places)).alias("p")).where("p.m < n_words and p.i + p.m - 1 <= n_words") if places else None
    if inner is not None:
        met = met.unionByName(inner.select("lang", _words(F.col("p.m"), F.col("p.i")).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit("in").alias("slot"), F.col("a").alias("f")))
    slot = lambda s: F.max(F.when(F.col("slot") == s, F.col("f"))).alias(s)
    per = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), slot("in"), *[slot(f"{x}{k}") for x in "lr" for k in range(1, longest)])
    left = per.where(f"`in` is null or 100 * cast(`in` as decimal(38,0)) < {int(inside_percent)} * cast(a as decimal(38,0))").join(total, "lang")
    wide = lambda c: f"cast({c} as decimal(38,0))"
    cut = lambda k: f"if(l{k} is null, null, struct(({wide(1000)} * {wide('a')} * {wide('n')}) div ({wide(f'l{k}')} * {wide(f'r{k}')}) as score, {k} as k, l{k} as l, r{k} as r))"
    best = F.expr(f"array_min(array({', '.join(cut(k) for k in range(1, longest))}))").alias("c")
    return left.select("lang", "phrase", "a", "n", best).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, *, support: int = 100, longest: int = 5, top: int = 2000, inside_percent: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score, by score and a descending and phrase ascending (bytes of UTF-8).

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and 0x0A-0x0D, and pieces into words at spaces and tabs. Within a language a is
    the number of a phrase's occurrences within pieces, l and r those of its two parts, n that of all words. A null language is ``und``; a null text is empty; repeated rows
    count each; an empty table, or one without a frequent phrase, gives no row; other columns are not read. ``support`` is at least 1,
    ``longest`` at least 2.

    Best ones are taken per language and salt before they are per language, so a language's phrases are in one task only
    when there are ``top`` a salt left of them.
    """
    if support < 1 or longest < 2 or top < 1:
        raise ValueError("support and top are at least 1, longest at least 2")
    since = runtime.mark()
    found = runtime.materialize(scored(frequent_phrases(docs, support=support, longest=longest, lang_col=lang_col, text_col=text_col), longest=longest, inside_percent=inside_percent), "collocations")
    runtime.discard(docs.sparkSession, since=since, keep=1)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(runtime.tasks(docs.sparkSession)))
    some = found.withColumn("_salt", salt).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
