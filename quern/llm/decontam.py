"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are canonicalised: numbers, units behind numbers and names become typed placeholders, letters
lower case, punctuation goes. Windows of ``WINDOW`` template words are hash-joined, every one of
the benchmark against every one of the documents; an item of fewer words is one window as a whole.
Matches on one diagonal (document position minus item position) are added up, and those on
diagonals fewer than ``BAND`` apart as well, so that words put in or left out don't split a passage.
A document is contaminated by an item if a diagonal or a band covers enough of it, or ``RUN`` words
of it in a row whatever its length, with ``LITERALS`` literal words or the very fillers of the item, and the slots are
consistent: equal fillers in the item always stand for equal fillers in the document, and the
other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.spread import neutral, written

WINDOW = 6
SLACK = 3
LITERALS = 4
SHARE = 0.4
LEAST_WORDS = 12
RUN = 13
BAND = 8
FEW_HITS = 1 << 20
SIEVE_WORDS = 1 << 15  # longs of the bitmap that windows pass before they are joined

#: Units that may follow a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles|mile|ft|feet|in|inches|l|ml|litres|liters|s|sec|seconds|min|minutes|minute|h|hours|hour|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|euros|euro|pounds|percent|mph|kmh"
SLOT = "\u0001"


def canonical_words(text: Column) -> Column:
    """Lower-cased words without punctuation; a placeholder is SLOT, its type's letter, its value."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(SLOT), F.lit(" "))
    # a number without a unit leaves an empty one behind, which goes at the end
    t = F.regexp_replace(t, rf"(?=[\d$€£])(?<![\p{{L}}\p{{N}}])[$€£]?(\d++(?:[.,]\d++)*+)(?:\s?({UNITS}|%))?(?![\p{{L}}\p{{N}}])", f"{SLOT}n$1 {SLOT}u$2 ")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}++)(?![\p{L}\p{N}])", f"{SLOT}p$1")
    words = F.split(F.lower(t), r"(?:[^\p{L}\p{N}\u0001.,]|(?<!\d)[.,]|[.,](?!\d))++")
    return F.array_remove(F.array_remove(words, ""), f"{SLOT}u")


def _words(rows: DataFrame, key: str) -> DataFrame:
    """key, w (canonical words) and h (their hashes, a placeholder's without its value) of each text."""
    rows = rows.select(key, canonical_words(F.col("text")).alias("w"))
    # the next step refers to w and h more than once each: so Spark keeps them as columns and doesn't compute them anew for each window
    return rows.select(key, "w", F.transform("w", lambda x: F.xxhash64(F.when(x.startswith(SLOT), F.substring(x, 1, 2)).otherwise(x))).alias("h"))


def _hashes(length: int) -> Column:
    """A hash for each place's window of a length from the words' hashes, by doubling; what is past the last window has one too."""
    known = {1: F.col("h")}
    while max(known) * 2 <= length:
        n = max(known)
        known[2 * n] = _joined(known[n], known[n], n)
    n = max(known)
    out = known[n]
    while n < length:
        step = max(k for k in known if n + k <= length)
        out, n = _joined(out, known[step], n), n + step
    return out


def _joined(a: Column, b: Column, ahead: int) -> Column:
    """Hashes of each place's a with the b that many places ahead."""
    return F.zip_with(a, F.slice(b, ahead + 1, F.size("h")), lambda x, y: F.xxhash64(x, y))


def _windows(length: int, sieve: Column | None = None) -> Column:
    """at, hash, own (the words) of each window of a length, without those that the sieve stops."""
    count = F.size("w") - length + 1

    def chosen(x: Column, i: Column) -> Column:
        keep = i < count if sieve is None else (i < count) & _may_match(x, sieve)
        return F.when(keep, F.struct(i.alias("at"), x.alias("hash"), F.slice("w", i + 1, length).alias("own")))

    return F.array_compact(F.transform(_hashes(length), chosen))


def _sieve(hashes: DataFrame) -> Column:
    """A bitmap of hashes as a constant array of SIEVE_WORDS longs, however many they are."""
    word, bit = F.shiftright("hash", 6).bitwiseAND(F.lit(SIEVE_WORDS - 1)), F.expr("shiftleft(1L, cast(hash & 63 as int))")
    bits = {r["word"]: r["bits"] for r in hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect()}
    return F.from_json(F.lit("[" + ",".join(str(bits.get(i, 0)) for i in range(SIEVE_WORDS)) + "]"), "array<bigint>")


def _may_match(hash: Column, sieve: Column) -> Column:
    word = F.get(sieve, F.shiftright(hash, 6).bitwiseAND(F.lit(SIEVE_WORDS - 1)))
    return F.getbit(word, hash.bitwiseAND(F.lit(63)).cast("int")) == 1


def _stretches(starts: str) -> Column:
    """Words that each window of the column length adds to the union of those that begin at the sorted starts, and whether the next one begins beyond its end."""
    nexts = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1) + F.col("length")))
    return F.zip_with(starts, nexts, lambda a, b: F.struct(F.least(b - a, F.col("length")).alias("n"), (b - a > F.col("length")).alias("gap")))


def _covered(starts: str) -> Column:
    """Words in the union of the windows."""
    return F.aggregate(_stretches(starts), F.lit(0), lambda n, x: n + x["n"])


def _longest(starts: str) -> Column:
    """Words in the longest stretch without a gap."""
    none = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(
        _stretches(starts), none, lambda a, x: F.struct(F.when(x["gap"], 0).otherwise(a["run"] + x["n"]).alias("run"), F.greatest(a["best"], a["run"] + x["n"]).alias("best")), lambda a: a["best"]
    )


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, covered (words), item_words, windows, verbatim of each contaminated pair.

    Null and empty texts match nothing. Rows of one id count as one document (or item), so repeated rows
    change nothing; a null id is an id. Very long texts are looked at whole. Where several diagonals of a
    pair count, the most words do. Other columns are not looked at; either table empty gives none.
    """
    items = _words(benchmark.select("item_id", "text"), "item_id").where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).distinct().collect()) or [WINDOW]  # WINDOW values at most
    own = F.coalesce(*(F.when(size == n, _windows(n)) for n in lengths))
    items = items.select("item_id", F.size("w").alias("item_words"), F.explode(own).alias("x"))
    places = F.transform("x.own", lambda x, i: F.when(~x.startswith(SLOT), F.col("x.at") + i))
    items = items.select("item_id", "item_words", F.col("x.at").alias("item_at"), "x.hash", F.col("x.own").alias("item_own"), F.array_compact(places).alias("literals"))
    # windows that the benchmark can't have go before they become rows
    sieve = _sieve(items)
    texts = _words(docs.select("doc_id", "text"), "doc_id")
    texts = texts.select("doc_id", F.explode(F.concat(*(_windows(n, sieve) for n in lengths))).alias("x"))
    found = texts.select("doc_id", "x.*").join(items, "hash")
    pairs = F.filter(F.transform(F.arrays_zip(F.col("item_own").alias("b"), F.col("own").alias("d")), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))), lambda x: x["b"].startswith(SLOT))
    # each match counts for its diagonal and for the two bands of 2 * BAND diagonals it lies in
    shift = F.col("at") - F.col("item_at")
    band = F.floor(shift / BAND)
    groups = [F.struct(F.lit(bands).alias("bands"), number.cast("long").alias("number")) for bands, number in ((False, shift), (True, band), (True, band + 1))]
    diagonal = found.withColumn("group", F.explode(F.array(*groups))).groupBy("doc_id", "item_id", "item_words", "group").agg(
        F.countDistinct("at").alias("windows"), F.max(F.size("own")).alias("length"), F.sort_array(F.collect_set("item_at")).alias("starts"), F.sort_array(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
        F.size(F.array_distinct(F.flatten(F.collect_set("literals")))).alias("literals"),
    )
    # on a band a document's words may meet several of the item's, and count once
    diagonal = diagonal.withColumn("covered", F.least(_covered("starts"), _covered("ats"))).withColumn("run", F.least(_longest("starts"), "covered"))
    covered = F.col("covered")
    fillers = [F.size(F.array_distinct(F.col("slots")[side])) for side in ("b", "d")]
    consistent = (F.size("slots") == fillers[0]) & (F.size("slots") == fillers[1])
    enough = covered >= F.greatest(F.lit(least_words), F.ceil(F.col("item_words") * share))
    short = (F.col("item_words") < least_words + SLACK) & (covered + SLACK >= F.col("item_words"))
    verbatim = ~F.exists("slots", lambda x: x["b"] != x["d"])
    hit = diagonal.where(consistent & (enough | short | (F.col("run") >= RUN)) & (verbatim | (F.col("literals") >= LITERALS)))
    return hit.groupBy("doc_id", "item_id").agg(F.max(covered).alias("covered"), F.max("item_words").alias("item_words"), F.max("windows").alias("windows"), F.max(verbatim).alias("verbatim"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of documents that no item contaminates, with their own columns, whatever their names.

    All rows of a contaminated id go, a null id's too. Null and empty texts stay; very long ones are looked at
    whole; an empty benchmark takes none, an empty table gives none. The ids found are written first; up to
    FEW_HITS of them are broadcast, so that texts needn't be shuffled, beyond that both sides are.
    """
    found = written(matches(docs, benchmark, share, least_words).select(F.col("doc_id").alias("hit")).distinct())
    found = F.broadcast(found) if found.count() <= FEW_HITS else found.hint("merge")
    plain = neutral(docs)
    return plain.join(found, plain["doc_id"].eqNullSafe(found["hit"]), "left_anti").toDF(*docs.columns)
