"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are lower-case runs of letters and digits, as 64-bit hashes. A mask says which of the next words a seed looks at, so a
substituted word at an ignored position does not break it. Seeds of all word positions of the test items fill a Bloom filter of fixed
size; training positions that pass it are joined with the test seeds, and around each hit the words at equal places are compared.

A document and an item match if some seed of theirs agrees and, of some ``WINDOW`` words around it (an overhang at either end counts as
disagreeing), at least the share ``agreeing`` agrees; for a shorter item the share of its own length is asked. An item of fewer words
than the shortest mask has one exact seed, its whole word sequence, and matches where a document holds it word for word; one
of fewer than ``FEW`` words only matches documents that are nothing else. Letters of scripts without blanks are words of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import give_back_driver

#: Fixed masks; 0 is an ignored position.
MASKS = ("11101001011", "1101100010111", "1011010011101")
WINDOW = 20
#: The Bloom filter is an array of so many 64-bit numbers (512 KB), whatever the size of the benchmark.
BLOOM_LONGS = 1 << 16
_SPAN = min(map(len, MASKS))
#: Items of fewer words occur by chance in many texts.
FEW = 3
#: Scripts that put no blanks between words. The range, which holds them all, is tested first: scripts are slow to tell.
_UNSPACED = r"[\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]]"
_BEFORE = WINDOW - _SPAN


def word_hashes(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({_UNSPACED})", " $1 ")
    words = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(h: Column, i: Column, mask: int) -> Column:
    """The seed of one mask at word ``i``; null where the mask overhangs the end."""
    places = [k for k, c in enumerate(MASKS[mask]) if c == "1"]
    return F.when(i + len(MASKS[mask]) <= F.size(h), F.xxhash64(F.lit(mask), *[F.get(h, i + k) for k in places]))


def _whole_seed(h: Column, i: Column, n: int) -> Column:
    """The exact seed of the ``n`` words from ``i``; null where they overhang the end, and, of fewer than ``FEW``, where ``h`` has others."""
    fits = i + n <= F.size(h) if n >= FEW else F.size(h) == n
    return F.when(fits, F.xxhash64(F.lit(len(MASKS) + n), F.slice(h, i + 1, n)))


def _bits(seed: Column) -> list[Column]:
    """Two places in the filter, whose length is a power of two."""
    return [seed.bitwiseAND(F.lit(BLOOM_LONGS * 64 - 1)), F.shiftright(seed, 27).bitwiseAND(F.lit(BLOOM_LONGS * 64 - 1))]


def _around(h: Column, i: Column) -> Column:
    """The words around a seed, null before the first; beyond the last there are none."""
    return F.concat(F.array_repeat(F.lit(None).cast("long"), F.greatest(_BEFORE - i, F.lit(0))), F.slice(h, F.greatest(i - _BEFORE, F.lit(0)) + 1, F.least(i, F.lit(_BEFORE)) + WINDOW))


def _seeded(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (with ``h``) for every place and each of its seeds: ``place, seed``, the latter null where it overhangs.

    The generators, and filters and columns after them, are one loop of generated code, which no lambda function would be, and
    ``h`` is not copied per place. Outer generators have no filter inferred below them, which would compute ``h`` twice.
    """
    last = F.size("h") - min([_SPAN, *lengths])
    placed = rows.select("*", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("place"))
    seeds = [_seed(F.col("h"), F.col("place"), m) for m in range(len(MASKS))] + [_whole_seed(F.col("h"), F.col("place"), n) for n in lengths]
    return placed.select("*", F.explode_outer(F.array(*seeds)).alias("seed"))


def item_seeds(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``seed, item, item_words, item_around`` for every word position of every item, and once for an item of fewer words than a mask."""
    rows = items.select(F.col(id_col).alias("item"), word_hashes(F.col(text_col)).alias("h"))
    long = _seeded(rows, []).where("seed IS NOT NULL").select("seed", "item", F.size("h").alias("item_words"), _around(F.col("h"), F.col("place")).alias("item_around"))
    whole = F.coalesce(*[F.when(F.size("h") == n, _whole_seed(F.col("h"), F.lit(0), n)) for n in range(1, _SPAN)])
    short = rows.select(whole.alias("seed"), "item", F.size("h").alias("item_words"), _around(F.col("h"), F.lit(0)).alias("item_around")).where("seed IS NOT NULL")
    return long.unionByName(short).distinct()


def bloom_filter(seeds: DataFrame) -> DataFrame:
    """One row, ``bloom``: the filter over all seeds, as an array of a fixed number of longs."""
    bits = seeds.select(F.explode(F.array(*_bits(F.col("seed")))).alias("bit"))
    longs = bits.groupBy(F.expr("bit div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("long"))
    dense = seeds.sparkSession.range(BLOOM_LONGS).join(longs, "id", "left").select("id", F.coalesce("long", F.lit(0)).alias("long"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "long"))), lambda x: x["long"]).alias("bloom"))


def find_overlaps(docs: DataFrame, items: DataFrame, *, agreeing: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per matching pair: ``id_col, item_id_col, agreeing_words, first_word``: most agreeing words of a window, and the first seed's place.

    Null texts have no words. Rows of one id, and rows without id, count together, as do items; pairs are given once. Hits are
    looked for in the whole text. Either table may be empty: no pairs. Other columns are ignored.
    """
    tests = item_seeds(items, id_col=item_id_col, text_col=item_text_col)
    # At most as many as a mask has places; other lengths need no seeds.
    lengths = sorted(r["item_words"] for r in tests.where(F.col("item_words") < _SPAN).select("item_words").distinct().collect())
    give_back_driver(docs.sparkSession)
    # Fixed in size, and found when the plan runs: as a literal its numbers would be in every text of the plan that the driver makes and keeps.
    bloom = bloom_filter(tests).scalar()
    set_at = lambda bit: F.getbit(F.get(bloom, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1

    def passes(seed: Column) -> Column:
        first, second = _bits(seed)
        return set_at(first) & set_at(second)

    rows = docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("h"))
    passed = _seeded(rows, lengths).where(passes(F.col("seed"))).select("id", "place", "seed", _around(F.col("h"), F.col("place")).alias("around"))
    hits = passed.join(tests, "seed")
    agree = F.zip_with("around", "item_around", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    sums = F.transform(F.array(agree), lambda g: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(_BEFORE)), lambda t: F.aggregate(F.slice(g, t + 1, WINDOW), F.lit(0), lambda x, y: x + y))))[0]
    met = hits.select("id", "item", "place", "item_words", sums.alias("most")).where(F.col("most") >= F.ceil(F.lit(agreeing) * F.least(F.col("item_words"), F.lit(WINDOW))))
    return met.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_id_col)).agg(F.max("most").alias("agreeing_words"), F.min("place").alias("first_word"))


def without_overlaps(docs: DataFrame, items: DataFrame, *, agreeing: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text matches no item, all columns as they were. Rows are told by their text, so repeated and null ids are safe."""
    texts = docs.select(F.xxhash64(text_col, F.lit(1)).alias("key"), F.col(text_col).alias("text"))
    bad = find_overlaps(texts, items, agreeing=agreeing, id_col="key", text_col="text", item_id_col=item_id_col, item_text_col=item_text_col).select(F.col("key").alias("_overlap_key")).distinct()
    return docs.join(bad, F.xxhash64(docs[text_col], F.lit(1)) == bad["_overlap_key"], "left_anti")
