"""Operator 2: benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import broadcast_if_small, cut_lineage, words

#: Five words each; a 0 is a position that may differ.
MASKS = ("1110101", "110010011")
#: Words of a passage that are compared around a hit; shorter items whole.
WINDOW = 25
SIMILARITY = 0.8
#: Words of an item up to which it has masks of its own, under which each overlap is found: of 10 words with two substitutions MASKS alone find 0.89.
OWN_MASKS = 11
#: Rows of seeds, or of hits, that are broadcast at most (under 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 200_000


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """df with a row (at, seed) for each position of `words` and mask that fits there; the seed is the hash of the words under the mask."""
    at = F.col("at")
    keys = [F.when(at + len(m) <= F.size("words"), F.xxhash64(F.lit(m), *[F.get("words", at + k) for k, c in enumerate(m) if c == "1"])) for m in masks]
    placed = df.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    return placed.withColumn("seed", F.explode(F.array(*keys))).where("seed IS NOT NULL")


def _whole_masks(n: int, similarity: float, longest: int) -> list[str]:
    """Masks of which each overlap with an item of n words meets one.

    Below `longest` words: all choices of as many words as must be equal. From there
    on, fewer: of two blocks more than words may differ two at least are whole, so
    all choices of two blocks.
    """
    may_differ = max(t for t in range(n) if t == 0 or (n - t) / n >= similarity)
    if n < longest:
        return sorted({"".join("0" if k in left_out else "1" for k in range(n)).strip("0") for left_out in combinations(range(n), may_differ)})
    block = [k * (may_differ + 2) // n for k in range(n)]
    return sorted({"".join("1" if block[k] in pair else "0" for k in range(n)).strip("0") for pair in combinations(range(may_differ + 2), 2)})


def _small(df: DataFrame, most: int) -> DataFrame:
    """df with a hint to broadcast it, if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, masks: tuple[str, ...] = MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that overlap: id, item, similarity, matched, compared, at, hits.

    Documents and items are words with A-Z in lower case. The words under each mask
    are hashed at every position; where a document's hash meets an item's, both are
    laid on each other there, and each `window` words of the item (the whole item, if
    it is shorter) are compared place by place. An overlap is a window of which the
    part `similarity` or more is equal, the rest being substitutions; `at` is the
    document's word where the best window begins, `hits` counts the seeds that lay
    document and item on each other in such a way.

    Items of up to OWN_MASKS words have masks of their own, which find each overlap. Of
    longer ones with nothing equal outside the passage MASKS find all from 12 to 14
    and from 17 to 25 words, and 0.993 and 0.998 of 15 and 16 words with three substitutions.
    Items without words and texts that are null or blank match nothing; rows with
    null ids take part with a null id, one by text; repeated rows are merged into one; other
    columns are left out; empty tables give an empty one.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("words")).where("size(words) > 0").distinct()
    longest = max(map(len, masks))
    usual = max(longest, OWN_MASKS + 1)
    # How long the shorter items are: at most as many numbers as `usual`.
    short = sorted(r[0] for r in items.where(F.size("words") < usual).select(F.size("words")).distinct().collect())
    tests = _seeds(items.where(F.size("words") >= usual), list(masks))
    whole = {n: _whole_masks(n, similarity, longest) for n in short}
    for n, own_masks in whole.items():
        tests = tests.unionByName(_seeds(items.where(F.size("words") == n), own_masks))
    # An item's words are looked up again at its hits, as a seed carries only their hash.
    key = F.xxhash64("words")
    tests = _small(tests.select("item", key.alias("key"), "seed", F.col("at").alias("item_at")).distinct(), MAX_BROADCAST)
    theirs = items.select(F.col("item").alias("their_item"), key.alias("their_key"), F.col("words").alias("theirs"))
    theirs = broadcast_if_small(theirs, 40 + F.octet_length(F.array_join("theirs", " ")) + 8 * F.size("theirs"))

    # Rows are told apart by id and text, so that null ids and repeated ids aren't laid on each other's hits.
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    every_mask = [*masks, *sorted({m for own_masks in whole.values() for m in own_masks} - set(masks))]
    met = _seeds(own, every_mask).select("id", "row", "at", "seed").join(tests, "seed")
    # The document's word on which the item's first one lies; it may hang over the document's ends. A repeated row has the same seeds again.
    placed = met.groupBy("id", "row", "item", "key", (F.col("at") - F.col("item_at")).alias("place")).agg(F.count_distinct("at", "seed").alias("hits"))
    hits = _small(cut_lineage(placed.select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"), "item", "key", "place", "hits")), MAX_BROADCAST)

    # Only documents with hits are cut into words again.
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    of_hit = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row"))
    with_hits = texts.join(_small(hits.select("hit_id", "hit_row").distinct(), MAX_BROADCAST), of_hit, "left_semi").select("id", "row", words(F.col("text")).alias("words"))
    # What hangs over the document's ends is null there and can't match.
    laid = with_hits.join(hits, of_hit).join(theirs, F.col("item").eqNullSafe(F.col("their_item")) & (F.col("key") == F.col("their_key")))
    n = F.size("theirs")
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce((F.get("words", F.col("place") + k) == F.get("theirs", k)).cast("int"), F.lit(0)))
    equal = laid.select("id", "row", "item", "key", "place", "hits", F.least(n, F.lit(window)).alias("compared"), same.alias("same"))
    # The first window, and each next one from the one before: a place more behind, one less in front.
    first = F.aggregate(F.slice("same", 1, F.col("compared")), F.lit(0), lambda x, y: x + y)
    state = lambda run, most, begin: F.struct(run.alias("run"), most.alias("most"), begin.alias("begin"))

    def moved(x: F.Column, k: F.Column) -> F.Column:
        run = x["run"] + F.get("same", k + F.col("compared") - 1) - F.get("same", k - 1)
        return state(run, F.greatest(x["most"], run), F.when(run > x["most"], k).otherwise(x["begin"]))

    started = equal.withColumn("first", first).withColumn("begins", F.slice(F.sequence(F.lit(0), F.size("same") - F.col("compared")), 2, F.size("same")))
    run = F.aggregate("begins", state(F.col("first"), F.col("first"), F.lit(0)), moved)
    checked = started.withColumn("run", run).select("id", "row", "item", "key", F.col("place").alias("laid_at"), "hits", "compared", F.col("run.most").alias("matched"), (F.col("place") + F.col("run.begin")).alias("place"))
    checked = checked.withColumn("similarity", F.col("matched") / F.col("compared")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", "compared", "matched", (-F.col("place")).alias("back")))
    once = checked.dropDuplicates(["id", "row", "item", "key", "laid_at"])
    # Rows without an id are documents of their own, by their texts.
    found = once.groupBy("id", F.when(F.col("id").isNull(), F.col("row")).alias("row"), "item").agg(best.alias("best"), F.sum("hits").alias("hits"))
    return found.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "best.similarity", F.col("best.matched").cast("long").alias("matched"), F.col("best.compared").cast("long").alias("compared"), (-F.col("best.back")).cast("long").alias("at"), "hits"
    )
