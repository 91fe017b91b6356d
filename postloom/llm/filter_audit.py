"""How quality filters interact: what each removes at each place of each order.

A document is a mask of the filters that it fails, and documents of one part
(source) and mask are alike, so the corpus folds into at most 32 cells a part.
Each cell then folds across all 120 orders inside its row: an order is an array of
filter bits, a step a struct of weighted counts, and the 600 structs of the cells of a
part are merged by elementwise sums. Only then do they become rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
# Fixed values of the five conditions.
BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_SHARE, MAX_CAPITAL_SHARE = 50, 65, 5
CAPITALS, SYMBOL = "[A-Z]", r"[#$%&*|]"
_COPY = 1 << LETTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_mask(text: Column) -> Column:
    """Bits of the conditions that a text alone decides: A, B, C and D."""
    counts = F.transform(
        F.array(F.filter(F.split(text, BLANKS), lambda w: w != "")),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")),
    )[0]
    capitals = F.regexp_count(text, F.lit(CAPITALS))
    bit = lambda letter, fails: F.when(fails, 1 << LETTERS.index(letter)).otherwise(0)
    by_words = F.transform(F.array(counts), lambda c: bit("A", c["n"] < MIN_WORDS) + bit("B", 100 * c["distinct"] < MIN_DISTINCT_SHARE * c["n"]))[0]
    return by_words + bit("C", 100 * capitals > MAX_CAPITAL_SHARE * F.length(text)) + bit("D", text.rlike(SYMBOL))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail.

    docs: doc_id bigint, text string, source string. labels: doc_id bigint, quality
    and toxic integers; several labels of a document count as their largest. Other
    columns are not read.

    A null text is empty, a null source the empty part. E fails where a row with a
    smaller doc_id has the same text, by SHA-256; a null doc_id is neither smaller
    nor larger than any and has no labels. Rows alike in id, text and source are
    counted each, and fail E no more than the first of them.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), own_mask(text).alias("mask"),
    ).groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    # One row a text and one a document; neither join meets a hot key: a text's rows differ in doc_id.
    first = own.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("_good"), is_one("toxic").alias("_toxic"))
    flagged = own.join(first, ["same", "doc_id"], "left").join(known, "doc_id", "left")
    copied = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c.strip("_"))
    return flagged.withColumn("mask", F.col("mask") + F.when(copied, _COPY).otherwise(0)).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("_good"), total("_toxic"))


def _folded(orders: Column, mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of a cell, in the order of ``orders`` and their steps."""

    def step(done: Column, bit: Column) -> Column:
        fails, alive = mask.bitwiseAND(bit) != 0, done["alive"]
        here = lambda when, weight: F.when(when, weight).otherwise(F.lit(0).cast("bigint"))
        row = F.struct(
            here(alive & ~fails, n).alias("kept"), here(alive & fails, n).alias("removed"), here(~alive & fails, n).alias("redundant"),
            here(mask == bit, n).alias("unique_fails"), here(alive & fails, good).alias("good_lost"), here(alive & fails, toxic).alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(done["rows"], F.array(row)).alias("rows"))

    none = F.from_json(F.lit("[]"), f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(True).alias("alive"), none.alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda done: done["rows"])))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    Inputs, nulls and repeats: see ``cells``. shapley is what the step's filter removes
    in all 120 orders together. No documents give no rows; labels may be empty.
    """
    orders = F.lit([[1 << LETTERS.index(x) for x in order] for order in ORDERS])
    # An order array in every task, and at most 32 cells a part.
    own = cells(docs, labels).withColumn("orders", orders)
    folded = own.select("part", _folded(F.col("orders"), F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("steps"))
    sums = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTS)))
    lists = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = lists.select("part", F.aggregate(F.slice("cells", 2, 31), F.col("cells")[0], sums).alias("steps"), F.flatten(orders).alias("bits"))
    removed = lambda bit: F.aggregate(F.zip_with("steps", "bits", lambda s, b: F.when(b == bit, s["removed"]).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # Bits by letter: the sums stand in the order of the letters.
    parts = merged.select("part", F.array(*(removed(1 << i) for i in range(len(LETTERS)))).alias("shapley"), F.posexplode("steps").alias("at", "s"))
    order, step = (F.col("at") / 5).cast("int"), F.col("at") % 5 + 1
    named = parts.withColumn("filter_order", F.get(F.lit(ORDERS), order)).withColumn("step", step.cast("int"))
    letter = F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select("part", "filter_order", "step", "s.*", F.get("shapley", letter - 1).alias("shapley"))
