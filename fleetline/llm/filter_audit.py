"""How corpus filters interact: what each removes, alone and after others, in every order.

Five filters judge whole texts; a failing document has the filter's bit. A to D follow from the text alone. E (a copy of
a smaller id's text) is an existential self-join: rows whose text hash occurs more than once are joined, left-semi, on
hash, exact text and smaller id with one row for each repeated text, its least id. Its ids are united with the ids that
fail other filters, the bits of an id are put together, and rows are counted by part and bit combination. The report
of all orders is made from these counts alone, at most 32 a part.

All steps are built-in functions. Equal texts are reduced to one row before they are shuffled as the right side, and a
left side with very many copies of one text is split by adaptive execution, as in any equality join.

Defined results: a null text is empty; a null part is the empty string; a null id is no copy and nothing is its copy;
repeated rows of one id and text are not copies of each other and count one by one; of several labels of one id the
highest counts; further columns are ignored; an empty table gives an empty report; texts are read whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import own_name
from fleetline.session import staged

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: White space of the contract.
_SPACE = r"[\x20\x09-\x0D]+"


def with_failures(df: DataFrame, text: str = "text", name: str = "bits") -> DataFrame:
    """`df` with the bits of the filters A to D that each text fails."""
    words, found = F.array_remove(F.split(F.col(text), _SPACE), ""), own_name(df, "_words")
    upper = F.length(F.regexp_replace(F.col(text), "[^A-Z]+", ""))
    fails = (F.size(found) < 50, 100 * F.size(F.array_distinct(found)) < 65 * F.size(found),
             100 * upper > 5 * F.length(text), F.col(text).rlike(r"[#$%&*|]"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)]
    return df.withColumn(found, words).withColumn(name, reduce(add, bits)).drop(found)


def later_copies(rows: DataFrame) -> DataFrame:
    """Those of the rows (id, hash, text, ...) whose text a row with a smaller id has as well.

    Only rows whose hash occurs again are written and joined, so most texts are shuffled once.
    """
    again = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    met = staged(rows.filter("id IS NOT NULL").join(again, "hash", "left_semi"), "repeated")
    texts = met.groupBy("hash", "text").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    first = staged(texts.filter("last > id").drop("last"), "first")
    a, b = met.alias("a"), first.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b.id") < F.col("a.id")), "left_semi")


def combinations(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): rows of each part by the filters they fail; good and toxic ones by the labels.

    `labels` has the columns `id_col`, quality and toxic.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"),
                     F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # An id may occur with several texts, which hash and length tell apart.
    keys = ["id", "hash", "length", "part"]
    length = F.length("text").alias("length")
    own = with_failures(rows).select("id", "hash", length, "part", "bits", F.lit(1).alias("n"))
    copies = later_copies(rows).select("id", "hash", length, "part", F.lit(COPY).alias("bits"), F.lit(0).alias("n"))
    failed = own.unionByName(copies).groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return failed.join(known, "id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def report(counted: DataFrame) -> DataFrame:
    """What each filter keeps, removes and loses at each step of each order, for each part of `combinations`."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = [(o, k) for o in orders for k in range(len(FILTERS))]
    own = F.lit([_mask(o[k]) for o, k in steps])[F.col("at")]
    earlier = F.lit([_mask(o[:k]) for o, k in steps])[F.col("at")]
    met = counted.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).withColumns({"own": own, "earlier": earlier})
    fails, before = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("earlier")) != 0
    # Of the filters that a document fails, each comes first in equally many orders.
    share = F.expr(f"n * ({len(orders)} div greatest(bit_count(bits), 1))")

    def total(condition: Column, of: Column) -> Column:
        return F.sum(F.when(condition, of).otherwise(0)).cast("long")

    n = F.col("n")
    return met.groupBy("part", "at").agg(
        total(~fails & ~before, n).alias("kept"), total(fails & ~before, n).alias("removed"),
        total(fails & before, n).alias("redundant"), total(F.col("bits") == F.col("own"), n).alias("unique_fails"),
        total(fails & ~before, F.col("good")).alias("good_lost"), total(fails & ~before, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley")).select(
        "part", F.lit(orders)[F.expr(f"at div {len(FILTERS)}").cast("int")].alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).alias("step"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _mask(filters: str) -> int:
    return sum(1 << FILTERS.index(f) for f in filters)
