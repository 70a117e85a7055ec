"""Multi-key blocking: an equi-join on (country, key type, key) with priority-ordered top-K.

A candidate's priority is (key type rank, key's place, target's row order), the least over all keys
it shares with the entity; the K least stay.  A probe needs at most K distinct ids of a posting list,
so every list is cut to its first K distinct ids before the join: the join makes at most K rows per
key and no list is ever paired with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text
from tessera.storage import stash

# Word lists and limits that results depend on.
GENERIC_WORDS = (
    "services", "solutions", "technologies", "enterprises", "consultants",
    "consulting", "international", "management", "industries", "associates",
    "holdings", "restaurant", "clinic", "hospital", "center", "centre",
    "hotel", "traders", "trading", "agency", "corp", "limited", "private",
    "global", "products", "systems", "group", "india", "american",
)
ADDRESS_WORDS = ("road", "street", "avenue", "lane", "drive", "court", "place", "square", "highway", "floor", "apartment", "suite", "number", "phase", "sector", "office", "nr", "near")
KEY_TYPES = ("unspaced", "exact", "sorted_tok", "compound_postal", "compound_addr", "addr_num_city", "prefix2", "acronym", "tok", "soundex")
BUCKET_CAP = 300
UNCAPPED = 3  # the first three key types have no cap
# End of fixed values.
PART_STEP = 1000  # places of a name's parts
BLOCK_ROWS = 1 << 16  # targets in a block of a list without a cap


def _generic(t: Column) -> Column:
    return t.isin(*GENERIC_WORDS)


def block_keys(entities: DataFrame) -> DataFrame:
    """(id, ord, country, key_rank, key_ord, key): the keys of each entity, repeats kept."""
    e = entities.select("id", "ord", "country", "postal_code", "house_num", "norm_addr", F.posexplode_outer(text.name_parts(F.col("norm_name"))).alias("part_no", "part"))
    e = e.withColumns({"part_no": F.coalesce("part_no", F.lit(0)), "base": text.base_name(F.col("part")), "all_toks": text.tokens(F.col("part"))})
    base_toks = text.tokens(F.col("base"))
    e = e.withColumn("toks", F.when(F.size(base_toks) >= 2, base_toks).otherwise(F.col("all_toks")))
    e = e.withColumn("addr", F.filter(text.tokens(F.col("norm_addr")), lambda t: (F.length(t) >= 4) & ~t.isin(*ADDRESS_WORDS)))
    toks, part, base, house = F.col("toks"), F.col("part"), F.col("base"), F.col("house_num")
    place = F.col("part_no") * PART_STEP
    named, two = part.isNotNull(), F.coalesce(F.size("toks") >= 2, F.lit(False))
    first, second = F.try_element_at(toks, F.lit(1)), F.try_element_at(toks, F.lit(2))
    special = F.filter(toks, lambda t: ~_generic(t))

    def entry(rank: str, ord_: int, key: Column, holds: Column) -> Column:
        return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(KEY_TYPES.index(rank)).alias("r"), (place + ord_).cast("int").alias("o"), key.alias("k")))

    def glued(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit(""))

    def sorted_join(c: Column, n: int, by: str) -> Column:
        return F.array_join(F.array_sort(F.slice(c, 1, n)), by)

    letters = F.array_join(F.transform(F.filter(toks, lambda t: t.rlike("^[a-z]")), lambda t: F.substring(t, 1, 1)), "")
    once = F.col("part_no") == 0
    fixed = F.array(
        entry("unspaced", 0, glued(part), named & (F.length(glued(part)) >= 4)),
        entry("unspaced", 1, glued(base), named & (F.length(glued(base)) >= 4) & (glued(base) != glued(part))),
        entry("unspaced", 2, sorted_join(toks, 3, ""), two & (F.length(sorted_join(toks, 3, "")) >= 4)),
        entry("exact", 0, part, named),
        entry("exact", 1, base, named & (base != "") & (base != part)),
        entry("sorted_tok", 0, sorted_join(special, 4, "_"), two & (F.size(special) >= 2)),
        entry("sorted_tok", 1, sorted_join(toks, 4, "_"), two),
        entry("compound_postal", 0, F.concat_ws("_", first, "postal_code"), named & (F.col("postal_code") != "")),
        entry("compound_addr", 0, F.concat_ws("_", first, house), named & (F.length(house) >= 2)),
        entry("addr_num_city", 0, F.concat_ws("_", house, F.try_element_at("addr", F.lit(-1))), once & (house != "") & (F.size("addr") >= 1)),
        entry("addr_num_city", 1, F.concat_ws("_", house, F.try_element_at("addr", F.lit(1))), once & (house != "") & (F.size("addr") >= 2)),
        entry("prefix2", 0, F.concat_ws("_", first, second), two),
        entry("acronym", 0, letters, (F.size(toks) >= 3) & (F.length(letters) >= 3)),
        entry("acronym", 0, first, (F.size(toks) == 1) & (F.length(first) <= 5) & first.rlike("^[a-z]+$")),
        entry("soundex", 0, sim.soundex(first), (F.length(first) >= 3) & ~_generic(first) & first.rlike("^[a-z]+$")),
    )
    single = F.transform(
        F.filter(F.transform(F.coalesce(toks, F.array().cast("array<string>")), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (F.length(x["t"]) >= 4) & ~_generic(x["t"])),
        lambda x: F.struct(F.lit(KEY_TYPES.index("tok")).alias("r"), (place + x["i"]).cast("int").alias("o"), x["t"].alias("k")),
    )
    keys = F.concat(F.filter(fixed, lambda x: x.isNotNull()), single)
    return e.select("id", "ord", "country", F.explode(keys).alias("e")).select("id", "ord", "country", F.col("e.r").alias("key_rank"), F.col("e.o").alias("key_ord"), F.col("e.k").alias("key"))


_KEY = ["country", "key_rank", "key"]


def posting_lists(keys: DataFrame) -> DataFrame:
    """(country, key_rank, key, pos, t_id, t_ord): every key's targets in row order; capped types keep their first ``BUCKET_CAP`` entries.

    Capped lists are cut by a rank filter that Spark applies before the shuffle.  Lists without a cap
    are numbered in blocks of row order, so a key that many targets share is never one group: blocks
    are counted, their counts summed, and entries ranked within their block.
    """
    by = Window.partitionBy(*_KEY)
    capped = keys.where(F.col("key_rank") >= UNCAPPED).withColumn("pos", F.row_number().over(by.orderBy("ord", "key_ord"))).where(F.col("pos") <= BUCKET_CAP)
    whole = keys.where(F.col("key_rank") < UNCAPPED).withColumn("block", F.floor(F.col("ord") / BLOCK_ROWS))
    before = F.coalesce(F.sum("n").over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = whole.groupBy(*_KEY, "block").agg(F.count(F.lit(1)).alias("n")).select(*_KEY, "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*_KEY, "block").orderBy("ord", "key_ord"))
    whole = whole.withColumn("pos", within).join(blocks, [*_KEY, "block"]).withColumn("pos", F.col("pos") + F.col("before"))
    return reduce(DataFrame.union, (x.select(*_KEY, F.col("pos").cast("long").alias("pos"), F.col("id").alias("t_id"), F.col("ord").alias("t_ord")) for x in (capped, whole)))


def short_lists(keys: DataFrame, k: int) -> DataFrame:
    """The first k distinct targets of each posting list; the rank filters keep only that many rows per key and task before the shuffle."""
    by = Window.partitionBy(*_KEY)
    capped = keys.where(F.col("key_rank") >= UNCAPPED).withColumn("pos", F.row_number().over(by.orderBy("ord", "key_ord"))).where(F.col("pos") <= BUCKET_CAP)
    both = capped.select(*_KEY, "id", "ord").union(keys.where(F.col("key_rank") < UNCAPPED).select(*_KEY, "id", "ord")).repartition(*_KEY)
    both = both.groupBy(*_KEY, "id").agg(F.min("ord").alias("ord"))
    return both.withColumn("n", F.row_number().over(by.orderBy("ord", "id"))).where(F.col("n") <= k).select(*_KEY, F.col("id").alias("t_id"), F.col("ord").alias("t_ord"))


def candidates(probe_keys: DataFrame, target_keys: DataFrame, k: int = 35) -> DataFrame:
    """(s1_id, t_id, cand_rank): at most k candidates of each entity in priority order, from 1.

    A list with k targets fills an entity's places by itself, so no key after the first such list can
    give one more.  Probes therefore meet the numbers and sizes of lists first, and the lists
    themselves, a row each, only as far as that first full one.
    """
    entries = F.array_sort(F.collect_list(F.struct("t_ord", "t_id")))
    lists = stash(short_lists(target_keys, k).groupBy(*_KEY).agg(entries.alias("l")).withColumn("list", F.monotonically_increasing_id()), "lists")
    pri = F.struct("key_rank", "key_ord")
    probes = probe_keys.select(*_KEY, F.col("id").alias("s1_id"), "key_ord").join(lists.select(*_KEY, "list", (F.size("l") >= k).alias("full")), _KEY)
    probes = probes.select("s1_id", "list", "key_rank", "key_ord", "full")
    full = F.min(F.when(F.col("full"), pri)).over(Window.partitionBy("s1_id"))
    useful = probes.withColumn("last", full).where(F.col("last").isNull() | (pri <= F.col("last"))).select("s1_id", "list", "key_rank", "key_ord")
    met = stash(useful, "useful").join(lists.select("list", "l"), "list").select("s1_id", "key_rank", "key_ord", "l").repartition("s1_id")
    met = met.select("s1_id", "key_rank", "key_ord", F.explode("l").alias("e")).select("s1_id", F.col("e.t_id").alias("t_id"), F.struct("key_rank", "key_ord", F.col("e.t_ord").alias("t_ord")).alias("pri"))
    best = met.groupBy("s1_id", "t_id").agg(F.min("pri").alias("pri"))
    w = Window.partitionBy("s1_id").orderBy("pri", "t_id")
    return best.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= k).select("s1_id", "t_id", "cand_rank")
