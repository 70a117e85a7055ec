"""Entities as the later operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text


def normalized(records: DataFrame) -> DataFrame:
    """(id, ord, country, norm_name, base_name, norm_addr, postal_code, house_num, addr_nums) of entity rows."""
    out = records.select(
        F.col("entity_id").alias("id"), "ord", text.normalize_country(F.col("country")).alias("country"), text.normalize_name(F.col("business_name")).alias("norm_name"), *(c.alias(n) for n, c in text.normalize_address(F.col("business_address")).items())
    )
    return out.withColumn("base_name", text.base_name(F.col("norm_name")))


def prepared(entities: DataFrame) -> DataFrame:
    """Normalized entities with the token lists and codes that pair features read, made once per entity."""
    first = F.coalesce(F.try_element_at("toks", F.lit(1)), F.lit(""))
    out = entities.withColumns({"toks": text.tokens(F.col("norm_name")), "base_toks": text.tokens(F.col("base_name")), "addr_toks": text.tokens(F.col("norm_addr"))})
    street = F.try_element_at(F.filter("addr_toks", lambda t: t.rlike("^[a-z]{3,}$")), F.lit(1))
    return out.withColumns(
        {
            "first_tok": first,
            "first_sx": F.when(F.length(first) >= 3, sim.soundex(first)).otherwise(""),
            "street_sx": F.when(street.isNotNull(), sim.soundex(street)),
            "nums": sim.numbers(F.col("norm_name")),
            "a_nums": sim.numbers(F.col("norm_addr")),
            "grams": sim.grams3(F.col("norm_name")),
            "a_grams": sim.grams3(F.col("norm_addr")),
        }
    )
