"""Registers to memory map: by the longest section that holds both, else by instance name. Both are equi-joins.

A register's section is exploded into its dotted ancestors, a map name into the peripherals that it may be an instance
of, so neither join compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

#: Fixed value: how an instance's name goes on after its peripheral's.
SUFFIX = r"^(?:\d{1,2}|[A-K]|_[A-Z0-9]+)$"


def ancestors(section: Column) -> Column:
    """"3.2.1" gives 3, 3.2 and 3.2.1."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def stems(name: Column) -> Column:
    """All proper prefixes of a map name whose rest is an instance's suffix."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda n: F.substr(name, n + 1).rlike(SUFFIX))
    return F.transform(cuts, lambda n: F.substr(name, F.lit(1), n))


def stem_of(peripheral: Column) -> Column:
    """A trailing x stands for the instance's letter or number."""
    return F.upper(F.when(peripheral.endswith("x") & (F.length(peripheral) > 2), F.expr("substr(peripheral, 1, length(peripheral) - 1)")).otherwise(peripheral))


def instances(registers: DataFrame, memmap: DataFrame) -> DataFrame:
    """rid, name, base: map entries that a register's peripheral names; the exact name shadows the others."""
    own = registers.select("doc_id", "rid", "peripheral", stem_of(F.col("peripheral")).alias("stem"))
    exact = own.join(memmap.select("doc_id", F.col("name").alias("peripheral"), F.col("name").alias("entry"), "base", "section", "source"), ["doc_id", "peripheral"]).select("doc_id", "rid", "entry", "base", "section", "source", F.lit(0).alias("tier"))
    loose = own.join(memmap.select("doc_id", "name", "base", "section", "source", F.explode(stems(F.col("name"))).alias("stem")), ["doc_id", "stem"]).select("doc_id", "rid", F.col("name").alias("entry"), "base", "section", "source", F.lit(1).alias("tier"))
    return exact.unionByName(loose)


def link(registers: DataFrame, memmap: DataFrame) -> DataFrame:
    """registers (with a unique rid in each document) with bases, address, and linked."""
    known = registers.select("doc_id", "rid", "section").withColumn("anc", F.explode(ancestors(F.col("section"))))
    texts = memmap.where("source = 'text' AND section <> ''").select("doc_id", F.col("section").alias("anc"), F.col("name").alias("entry"), "base")
    near = known.join(texts.select("doc_id", "anc").distinct(), ["doc_id", "anc"])
    best = near.groupBy("doc_id", "rid").agg(F.max_by("anc", F.length("anc")).alias("anc"))
    named = instances(registers, memmap)
    lowest = Window.partitionBy("doc_id", "rid")
    # in the register's own section: that peripheral's instances, or else all of the section's entries
    there = best.join(texts, ["doc_id", "anc"])
    mine = there.join(named.where("source = 'text'").select("doc_id", "rid", "entry", "tier", F.col("section").alias("anc")), ["doc_id", "rid", "entry", "anc"], "left")
    mine = mine.withColumn("tier", F.coalesce("tier", F.lit(2))).withColumn("__low", F.min("tier").over(lowest)).where("tier = __low").select("doc_id", "rid", "entry", "base")
    # elsewhere: the peripheral's name anywhere in the map
    others = named.join(best.select("doc_id", "rid"), ["doc_id", "rid"], "left_anti")
    others = others.withColumn("__low", F.min("tier").over(lowest)).where("tier = __low").select("doc_id", "rid", "entry", "base")
    every = mine.unionByName(others).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("entry", "base"))).alias("__es"))
    df = registers.join(every, ["doc_id", "rid"], "left")
    offset = X.hex_value(F.col("offset"))
    linked = F.col("__es").isNotNull() & offset.isNotNull()
    computed = F.when(linked & (F.size("__es") == 1), X.to_hex(X.hex_value(F.element_at("__es", 1)["base"]) + offset, 8))
    return df.withColumns({"bases": F.when(linked, F.map_from_entries("__es")), "address": F.coalesce("address", computed), "linked": F.coalesce(linked, F.lit(False))}).drop("__es")


def instance_addresses(linked: DataFrame) -> DataFrame:
    """One row for each instance of a linked register, with its absolute address."""
    return linked.where("linked").select("doc_id", "rid", "name", "offset", F.explode("bases").alias("instance", "base")).withColumn("address", X.to_hex(X.hex_value(F.col("base")) + X.hex_value(F.col("offset")), 8))
