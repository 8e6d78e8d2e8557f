"""Registered domains by a public suffix list: plain rules, wildcards (*.ck) and exceptions (!www.ck), read from a landed list.

A host's suffixes are exploded and meet the rules in one join; the longest rule decides, an exception before all others. Hosts are looked up once each, however
many URLs they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

#: Rules of at most this many bytes are broadcast; more are joined by shuffle.
MAX_BROADCAST_BYTES = 16 << 20


def read_rules(lines: DataFrame, line: str = "value", private: bool = False) -> DataFrame:
    """(suffix, wild, exempt) from the lines (value, at: their place) of a list: comments and blanks dropped, a rule ends at white space; with ``private`` also
    those between the marks of the list's private section."""
    text = F.trim(F.col(line))
    edge = lambda mark: lines.where(text.contains(f"==={mark}")).agg(F.min("at")).first()[0]
    rules = lines.where((text != "") & ~text.startswith("//"))
    if not private and (begin := edge("BEGIN PRIVATE")) is not None:
        end = edge("END PRIVATE")
        rules = rules.where((F.col("at") < begin) | (F.col("at") > (end if end is not None else begin)))
    rule = F.lower(F.regexp_extract(F.col(line), r"^\s*\.?(\S+)", 1))
    return rules.select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("suffix"), rule.startswith("*.").alias("wild"), rule.startswith("!").alias("exempt")).distinct()


def suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, n): how many of its labels are the public suffix by the longest rule; hosts that no rule matches are not in it. hosts: distinct (host)."""
    size = rules.agg(F.sum(F.length("suffix") + 16)).first()[0] or 0
    known = F.broadcast(rules) if size <= MAX_BROADCAST_BYTES else rules
    labels = hosts.where(F.col("host") != "").select("host", F.split("host", r"\.").alias("labels"))
    tails = labels.select("host", F.size("labels").alias("n_labels"), F.posexplode("labels").alias("i", "label"), "labels")
    tails = tails.select("host", "n_labels", (F.col("n_labels") - F.col("i")).alias("n"), F.array_join(F.slice("labels", F.col("i") + 1, F.col("n_labels")), ".").alias("suffix"))
    met = tails.join(known, "suffix")
    # a wildcard takes one label more, if there is one; an exception one less than it names
    taken = F.when(F.col("exempt"), F.col("n") - 1).when(F.col("wild"), F.col("n") + 1).otherwise(F.col("n"))
    fits = met.withColumn("taken", taken).where(F.col("taken") <= F.col("n_labels"))
    return fits.groupBy("host").agg(F.max_by("taken", F.struct("exempt", "taken")).cast("int").alias("n"))


def registered_domains(df: DataFrame, url: Column, rules: DataFrame, out: str = "registered_domain") -> DataFrame:
    """df with the registered domain of each URL: the public suffix and one label more. A host that no rule matches, or that is a suffix itself,
    or an address, stands for itself; a blank URL has ''."""
    with_host = df.withColumn("_host", F.coalesce(U.host(url), F.lit("")))
    found = suffixes(with_host.select(F.col("_host").alias("host")).distinct(), rules)
    labels = F.split("_host", r"\.")
    domain = F.when(F.col("_n") < F.size(labels), F.array_join(F.slice(labels, F.size(labels) - F.col("_n"), F.col("_n") + 1), ".")).otherwise(F.col("_host"))
    return with_host.join(found.select(F.col("host").alias("_host"), F.col("n").alias("_n")), "_host", "left").withColumn(out, domain).drop("_host", "_n")
