"""Names of files, runs and hosts (rows P3, P18-P23, P31)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters left out of names, and the greatest length of a name.
REFUSED = r'[<>:"/\\|?*\x00-\x1F.]'
LONGEST = 255


def sanitised(name: Column, most: int = LONGEST) -> Column:
    """Without characters that file systems refuse, and dots; at most 255 characters."""
    return F.substring(F.regexp_replace(name, REFUSED, ""), 1, most)


def readable(base: str, params: list[str], values: Column, digest: Column) -> Column:
    """Base-k_v-..._hash of the given keys of a map, keys and values without refused characters."""
    pairs = [F.concat(sanitised(F.lit(k)), F.lit("_"), sanitised(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")))) for k in params]
    return F.concat(F.concat_ws("-", F.lit(base), *pairs), F.lit("_"), digest)


def short_hash(text: Column) -> Column:
    """P20 as a column: the first 8 hex digits of the md5."""
    return F.substring(F.md5(text), 1, 8)


def parameters(entries: Column) -> Column:
    """A map of ``k=v`` strings; entries without = are dropped, the last of a key stays."""
    good = F.filter(entries, lambda x: x.contains("="))
    split = F.transform(good, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    last = F.aggregate(
        split,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])),
    )
    return last


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def hosts(spec: Column) -> Column:
    """The names of ``node[01-03,7]``; numbers keep their width.  A name without brackets is itself."""
    head, inner = F.regexp_extract(spec, r"^([^\[]*)\[", 1), F.regexp_extract(spec, r"\[([^\]]*)\]", 1)

    def spread(part: Column) -> Column:
        low, high = F.substring_index(part, "-", 1), F.substring_index(part, "-", -1)
        numbers = F.sequence(low.cast("int"), high.cast("int"))
        return F.transform(numbers, lambda n: F.concat(head, F.lpad(n.cast("string"), F.greatest(F.length(low), F.length(n.cast("string"))), F.lit("0"))))

    return F.when(spec.contains("["), F.flatten(F.transform(F.split(inner, ","), spread))).otherwise(F.array(spec))
