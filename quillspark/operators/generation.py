"""Tasks and texts for generated corpora: categories, lengths and slot templates, all drawn by hash.

Every draw comes from SHA-256 of a seed and the row's id, so reruns agree on any cluster and with
SQL.  Lists and the table of lengths have bounded sizes; nothing else is held anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions import text as tx
from quillspark.operators.sampling import drawn, order_key
from quillspark.session import absent


def length_cdf(texts: DataFrame, body: str, lo: int = lx.TASK_WORDS[0], hi: int = lx.TASK_WORDS[1]) -> DataFrame:
    """One row: total, and cdf, the running counts of the texts' lengths in words, kept within lo and hi; texts without words don't count.

    As many lengths as the bounds allow are all that leaves the counting.
    """
    words = tx.space_word_count(tx.nonnull(F.col(body)))
    n = texts.select(words.alias("w")).where("w > 0").groupBy(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("w"))).alias("words")).count()
    pairs = F.sort_array(F.collect_list(F.struct("words", "count")))

    def add(acc: Column, x: Column) -> Column:
        total = acc["total"] + x["count"]
        return F.struct(total.alias("total"), F.concat(acc["cdf"], F.array(F.struct(total.alias("upto"), x["words"].cast("long").alias("words")))).alias("cdf"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<upto:bigint,words:bigint>>").alias("cdf"))
    return n.groupBy().agg(F.aggregate(pairs, start, add).alias("r")).select("r.total", "r.cdf")


#: Lengths where no text is known.
DEFAULT_WORDS = (70, 90, 110, 130, 160, 200)


def with_length(df: DataFrame, key: str, cdf: DataFrame, seed: str = "words") -> DataFrame:
    """Adds words: a length drawn from the distribution of length_cdf by the inverse of its running counts, or from DEFAULT_WORDS where it is empty."""
    total, table = absent(df, "cdf_total", "cdf_table")
    h = F.conv(F.substring(order_key(seed, key), 1, 12), 16, 10).cast("long")
    d = df.crossJoin(F.broadcast(cdf.select(F.col("total").alias(total), F.col("cdf").alias(table))))  # one row
    place = h % F.col(total)
    found = F.get(F.filter(F.col(table), lambda x: place < x["upto"]), F.lit(0))["words"]
    return d.withColumn("words", F.when(F.col(total) > 0, found).otherwise(drawn(key, seed, list(DEFAULT_WORDS)).cast("long"))).drop(total, table)


def tasks(ids: DataFrame, key: str, cdf: DataFrame) -> DataFrame:
    """key, topic, style, role, recipient, detail, format, words: one of each list, and a length, for each id."""
    lists = [drawn(key, name, list(options)).alias(name) for name, options in lx.TASK_LISTS.items()]
    return with_length(ids.select(key, *lists), key, cdf)


def in_rounds(options: Sequence[str], place: Column, seed: str) -> Column:
    """The option for a place (0 and up): each round goes through the whole list once, in an order of its own by hash, so none comes twice before all came."""
    n = F.lit(len(options))
    round_ = F.floor(place / n).cast("string")
    order = F.array_sort(F.transform(F.array(*map(F.lit, options)), lambda o: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), round_, o), 256).alias("h"), o.alias("o"))))
    return F.get(order, (place % n).cast("int"))["o"]


def expanded(ids: DataFrame, key: str, templates: dict[str, Sequence[str]], slots: dict[str, Sequence[str]], seed: str = "template") -> DataFrame:
    """key, kind, text: ids, counted from 0, take the kinds of template in turn; the templates of a kind and the values of each slot come in rounds.

    A slot stands as its name in braces, and has one value in a text, however often it stands there.
    """
    kinds = list(templates)
    k, i = F.col(key) % len(kinds), F.floor(F.col(key) / len(kinds))
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, name in enumerate(kinds):
        kind = F.when(k == n, name).otherwise(kind)
        text = F.when(k == n, in_rounds(templates[name], i, f"{seed}-{name}")).otherwise(text)
    d = ids.select(key, kind.alias("kind"), text.alias("text"))
    for name, values in slots.items():
        d = d.withColumn("text", F.replace("text", F.lit(f"{{{name}}}"), in_rounds(values, F.col(key), f"{seed}-{name}")))
    return d
