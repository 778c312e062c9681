"""Links of files to metadata records by equality first and by parts of names then.

Which texts hold a pattern is asked of an inverted index: texts are exploded into their
q-grams, a pattern meets only the texts that hold its rarest one, and each candidate is
verified. Patterns and texts are distinct, and a text holds at most as many patterns as it has
substrings, so that the links found grow with the texts; the postings of a common q-gram are
dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.staging import materialised

#: Postings of a q-gram that one task takes.
POSTINGS = 20_000


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text; none where it is shorter."""
    n = F.length(text) - (q - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame, q: int = 3) -> DataFrame:
    """(pattern, text) of the distinct non-empty patterns (pattern) and the distinct texts (text) that hold them.

    A pattern shorter than ``q`` is looked up whole, among the texts' shorter q-grams.
    """
    patterns = materialised(patterns.where("pattern <> ''").select("pattern").distinct())
    texts = materialised(texts.where("text <> ''").select("text").distinct())
    of = [F.transform(grams(F.col("text"), k), lambda g: g) for k in range(1, q + 1)]
    index = materialised(texts.select("text", F.explode(F.concat(*of)).alias("gram")))
    wanted = patterns.select("pattern", F.explode(F.when(F.length("pattern") < q, F.array("pattern")).otherwise(grams(F.col("pattern"), q))).alias("gram"))
    # a gram that no text has is the rarest: its pattern is nowhere
    sizes = materialised(index.groupBy("gram").agg(F.count("*").alias("n")))
    rarest = wanted.join(sizes, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    asked = materialised(rarest.select("pattern", "r.gram", "r.n").where("n > 0"))
    deals = F.ceil(F.col("n") / POSTINGS).cast("int")
    used = asked.select("gram", deals.alias("deals")).distinct()
    postings = index.join(used, "gram").select("gram", "text", F.pmod(F.xxhash64("text"), F.col("deals")).cast("int").alias("deal"))
    every = asked.select("gram", "pattern", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    return every.join(postings, ["gram", "deal"]).where(F.contains("text", "pattern")).select("pattern", "text")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def id_part(name: Column) -> Column:
    """A file's name without its picture extensions, wherever they stand."""
    for extension in (".png", ".jpg", ".jpeg"):
        name = F.replace(name, F.lit(extension), F.lit(""))
    return name


def linked(files: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """A row for each of ``files`` (key, path): key, strategy, and the columns of the record that it is linked to.

    ``records`` has ord, path, unique_id and more. Strategies in turn, of several records the
    lowest ``ord``: 1 the same path; 2 the same file name; 3 the file's name without its
    extension is part of the record's id; 4 one of the first two parts between underscores of
    the record's file name is part of the file's name. 0 is the default record: the file's
    own name as id, all else null. An empty part is part of every name; null paths and ids
    match nothing.
    """
    names = materialised(files.select(key, "path", name_of(F.col("path")).alias("name")).withColumn("part", id_part(F.col("name"))))
    records = materialised(records.withColumn("name", name_of(F.col("path"))))
    least = lambda df, *by: df.groupBy(*by).agg(F.min("ord").alias("ord"))
    found = None
    for no, column in ((1, "path"), (2, "name")):
        # one record of each value, so that a common one meets its files once
        here = names.join(least(records.select(column, "ord"), column), column).select(key, F.lit(no).alias("strategy"), "ord")
        found = here if found is None else found.unionByName(here)
    found = materialised(found)
    left = materialised(names.join(found.select(key), key, "left_anti"))

    ids = least(records.where("unique_id is not null and unique_id <> ''").select(F.col("unique_id").alias("text"), "ord"), "text")
    by_part = least(containing(left.select(F.col("part").alias("pattern")), ids).join(ids, "text"), F.col("pattern").alias("part"))
    anything = ids.agg(F.min("ord").alias("ord")).where("ord is not null").select(F.lit("").alias("part"), "ord")
    third = materialised(left.join(by_part.unionByName(anything), "part").select(key, F.lit(3).alias("strategy"), "ord"))
    left = materialised(left.join(third.select(key), key, "left_anti"))

    tokens = records.where("name is not null").select(F.explode(F.slice(F.split("name", "_"), 1, 2)).alias("pattern"), "ord")
    tokens = materialised(least(tokens, "pattern"))
    by_name = least(containing(tokens, left.select(F.col("name").alias("text"))).join(tokens, "pattern"), F.col("text").alias("name"))
    everywhere = tokens.where("pattern = ''").select("ord").first()
    fourth = left.join(by_name, "name").select(key, F.lit(4).alias("strategy"), "ord")
    if everywhere:
        fourth = fourth.unionByName(left.where("name is not null").select(key, F.lit(4).alias("strategy"), F.lit(everywhere[0]).cast(dict(tokens.dtypes)["ord"]).alias("ord")))

    best = found.unionByName(third).unionByName(fourth).groupBy(key).agg(F.min(F.struct("strategy", "ord")).alias("b"))
    rows = names.select(key, "part").join(best, key, "left").select(key, "part", F.coalesce("b.strategy", F.lit(0)).alias("strategy"), "b.ord")
    joined = rows.join(records.drop("name", "path"), "ord", "left")
    default = F.when(F.col("strategy") == 0, F.col("part")).otherwise(F.col("unique_id"))
    return joined.withColumn("unique_id", default).drop("part")
