"""Episodes and stored runs: what was asked, what was disclosed, and what judges said of each turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import shapes

MESSAGE = "struct<role:string,content:string>"


def stored_conversations(payloads: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """sample_id, messages: what was sent, from raw request payloads; of several payloads the last path counts.

    A batch holds a conversation for each of its sample_ids, in their order; a
    payload of one sample may hold its messages alone.  Others, and what is not
    JSON, are passed over.  An absent role is `user`, absent content empty.
    """
    asked = F.get_json_object(body, "$.request")
    rows = payloads.select(F.col(path).alias("__path"), F.from_json(F.get_json_object(asked, "$.sample_ids"), "array<string>").alias("ids"), F.get_json_object(asked, "$.messages").alias("said"))
    n, held = F.size("ids"), F.coalesce(F.json_array_length("said"), F.lit(0))
    each = F.from_json("said", "array<string>")  # elements as JSON text
    whole = F.when((n == held) & (n > 0), each).when(n == 1, F.array("said"))
    one = rows.select("__path", F.posexplode(F.arrays_zip(F.col("ids"), whole.alias("talks"))).alias("__at", "z")).select("__path", "__at", F.col("z.ids").alias("sample_id"), F.col("z.talks").alias("talk"))
    messages = F.transform(F.from_json("talk", f"array<{MESSAGE}>"), lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    kept = one.where(F.startswith(F.trim("talk"), F.lit("["))).withColumn("messages", F.coalesce(messages, F.array().cast(f"array<{MESSAGE}>")))
    return kept.groupBy("sample_id").agg(F.max_by("messages", F.struct("__path", "__at")).alias("messages"))


def synthetic_grid(cells: DataFrame, per_cell: int, seed: str) -> DataFrame:
    """recover, hops, index, item_seed: a row for each item that a generator makes of a cell (recover, hops), with its own seed.

    A seed depends on its cell and index alone, so a larger grid begins with
    the same items.  Cells that are given twice count once.
    """
    rows = cells.select("recover", "hops").distinct().select("recover", "hops", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))).alias("index"))
    return rows.withColumn("item_seed", F.left(F.sha2(F.concat_ws("::", F.lit(seed), "recover", F.col("hops").cast("string"), F.col("index").cast("string")), 256), F.lit(16)))


def parent_key(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(".")), F.left(key, F.length(key) - F.length(F.substring_index(key, ".", -1)) - 1)).otherwise(key)


def disclosed(asks: DataFrame, case: DataFrame, episode: str = "episode", turn: str = "turn", limit: int = 6) -> DataFrame:
    """episode, turn, shown, fresh, n_revealed: what each turn disclosed, and how much of the case is known by then.

    asks: episode, turn, category, keys (the keys of the case that a request
    was resolved to, in order); case: episode, category, key.  A request shows
    the findings of its first `limit` parents: of each the key itself and its
    direct children.  `fresh` counts keys that no earlier turn had shown.  Keys
    that the case doesn't hold show nothing, and turns that show nothing stay.
    """
    case_rows = case.select(F.col(episode).alias("__e"), F.col("category").alias("__c"), "key")
    # a key is found under its parent, and under its own name
    finding = case_rows.select("__e", "__c", "key", F.explode(F.array_distinct(F.array("key", parent_key(F.col("key"))))).alias("__p"), F.lit(None).cast(asks.schema[turn].dataType).alias("__t"), F.lit(None).cast("int").alias("__at"), F.lit(True).alias("__held"))
    wanted = asks.select(F.col(episode).alias("__e"), F.col(turn).alias("__t"), F.col("category").alias("__c"), F.posexplode_outer("keys").alias("__at", "key"))
    wanted = wanted.select("__e", "__c", "key", parent_key(F.col("key")).alias("__p"), "__t", "__at", F.lit(False).alias("__held"))
    # one exchange: an episode's rows meet in one task, and every step sorts them there
    met = finding.unionByName(wanted).repartition("__e")
    children = F.collect_set(F.when(F.col("__held"), F.col("key"))).over(Window.partitionBy("__e", "__c", "__p"))
    present = F.coalesce(F.array_contains("__children", F.col("key")), F.lit(False)) & F.col("__e").isNotNull() & F.col("__c").isNotNull() & F.col("__t").isNotNull()
    asked = met.withColumn("__children", children).where(~F.col("__held")).withColumn("__present", present)
    # a turn's requests are one row, and those that show nothing stay
    turns = asked.groupBy("__e", "__t", "__c").agg(F.array_sort(F.collect_list(F.when(F.col("__present"), F.struct("__at", "__p", "__children")))).alias("__asked"))
    turns = turns.withColumn("__first", F.slice(F.array_distinct("__asked.__p"), 1, limit))
    keys = F.flatten(F.transform(F.filter("__asked", lambda x: F.array_contains("__first", x["__p"])), lambda x: x["__children"]))
    shown = turns.select("__e", "__t", "__c", F.explode_outer(F.array_distinct(keys)).alias("key"))
    fresh = F.col("key").isNotNull() & (F.col("__t") == F.min("__t").over(Window.partitionBy("__e", "__c", "key")))
    rows = shown.withColumn("__new", fresh).groupBy("__e", "__t").agg(F.array_sort(F.collect_set("key")).alias("shown"), F.count_if("__new").alias("fresh"))
    known = F.sum("fresh").over(Window.partitionBy("__e").orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("n_revealed", known).select(F.col("__e").alias(episode), F.col("__t").alias(turn), "shown", "fresh", "n_revealed")


def turn_verdicts(episodes: DataFrame, verdicts: DataFrame, key: str = "sample_id", predictions: str = "predictions") -> DataFrame:
    """Episodes with turn_correct, turn_matches_final and turn_verdicts_missing, from several verdicts of each.

    verdicts: key, asks (`gold`: is the turn's prediction right, `final`: is it
    the last one's), at (turn from 0), positive.  A turn without a gold verdict
    is not correct; without a final one it goes by its name.  Of two verdicts
    on one question any positive one counts.
    """
    one = verdicts.groupBy(key, "asks", "at").agg(F.max("positive").alias("positive"))
    said = one.groupBy(key).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("asks") == a, F.struct(F.col("at").cast("int"), F.col("positive").cast("int"))))).alias(f"__{a}") for a in ("gold", "final")])
    rows = episodes.join(said, key, "left").withColumns({f"__{a}": F.coalesce(f"__{a}", F.create_map().cast("map<int,int>")) for a in ("gold", "final")})
    p = F.col(predictions)
    correct = F.transform(p, lambda _, i: F.coalesce(F.try_element_at("__gold", i), F.lit(0)))
    named = F.zip_with(shapes.matches_final(p), F.transform(p, lambda _, i: F.struct(F.map_contains_key("__final", i).alias("told"), F.try_element_at("__final", i).alias("v"))), lambda m, f: F.when(f["told"], f["v"]).otherwise(m))
    missing = F.size(F.filter(p, lambda x: x != "")) - F.size("__gold")
    return rows.withColumns({"turn_correct": correct, "turn_matches_final": named, "turn_verdicts_missing": missing}).drop("__gold", "__final")


def hits_frame(df: DataFrame, hits: DataFrame, key: str, columns: list[str], steps: str = "reasoning_steps", most: int = 3, width: int = 160) -> DataFrame:
    """A row for each (filter, key) with the record's columns and the beginnings of its first steps."""
    shown = F.array_join(F.transform(F.slice(F.coalesce(steps, F.array().cast("array<string>")), 1, most), lambda s: F.left(s, F.lit(width))), " | ")
    return hits.select("filter", key).join(df.select(key, *columns, shown.alias("first_steps")), key).select("filter", key, *columns, "first_steps")
