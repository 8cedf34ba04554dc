"""Chat formatting: a multi-party dialogue seen from each participant in turn.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a message, and what stands for one inside a text.
OPEN, CLOSE, BROKEN = "<|im_start|>", "<|im_end|>", "<\\|im_"


def _marked(head: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), head, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each dialogue once for each participant: conv, speaker, n_turns, rendered, masks.

    Participants are the roles of the dialogue but "system"; a null role is the
    participant "unknown".  In a rendering the speaker's turns are the
    assistant's, other participants' are a user's with their name, and system
    turns stay what they are.  masks are the [begin, end) character spans, in
    order, of what the assistant says with its end mark: the text to train on.
    Turns go by turn, a null one first, then role and text, so ties and
    repeated rows have a fixed place; a null text is empty, and marks inside a
    text are broken up.  Rows with a null dialogue id belong to no dialogue and
    are left out, as are dialogues with system turns alone.  Other columns are
    left out.  An empty table gives no rows.

    Turns meet the participants by a join on the dialogue, and offsets are a
    running sum over the dialogue: a dialogue has to fit a task, as its
    rendering has to fit a row.
    """
    turns = df.select(
        F.col(f"`{conv}`").alias("__conv"), F.col(f"`{turn}`").alias("__turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("__role"),
        F.replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit("<|im_"), F.lit(BROKEN)).alias("__text"),
    ).where("__conv IS NOT NULL")
    speakers = turns.where("__role <> 'system'").select("__conv", F.col("__role").alias("speaker")).distinct()
    own = F.col("__role") == F.col("speaker")
    head = F.when(F.col("__role") == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "__role"))
    seen = turns.join(speakers, "__conv").withColumn("__part", _marked(head, F.col("__text")))
    order = Window.partitionBy("__conv", "speaker").orderBy("__turn", "__role", "__text")
    seen = seen.withColumn("__no", F.row_number().over(order)).withColumn("__end", F.sum(F.length("__part")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.when(own, F.struct((F.col("__end") - 1 - F.length(F.lit(CLOSE)) - F.length("__text")).alias("begin"), (F.col("__end") - 1).alias("end")))
    return seen.groupBy("__conv", "speaker").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__no", "__part"))), lambda x: x["__part"]), "").alias("rendered"),
        F.array_sort(F.collect_list(span)).alias("masks"),
    ).withColumnRenamed("__conv", conv)
