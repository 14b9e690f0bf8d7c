"""Operator 6: chat formatting with budgeted windows, in DataFrame functions only.

A conversation's turns get prefix sums of their tokens. A turn that lies within one cell
of ``span_tokens`` of that axis belongs to the cell's span; a turn that crosses a cell's
edge is a span of its own. So each span is within the budget, unless a single turn is
longer, and the spans follow from the prefix sums alone, without going from one to the
next. A window is a span with the conversation's system turn before it and the turns of
the spans just before, as far back as ``history_tokens`` reach. Those repeated turns are
context: they are left out of the loss, as all but assistant turns are.

The template is ``<|turn|>ROLE\\nTEXT<|end|>\\n``. Inside roles and texts ``&``, ``<``, ``[``
and ``]`` become character references (and line breaks in roles), so no control string
of this or other templates can occur in them; they are undone in the opposite order.

Defined cases: null text and role are empty; a null conv_id is a conversation of its
own; equal turns are ordered by role and text; turns without a number come first;
repeated rows are turns each; an empty table gives only what is added; further columns
are ignored; a very long turn is a window of its own. A conversation's order and prefix
sums, and op6's digest, a hash over the whole of it, take its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN_TOKENS = 512
HISTORY_TOKENS = 256
#: A turn costs its words and signs, and so many tokens for the template.
TURN_TOKENS = 4
TURN, END = "<|turn|>", "<|end|>\n"
# Character references, in the order in which they are put in.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
LINE = ("\n", "&#10;")


def escape(c: Column, line: bool = False) -> Column:
    for raw, coded in ESCAPES + (LINE,) * line:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for raw, coded in reversed((*ESCAPES, LINE)):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def with_probe(turns: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.sql(f"select -1L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '{said}' as text from range(2)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def windows(turns: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, span (in order), formatted, n_context (repeated turns at
    its head), n_turns and loss (array of begin and end in formatted, in code points)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")).cast("long") + TURN_TOKENS)
    t = t.withColumn("at", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("before", F.col("upto") - F.col("tokens"))
    first_cell, last_cell = F.floor(F.col("before") / span_tokens), F.floor((F.col("upto") - 1) / span_tokens)
    # spans are numbered 2 * cell within cells and 2 * cell + 1 for a turn over a cell's end
    t = t.withColumn("span", F.when(first_cell == last_cell, 2 * first_cell).otherwise(2 * first_cell + 1).cast("long"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    system = F.first(F.when(F.col("role") == "system", F.struct("at", "role", "text")), ignorenulls=True).over(running)
    previous = F.lag("span").over(order)
    t = t.withColumn("opens", previous.isNull() | (previous != F.col("span"))).withColumn("system", F.when(F.col("opens"), system))
    t = t.withColumn("nth", F.sum(F.col("opens").cast("long")).over(running))
    t = t.withColumn("body", F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n"), escape(F.col("text")), F.lit(END)))
    # a turn is offered to as many next windows as history can reach over (two spans begin in
    # a cell at most); where it is out of reach it is dropped
    reach = 2 * -(-history_tokens // span_tokens) + 1
    offered = t.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("window", F.col("nth") + F.col("d"))
    span_start = F.min(F.when(F.col("d") == 0, F.col("before"))).over(Window.partitionBy("conv_id", "window"))
    kept = offered.withColumn("from", span_start).where(F.col("from").isNotNull() & ((F.col("d") == 0) | (F.col("from") - F.col("before") <= history_tokens)))
    length = F.length("body")
    item = F.struct("at", (F.col("d") > 0).alias("context"), "role", "body", length.alias("size"))
    w = kept.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(item)).alias("items"), F.max(F.when(F.col("d") == 0, F.col("system"))).alias("system"))
    system_body = F.concat(F.lit(TURN), escape(F.col("system.role"), True), F.lit("\n"), escape(F.col("system.text")), F.lit(END))
    retain = F.col("system").isNotNull() & ~F.exists("items", lambda x: x["at"] == F.col("system.at"))
    head = F.array(F.struct(F.col("system.at").alias("at"), F.lit(True).alias("context"), F.col("system.role").alias("role"), system_body.alias("body"), F.length(system_body).alias("size")))
    w = w.withColumn("items", F.when(retain, F.concat(head, "items")).otherwise(F.col("items")))
    w = w.withColumn("formatted", F.array_join(F.transform("items", lambda x: x["body"]), ""))
    # where each turn ends, by prefix sums within the window
    ends = F.transform(
        "items",
        lambda x, k: F.struct(
            x["context"].alias("context"),
            x["role"].alias("role"),
            x["size"].alias("size"),
            F.aggregate(F.slice("items", F.lit(1), k + 1), F.lit(0), lambda s, y: s + y["size"]).alias("end"),
        ),
    )
    target = F.filter(ends, lambda x: ~x["context"] & (x["role"] == "assistant"))
    begin = len(TURN) + len("assistant\n")
    loss = F.transform(target, lambda x: F.struct((x["end"] - x["size"] + begin).alias("begin"), (x["end"] - len(END)).alias("end")))
    return w.select("conv_id", F.col("window").alias("span"), "formatted", F.size(F.filter("items", lambda x: x["context"])).alias("n_context"), F.size("items").alias("n_turns"), loss.alias("loss"))


def read_back(w: DataFrame) -> DataFrame:
    """Per conversation, from the windows' strings alone: what was said, and what counts for the loss."""
    turns = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    own = F.slice(turns, F.col("n_context") + 1, F.greatest(F.size(turns) - F.col("n_context"), F.lit(0)))
    said = F.transform(own, lambda x: F.concat(unescape(F.substring(x, len(TURN) + 1, 1 << 30)), F.lit("\n")))
    lost = F.transform("loss", lambda x: unescape(F.substr("formatted", x["begin"] + 1, x["end"] - x["begin"])))
    each = w.select("conv_id", "span", F.size(own).alias("n"), F.array_join(said, "").alias("said"), F.array_join(lost, "").alias("lost"), F.length("formatted").alias("size"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "said", "lost"))).alias("all"), F.sum("n").cast("long").alias("n_turns"), F.sum("size").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    lost_all = F.array_join(F.transform("all", lambda x: x["lost"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("all", lambda x: x["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(lost_all).cast("long").alias("loss_chars"),
        F.sha2(lost_all.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(windows(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
