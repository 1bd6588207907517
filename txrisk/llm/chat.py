"""Chat formatting: logged snapshots of growing conversations are collapsed, what is left is rendered.

A logger that writes a conversation after each turn leaves many prefixes of the same conversation.
Every turn gets the hash of all turns up to it (turn-prefix hash, 128 bits): the exclusive or of hashes
of (position, role, text), so prefixes can be summed in parts. A conversation goes if its whole hash
and length are those of a proper prefix of another one (anti-join); of equal conversations the one
with the least id stays. The others, the maximal ones, are rendered.

Long conversations are never gathered. Turns are numbered by a range partitioning of the distinct turns with the
counts of earlier ranges, and summed in blocks of ``BLOCK`` positions, so rows
that share an id or a turn number (null ids are one conversation) are spread like others. Every conversation
is rendered in parts by one rule: a part ends where a block of ``BLOCK`` positions ends, or where the bytes before a turn
pass a multiple of ``ROW_BYTES``, so a part holds at most ``BLOCK`` turns and ``ROW_BYTES`` bytes beside its last turn. ``part`` is
the number of the conversation's turns before it. Only hashes are sorted and summed; texts move for conversations that stay.

Turns are in order of (turn, hash of role and text), null turn numbers first. A repeated row (equal id,
turn, role and text) counts once. Rows with a null conversation id are one conversation with a null
id, which is the greatest id. An empty table gives no rows; other columns are not read. Null role and text differ from empty ones but are rendered as empty.
Markers inside a text are broken up, so a text cannot end its own turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import wide_hash, written

BLOCK = 1024
ROW_BYTES = 1 << 27
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _content(role: Column, text: Column) -> Column:
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("0"))
    return wide_hash(F.concat(F.octet_length(mark(role)).cast("string"), mark(role), mark(text)))


def ranged_turns(turns: DataFrame) -> DataFrame:
    """The distinct turns of (conv_id, turn, c, size), dealt by range: the later of two turns of a
    conversation is in the same ``range`` or a later one. Distinct keys make even ranges."""
    once = turns.groupBy("conv_id", "turn", "c").agg(F.first("size").alias("size"))
    dealt = once.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("c"))
    return written(dealt.withColumn("range", F.spark_partition_id()), "chat-ranges")


def numbered(ranged: DataFrame) -> DataFrame:
    """(conv_id, turn, c, k, n, block, bytes): each turn is the ``k``-th of the ``n`` of its conversation, in the
    ``block`` of ``BLOCK`` positions, after so many ``bytes``."""
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("turns"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), earlier("turns").alias("start"),
                          earlier("bytes").alias("first"), F.sum("turns").over(Window.partitionBy("conv_id")).alias("n"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "c")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("rank", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(upto) - F.col("size"))
    placed = ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    k = F.col("start") + F.col("rank")
    return placed.select("conv_id", "turn", "c", k.alias("k"), "n", F.floor((k - 1) / BLOCK).alias("block"),
                         (F.col("first") + F.col("upto")).alias("bytes"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """From :func:`numbered`: (conv_id, k, x, y, n): the hash (x, y) of the first ``k`` turns of each
    conversation, for every k, and its number of turns."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    hashed = written(placed.select("conv_id", "block", "k", "n", F.xxhash64("k", "c").alias("hx"),
                                   F.xxhash64(F.lit("y"), "c", "k").alias("hy")), "chat-turns")
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    earlier = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
                          *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(o) for s, o in (("bx", "px"), ("by", "py"))])
    running = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "block", "k", "n", F.bit_xor("hx").over(running).alias("rx"), F.bit_xor("hy").over(running).alias("ry"))
    return rolled.join(earlier, at).select("conv_id", "k", "n", F.col("rx").bitwiseXOR(F.col("px")).alias("x"),
                                           F.col("ry").bitwiseXOR(F.col("py")).alias("y"))


def maximal(placed: DataFrame) -> DataFrame:
    """From :func:`numbered`: (conv_id, n, copies) of the conversations that are no proper prefix of another; ``copies`` counts
    the conversations equal to it."""
    hashes = written(prefix_hashes(placed), "chat-prefixes")
    whole = hashes.filter(F.col("k") == F.col("n")).groupBy("n", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = hashes.filter(F.col("k") < F.col("n")).select(F.col("k").alias("n"), "x", "y").distinct()
    return whole.join(proper, ["n", "x", "y"], "left_anti").select("conv_id", "n", "copies")


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(conv_id, part, n_turns, copies, text) of every maximal conversation of ``df``."""
    pick = lambda c, name: F.col(f"`{c}`").alias(name)
    rows = df.select(pick(id_col, "conv_id"), pick(turn_col, "turn"), pick(role_col, "role"), pick(text_col, "text"))
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    shown = F.concat(F.lit(OPEN), plain(F.col("role")), F.lit("\n"), plain(F.col("text")), F.lit(CLOSE), F.lit("\n"))
    rows = rows.withColumn("c", _content(F.col("role"), F.col("text"))).withColumn("shown", shown)
    placed = written(numbered(ranged_turns(rows.select("conv_id", "turn", "c", F.octet_length("shown").cast("long").alias("size")))), "chat-placed")
    kept = written(maximal(placed), "chat-kept").select(F.col("conv_id").alias("_c"), "copies")
    # where the turns of the conversations that stay belong; the texts then meet them by turn, not by conversation
    to = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        F.col("conv_id").alias("_i"), F.col("turn").alias("_t"), F.col("c").alias("_h"), "k", "copies", "block",
        F.floor(F.col("bytes") / row_bytes).alias("piece"))
    same = F.col("conv_id").eqNullSafe(F.col("_i")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("c") == F.col("_h"))
    parts = rows.join(to, same).groupBy("conv_id", "copies", "block", "piece").agg(
        F.sort_array(F.collect_set(F.struct("k", "shown"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: t["shown"]), "")
    return parts.select("conv_id", (F.get("ts", F.lit(0))["k"] - 1).alias("part"), F.size("ts").cast("long").alias("n_turns"), "copies",
                        text.alias("text"))
