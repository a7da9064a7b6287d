"""Turns and conversations: runs, transcripts and their pieces, digests, dates and the ledger of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import conversation_date
from ..functions.text import strip
from ..sources.scratch import materialize

ROLES = ("user", "assistant")
#: Characters of a transcript in a prompt, of a style sample in one, and nodes in a chunk.
TRANSCRIPT_CHARS, STYLE_CHARS, RESOLVE_CHUNK, MERGE_CHUNK = 12_000, 8_000, 40, 20
#: Episodes that a model groups at once.
GROUP_CHUNK = 200
#: Notes on a user's style that a model sums up at once.
STYLE_CHUNK = 10
#: What stands between messages of a style sample.
BETWEEN = "\n---\n"
MAX_CHARS = 2**31 - 1


def spoken(turns: DataFrame) -> DataFrame:
    """Turns of users and assistants with text."""
    return turns.where(F.col("role").isin(*ROLES) & (strip("content") != ""))


def runs(turns: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Turns with ``run_id``: neighbours of one conversation are one run, and one that comes again is another.

    ``scope`` names columns of independent inputs, as files; each is ordered in one task.  Without it turns are dealt by
    ranges of ``src_ord``: runs are counted within ranges, and one row for each range says how many runs came before and whether
    its first turn goes on with the last run.
    """
    if scope:
        order = Window.partitionBy(*scope).orderBy("src_ord")
        change = F.when(F.lag("conv_id").over(order).eqNullSafe(F.col("conv_id")), 0).otherwise(1)
        total = F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return turns.withColumn("__change", change.cast("long")).withColumn("run_id", total).drop("__change")
    dealt = turns.repartitionByRange("src_ord").sortWithinPartitions("src_ord")
    placed = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "runs").withColumn("__range", F.shiftright("__at", 33))
    inside = Window.partitionBy("__range").orderBy("__at")
    same = F.lag("conv_id").over(inside) == F.col("conv_id")
    placed = placed.withColumn("__change", F.when(F.coalesce(same, F.row_number().over(inside) == 1), 0).otherwise(1).cast("long"))
    ranges = placed.groupBy("__range").agg(F.min_by("conv_id", "__at").alias("first"), F.max_by("conv_id", "__at").alias("last"), F.sum("__change").alias("n"))
    along = Window.orderBy("__range")
    opens = F.when(F.lag("last").over(along) == F.col("first"), 0).otherwise(1)
    ranges = ranges.withColumn("opens", opens).withColumn("before", F.sum(F.col("n") + F.col("opens")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    counted = placed.withColumn("__inside", F.sum("__change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = counted.join(ranges.select("__range", "before"), "__range")
    return out.withColumn("run_id", F.col("before") + F.col("__inside")).select(*turns.columns, "run_id")


def joined(line: Column, order: Column, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("s"))))
    return F.array_join(F.transform(rows, lambda x: x["s"]), sep)


def conversations(turns: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row for each conversation or run.

    ``n_turns``, ``transcript`` (numbered lines), ``digest`` (over roles and contents), ``conv_date`` (of the
    first turn with a readable time), ``refs`` (ids of its turns) and ``conv_ord``.
    """
    order = F.col("src_ord")
    line = F.concat(F.lit("["), "turn_id", F.lit("] "), "role", F.lit(": "), "content")
    day = conversation_date("ts")
    dated = F.when(day.isNotNull(), order)
    refs = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("turn_id").alias("s")))), lambda x: x["s"])
    return turns.groupBy(*keys).agg(
        F.count("*").alias("n_turns"),
        joined(line, order, "\n").alias("transcript"),
        F.sha2(joined(F.concat("role", F.lit(":"), "content"), order, "\n"), 256).alias("digest"),
        F.min_by(day, dated).alias("conv_date"),
        refs.alias("refs"),
        F.min("src_ord").alias("conv_ord"),
    )


def segments(rows: DataFrame, text: str, most: Column) -> DataFrame:
    """Rows with ``seg``: a ``text`` of more than ``most`` characters goes on in further rows, which have every character of it between them.

    It is divided behind white space, where ``most`` characters have any.
    """
    cut = F.concat(F.lit("(?s).{1,"), (most - 1).cast("string"), F.lit(r"}(?:\s|\z)|.{1,"), most.cast("string"), F.lit("}"))
    parts = F.when(F.length(text) > most, F.regexp_extract_all(F.col(text), cut, F.lit(0))).otherwise(F.array(text))
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(parts).alias("seg", text))


def pieces(turns: DataFrame, convs: DataFrame, cap: int = TRANSCRIPT_CHARS, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Conversations in pieces that a prompt can hold: ``convs`` with ``piece``, whose ``transcript`` has at most ``cap`` characters, and whose ``refs`` are its turns.

    The pieces of a conversation have all of its turns between them; one that fits is one piece.  A longer one is divided between turns, three quarters of
    ``cap`` apart.  A turn of more than a quarter may go on in the next piece, with its id and role again.
    """
    fits = F.length("transcript") <= cap
    whole, long = convs.where(fits).withColumn("piece", F.lit(0).cast("long")), convs.where(~fits)
    head = F.concat(F.lit("["), "turn_id", F.lit("] "), "role", F.lit(": "))
    said = turns.join(long.select(*keys), list(keys), "left_semi").select(*keys, "src_ord", "turn_id", head.alias("head"), "content")
    rows = segments(said, "content", F.greatest(F.lit(cap // 4 - 1) - F.coalesce(F.length("head"), F.lit(0)), F.lit(cap // 8)))
    order = Window.partitionBy(*keys).orderBy("src_ord", "seg")
    size = F.coalesce(F.length("head") + F.length("content") + 1, F.lit(0)).cast("long")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("piece", F.floor(start / (cap - cap // 4)).cast("long"))
    rows = rows.withColumn("opens", (F.col("seg") == 0) | (F.lag("piece").over(order) != F.col("piece")))
    line = F.concat(F.when(F.col("opens"), F.concat(F.lit("\n"), "head")).otherwise(""), "content")
    listed = F.array_sort(F.collect_list(F.struct("src_ord", "seg", "opens", "turn_id", line.alias("s"))))
    made = rows.groupBy(*keys, "piece").agg(listed.alias("rows")).select(
        *keys, "piece", F.array_join(F.transform("rows", lambda x: x["s"]), "").alias("joined"),
        F.transform(F.filter("rows", lambda x: x["opens"]), lambda x: x["turn_id"]).alias("refs"),
    )
    divided = long.drop("transcript", "refs").join(made, list(keys)).withColumn("transcript", F.substring("joined", 2, MAX_CHARS))
    return whole.unionByName(divided.select(*whole.columns))


def fresh(convs: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Conversations that the ledger doesn't have with the same content."""
    return convs if force else convs.join(ledger.select("conv_id", "digest"), ["conv_id", "digest"], "left_anti")


def updated_ledger(ledger: DataFrame, convs: DataFrame) -> DataFrame:
    """The ledger with the last digest of each conversation read."""
    both = ledger.select("conv_id", "digest", F.lit(-1).cast("long").alias("o")).unionByName(convs.select("conv_id", "digest", F.col("conv_ord").alias("o")))
    return both.groupBy("conv_id").agg(F.max_by("digest", "o").alias("digest"))


def style_sample(turns: DataFrame, convs: DataFrame, cap: int = STYLE_CHARS, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row ``sample``: what users wrote, conversation by conversation, while less than ``cap`` characters were gathered before.

    Only the first conversations can matter: those before which less than ``cap`` characters lie.  Each with user
    turns has one at least, so of those ``cap`` conversations at most are gathered.
    """
    user = turns.where("role = 'user'").join(convs.select(*keys, "conv_ord"), list(keys))
    per = user.groupBy(*keys, "conv_ord").agg(F.sum(F.length("content")).alias("n"))
    # conversations of no characters add nothing to the sum
    head = per.where("n > 0").orderBy("conv_ord").limit(cap)
    before = F.sum("n").over(Window.orderBy("conv_ord").rowsBetween(Window.unboundedPreceding, -1))
    last = head.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).agg(F.max("conv_ord").alias("last_ord"))
    first = user.join(F.broadcast(last), F.col("conv_ord") <= F.col("last_ord")).orderBy("conv_ord", "src_ord").limit(2 * cap)
    return first.agg(F.substring(joined(F.col("content"), F.struct("conv_ord", "src_ord"), BETWEEN), 1, cap).alias("sample"))


def style_samples(turns: DataFrame, convs: DataFrame, cap: int = STYLE_CHARS, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``pos, sample``: all that users wrote, conversation by conversation, in samples of at most ``cap`` characters.

    What fits is one sample.  More is divided between messages, three quarters of ``cap`` apart; a message of more than a quarter may go on in the next sample.
    """
    user = turns.where("role = 'user'").join(convs.select(*keys, "conv_ord"), list(keys)).select("conv_ord", "src_ord", "content")
    rows = segments(user, "content", F.lit(cap // 4 - len(BETWEEN)))
    rows = offsets(rows.where("content is not null"), ("conv_ord", "src_ord", "seg"), (F.length("content") + len(BETWEEN)).cast("long"))
    opens = F.col("seg") == 0
    total = rows.agg(F.sum(F.length("content") + F.when(opens, len(BETWEEN)).otherwise(0))).first()[0] or 0
    pos = F.lit(0) if total - len(BETWEEN) <= cap else F.floor(F.col("start") / (cap - cap // 4))
    line = F.concat(F.when(opens, BETWEEN).otherwise(""), "content")
    made = rows.groupBy(pos.cast("long").alias("pos")).agg(joined(line, F.struct("conv_ord", "src_ord", "seg"), "").alias("s"), F.min_by("seg", F.struct("conv_ord", "src_ord", "seg")).alias("seg"))
    return made.select("pos", F.when(opens, F.substring("s", len(BETWEEN) + 1, MAX_CHARS)).otherwise(F.col("s")).alias("sample"))


def offsets(rows: DataFrame, order: tuple[str, ...], size: Column) -> DataFrame:
    """Rows with ``start``, the sum of ``size`` over all rows before; counted like positions, within ranges and for ranges, so no task holds all rows."""
    dealt = rows.withColumn("__size", size).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "offsets").withColumn("__range", F.shiftright("__at", 33))

    def before(name: str, w) -> Column:
        return F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = dealt.groupBy("__range").agg(F.sum("__size").alias("__n")).withColumn("__before", before("__n", Window.orderBy("__range")))
    inside = dealt.withColumn("__inside", before("__size", Window.partitionBy("__range").orderBy("__at")))
    return inside.join(ranges, "__range").withColumn("start", F.col("__before") + F.col("__inside")).select(*rows.columns, "start")


def top_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    by = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")
