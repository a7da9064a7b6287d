"""From chat history to memory: candidates, resolution, merging, hierarchy and style.

The model only proposes; its replies become tables of candidates, pairs and groups, and the operators apply
them.  Each round of model calls is written before it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_or_null, resolve_relative_dates
from ..functions.text import clamp, flat, parse_json, sortable_id, strip
from ..operators import gate as G
from ..operators import history as H
from ..operators import merge as M
from ..operators.ids import allocated
from ..schema import GRANULARITIES, NODES, PARTS, absent
from ..sources.packs import Pack
from . import prompts
from .models import Adapter, complete_all


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _string_field(item: Column, name: str) -> Column:
    """The field if it is a string, else null."""
    v = _field(item, name, "variant")
    return F.when(_is_string(v), _field(item, name, "string"))


def candidates(replies: DataFrame, now: Column) -> DataFrame:
    """Nodes of model replies: ``conv_id, conv_ord, transcript, conv_date, refs, reply`` of each conversation, or of each ``piece`` of one.

    A reply that is no JSON object gives none; an item without text, or with values that no node may have, is left out.
    Nodes are ordered by conversation, part, piece and place in the reply, whatever these numbers are; so are their ids.
    """
    parsed = replies.withColumn("__v", parse_json("reply")).withColumn("piece", F.col("piece") if "piece" in replies.columns else F.lit(0))
    items = None
    for k, part in enumerate(PARTS):
        listed = F.try_variant_get("__v", f"$.{part}", "array<variant>")
        rows = parsed.select("conv_id", "conv_ord", "piece", "transcript", "conv_date", "refs", F.lit(part).alias("part"), F.lit(k).alias("part_ord"), F.posexplode(listed).alias("at", "item"))
        items = rows if items is None else items.unionByName(rows)
    item = F.col("item")
    base = F.col("conv_date")
    quote = _string_field(item, "quote")
    kept_quote = F.when((strip(quote) != "") & F.contains(flat("transcript"), flat(quote)), strip(quote))
    number = F.when(_field(item, "salience", "variant").isNull(), F.lit(0.5)).otherwise(_field(item, "salience", "double"))
    grain = F.when(_field(item, "granularity", "variant").isNull(), F.lit("episode")).otherwise(_field(item, "granularity", "string"))
    tags = F.when(_field(item, "tags", "variant").isNull(), F.array().cast("array<string>")).otherwise(_field(item, "tags", "array<string>"))
    nodes = items.where(F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))).select(
        "conv_id", "conv_ord", "piece", "part", "part_ord", "at",
        resolve_relative_dates(_field(item, "text", "string"), base).alias("text"),
        grain.alias("granularity"), clamp(number).alias("salience"),
        F.when(_field(item, "confidence", "string") == "inferred", "inferred").otherwise("stated").alias("confidence"),
        now.alias("created_at"), now.alias("last_confirmed_at"),
        F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("parent_id"),
        iso_or_null(_string_field(item, "valid_from")).alias("valid_from"), iso_or_null(_string_field(item, "valid_until")).alias("valid_until"),
        resolve_relative_dates(kept_quote, base).alias("quote"), F.col("refs").alias("source_refs"), tags.alias("tags"), number.alias("__number"),
    )
    valid = F.col("text").isNotNull() & F.col("granularity").isin(*GRANULARITIES) & F.col("__number").isNotNull() & F.col("tags").isNotNull()
    out = allocated(nodes.where(valid), ("conv_ord", "part_ord", "piece", "at"), now, ("conv_id", "part", "at", "text"), place="ord")
    return out.select(*NODES.fieldNames())


def proposed_pairs(replies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, pair_ord, i, j`` from replies with duplicates and contradictions; what is no pair of numbers is left out."""
    parsed = replies.withColumn("__v", parse_json("reply"))
    out = None
    for kind, name in (("duplicate", "duplicates"), ("contradiction", "contradictions")):
        pairs = parsed.select(*keys, F.lit(kind).alias("kind"), F.posexplode(F.try_variant_get("__v", f"$.{name}", "array<variant>")).alias("pair_ord", "p"))
        numbers = pairs.withColumn("n", F.try_variant_get("p", "$", "array<bigint>")).where("size(n) = 2")
        # whole numbers only
        numbers = numbers.withColumn("d", F.try_variant_get("p", "$", "array<double>")).where("n[0] = d[0] and n[1] = d[1]")
        rows = numbers.select(*keys, "kind", F.col("pair_ord").cast("long"), F.col("n")[0].alias("i"), F.col("n")[1].alias("j"))
        out = rows if out is None else out.unionByName(rows)
    return out


def proposed_groups(replies: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, group_ord, summary, members`` from replies."""
    listed = replies.select(*keys, F.posexplode(F.try_variant_get(parse_json("reply"), "$.groups", "array<variant>")).alias("group_ord", "g"))
    members = F.filter(F.try_variant_get("g", "$.members", "array<bigint>"), lambda i: i >= 0)
    return listed.select(*keys, "group_ord", F.try_variant_get("g", "$.summary", "string").alias("summary"), members.alias("members"))


def _numbered(order: Column, place: Column, text: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(place.cast("string"), F.lit(". "), text).alias("s"))))
    return F.array_join(F.transform(rows, lambda x: x["s"]), "\n")


@dataclass
class Extraction:
    """One run over a history.  ``scratch`` is a folder that all executors share."""

    spark: SparkSession
    adapter: Adapter
    scratch: str
    concurrency: int | None = None
    #: Standing nodes of a part up to which the gate lists all of them; in a larger part those that may meet the chunk.
    whole_list: int = 400
    group_chunk: int = H.GROUP_CHUNK
    #: Describe the style from the first ``STYLE_CHARS`` characters that users wrote, and not from all.
    style_head: bool = False
    _step: int = 0

    def _write(self, df: DataFrame) -> DataFrame:
        self._step += 1
        path = f"{self.scratch}/{self._step:04d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _ask(self, rows: DataFrame, template: str, **fields: Column) -> DataFrame:
        """Fill a template from columns and complete it for every row."""
        before, prompt = template.replace("{{", "\x01").replace("}}", "\x02"), []
        for piece in _split_fields(before):
            known = piece[1:-1] if piece[:1] == "{" else None
            prompt.append(fields[known] if known in fields else F.lit(piece.replace("\x01", "{").replace("\x02", "}")))
        asked = rows.withColumns({"prompt": F.concat(*prompt), "system": F.lit(prompts.SYSTEM)})
        self._step += 1
        return complete_all(asked, self.adapter, f"{self.scratch}/{self._step:04d}", True, self.concurrency, f"{self.scratch}/calls")

    def proposals(self, convs: DataFrame) -> DataFrame:
        """``convs``, or pieces of them, with the model's ``reply`` to the whole transcript of each."""
        date = F.coalesce(F.date_format("conv_date", "yyyy-MM-dd"), F.lit("unknown"))
        return self._ask(convs, prompts.EXTRACT, conv_id=F.col("conv_id"), conv_date=date, transcript=F.col("transcript"))

    def resolve(self, nodes: DataFrame) -> DataFrame:
        """Chunks of nodes of one part each go to the model; its pairs are applied."""
        numbered = self._write(M.number(nodes, H.RESOLVE_CHUNK))
        chunks = numbered.groupBy("part", "chunk").agg(_numbered(F.col("pos"), F.col("pos"), F.col("text")).alias("numbered"))
        replies = self._ask(chunks, prompts.RESOLVE, numbered=F.col("numbered"))
        return self._write(M.apply_resolution(numbered, proposed_pairs(replies, ["part", "chunk"])).select(*NODES.fieldNames()))

    def merge(self, base: DataFrame, new: DataFrame) -> DataFrame:
        """New nodes go through the gate in chunks, each against all that stands by then.

        That order is part of the meaning, but a chunk's prompt depends on the earlier ones only in the nodes that it lists.  So many chunks are asked at once (``_settled``),
        as if those before them added all that they have, and asked again where what the others did changes a prompt, until none changes.  A
        window of chunks begins with as many as the adapter takes in a task and doubles while that goes well, so calls that were in vain stay a bounded share.
        Nodes keep their positions, so a window writes what it changed or added, and not the memory.  Of a part with more than ``whole_list`` nodes
        a prompt lists those that may meet the chunk (``gate.meeting``), so no prompt grows with the memory.  A part of which nothing stands takes what is new as it is.
        """
        chunks = self._write(M.number(new, H.MERGE_CHUNK))
        last = chunks.agg(F.max("chunk")).first()[0]
        first = self._write(M.number(base))
        sizes = {r["part"]: r["n"] for r in first.groupBy("part").agg(F.count("*").alias("n")).collect()}
        top = first.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        chunks = chunks.withColumn("ord", F.col("chunk") * H.MERGE_CHUNK + F.col("pos") + top)
        gated = F.col("part").isin(list(sizes))
        at, changed = ["part", "pos"], first.limit(0)
        last = chunks.where(gated).agg(F.max("chunk")).first()[0] if last is not None else None
        index = self._write(G.word_index(first.where(gated).select("part", "pos", "text"))) if last is not None else None

        def standing() -> DataFrame:
            return first.join(changed.select(*at), at, "left_anti").unionByName(changed)

        begin, ahead = 0, max(1, getattr(self.adapter, "per_task", 1))
        while last is not None and begin <= last:
            window = chunks.where(gated & F.col("chunk").between(begin, begin + ahead - 1))
            now = standing()
            old_words = index.join(changed.select(*at), at, "left_anti").unionByName(G.word_index(changed.select("part", "pos", "text")))
            pairs, held, rounds = self._settled(now, old_words, window, sizes, ahead > 1)
            both = now.unionByName(held.select(*now.columns))
            touched = both.join(pairs.select("part", F.col("i").alias("pos")).distinct(), at, "left_semi")
            fresh = window.withColumn("pos", F.col("chunk") * H.MERGE_CHUNK + F.col("pos")).select(*now.columns)
            merged = self._write(M.merged_and_added(touched, fresh, pairs)[0])
            added = held.select(*now.columns).join(merged.select(*at), at, "left_anti")
            changed = self._write(changed.join(merged.select(*at), at, "left_anti").unionByName(merged).unionByName(added))
            for r in held.groupBy("part").agg(F.count("*").alias("n")).collect():
                sizes[r["part"]] += r["n"]
            begin += ahead
            ahead = 2 * ahead if rounds < 3 else max(1, ahead // 2)
        free = chunks.where(~gated) if sizes else chunks
        return self._write(standing().select(*NODES.fieldNames()).unionByName(free.select(*NODES.fieldNames())))

    def _settled(self, now: DataFrame, old_words: DataFrame, window: DataFrame, sizes: dict[str, int], several: bool) -> tuple[DataFrame, DataFrame, int]:
        """The pairs of a window's chunks when each is asked against what the ones before it left, its nodes that are added (with ``pos``), and the rounds that took.

        Pairs have positions ``i``, and ``j`` counted over all chunks.  The first chunk's prompt is right at once, and each round sets right one chunk more at least.
        """
        at, none = ["part", "pos"], F.lit(G.ALWAYS).cast("long")
        size = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in sizes.items()]).cast("long")
        fresh = window.groupBy("part", "chunk").agg(_numbered(F.col("pos"), F.col("pos"), F.col("text")).alias("new"))
        base = now.select(*at, "text", F.lit(-1).cast("long").alias("since"))

        def places(taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            """``part, chunk, before``: how many nodes stand before each chunk; and the nodes that are added."""
            kept = window if taken is None else window.join(taken, ["part", "chunk", "pos"], "left_anti")
            counts = window.groupBy("part", "chunk").agg(F.lit(0).alias("n")).unionByName(kept.groupBy("part", "chunk").agg(F.count("*").alias("n")))
            so_far = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            starts = counts.groupBy("part", "chunk").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)) + size).drop("n")
            starts = self._write(starts)
            inside = F.row_number().over(Window.partitionBy("part", "chunk").orderBy("__j")) - 1
            held = kept.withColumnRenamed("pos", "__j").join(starts, ["part", "chunk"]).withColumn("pos", F.col("before") + inside).drop("before", "__j")
            return starts, self._write(held)

        (starts, held), moves, seen, pairs, rounds = places(None), None, None, None, 0
        while True:
            nodes = base.unionByName(held.select(*at, "text", F.col("chunk").alias("since")))
            held_words = G.word_index(held.select(*at, "text", F.col("chunk").alias("since")))
            words = old_words.withColumn("since", F.lit(-1).cast("long")).unionByName(held_words)
            if moves is None:
                nodes, words = (x.withColumns({"until": none, "moved": F.lit(False)}) for x in (nodes, words))
            else:
                ends = moves.groupBy(*at).agg(F.min("since").alias("ends"))
                nodes, words = (x.join(ends, at, "left").select(*x.columns, F.coalesce("ends", none).alias("until"), F.col("ends").isNotNull().alias("moved")) for x in (nodes, words))
                later = moves.withColumn("moved", F.lit(True))
                nodes, words = nodes.unionByName(later), words.unionByName(G.word_index(later))
            small = starts.where(F.col("before") <= self.whole_list)
            listed = nodes.where(F.col("pos") < self.whole_list).join(small.drop("before"), "part").where(G.stands())
            listed = listed.select("part", "chunk", "pos", "text")
            large = starts.where(F.col("before") > self.whole_list).drop("before")
            if not large.isEmpty():
                may = G.meeting(words, window.join(large, ["part", "chunk"], "left_semi"))
                listed = listed.unionByName(nodes.join(may, at).where(G.stands()).select("part", "chunk", "pos", "text"))
            old = listed.groupBy("part", "chunk").agg(_numbered(F.col("pos"), F.col("pos"), F.col("text")).alias("existing"))
            asked = self._write(old.join(fresh, ["part", "chunk"]))
            stamp = tuple(asked.agg(F.count("*"), F.sum(F.xxhash64("part", "chunk", "existing").cast("decimal(38,0)"))).first())
            if stamp == seen:
                return pairs, held, rounds
            seen, rounds = stamp, rounds + 1
            replies = self._ask(asked, prompts.MERGE, existing=F.col("existing"), new=F.col("new"))
            proposed = self._write(proposed_pairs(replies, ["part", "chunk"]))
            order = F.col("chunk") * (1 << 31) + F.col("pair_ord")
            there = window.select("part", "chunk", F.col("pos").alias("j"))
            # whether a pair's standing node is there depends on what the chunks before folded, if it is none of the base
            depends, was = not proposed.where(F.col("i") >= size).isEmpty(), None
            while True:
                met = proposed.join(starts, ["part", "chunk"]).where((F.col("i") >= 0) & (F.col("i") < F.col("before"))).join(there, ["part", "chunk", "j"])
                met = self._write(met.select("part", "chunk", "kind", order.alias("pair_ord"), "i", "j"))
                folds = met.where("kind = 'duplicate'")
                starts, held = places(folds.select("part", "chunk", F.col("j").alias("pos")).distinct())
                got = tuple(starts.agg(F.sum(F.xxhash64("part", "chunk", "before").cast("decimal(38,0)"))).first())
                if not depends or got == was:
                    break
                was = got
            pairs = met.withColumn("j", F.col("chunk") * H.MERGE_CHUNK + F.col("j"))
            if not several:
                return pairs, held, rounds
            moves = None if folds.isEmpty() else self._write(self._moves(base, held, folds, window))
            if moves is not None and moves.isEmpty():
                moves = None

    def _moves(self, base: DataFrame, held: DataFrame, folds: DataFrame, window: DataFrame) -> DataFrame:
        """``part, pos, text, since, until``: texts that nodes take from what is folded into them, by chunk."""
        at = ["part", "pos"]
        one = F.row_number().over(Window.partitionBy("part", "chunk", "j").orderBy("pair_ord"))
        folds = folds.withColumn("__n", one).where("__n = 1")
        texts = folds.join(window.select("part", "chunk", F.col("pos").alias("j"), "text"), ["part", "chunk", "j"])
        rows = texts.select("part", F.col("i").alias("pos"), F.col("chunk").alias("since"), "pair_ord", "text")
        own = base.select(*at, F.lit(-1).cast("long").alias("since"), F.lit(-1).cast("long").alias("pair_ord"), "text").unionByName(held.select(*at, "chunk", F.lit(-1).cast("long").alias("pair_ord"), "text").withColumnRenamed("chunk", "since"))
        rows = rows.unionByName(own.join(rows.select(*at).distinct(), at, "left_semi"))
        by = Window.partitionBy(*at).orderBy("since", "pair_ord")
        best = F.max(F.struct(F.length("text").alias("n"), (-F.col("pair_ord")).alias("o"), F.col("text").alias("t"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.select(*at, "since", "pair_ord", best["t"].alias("text"))
        rows = rows.groupBy(*at, "since").agg(F.max_by("text", "pair_ord").alias("text"), F.min("pair_ord").alias("first"))
        chunk = Window.partitionBy(*at).orderBy("since")
        rows = rows.withColumn("same", F.lag("text").over(chunk) == F.col("text")).where("first >= 0 and not same")
        return rows.select(*at, "text", "since", F.coalesce(F.lead("since").over(chunk), F.lit(G.ALWAYS)).cast("long").alias("until"))

    def hierarchy(self, episodes: DataFrame, now: Column) -> DataFrame:
        """Groups of episodes get a summary above them; fewer than four stay as they are.

        A model groups at most ``group_chunk`` at once, neighbours by ``ord``.  Where that took several chunks, their summaries are
        grouped in the same way, and so on until one chunk holds a level: a prompt never grows with the memory.
        """
        if episodes.limit(4).count() < 4:
            return episodes
        done, level = None, 0
        while True:
            loose = self._write(M.number(episodes, self.group_chunk))
            listed = loose.groupBy("chunk").agg(_numbered(F.col("pos"), F.col("pos"), F.col("text")).alias("numbered"))
            replies = self._ask(listed, prompts.HIERARCHY, numbered=F.col("numbered"))
            groups = M.placed(proposed_groups(replies, ("chunk",)).withColumn("all", F.lit(level)), ("all",), ("chunk", "group_ord"), M.WHOLE).drop("all")
            # behind the places of the run's other nodes
            place = F.lit((1 << 44) + (level << 38)) + F.col("pos")
            groups = self._write(groups.withColumn("id", sortable_id(F.unix_millis(now), place, F.lit(self.scratch), "summary")))
            parents, children = M.attach_groups(loose, groups.drop("pos"), ("chunk",))
            heads = parents.join(groups.select("chunk", "group_ord", "pos"), ["chunk", "group_ord"]).select(
                F.lit("episodes").alias("part"), (F.col("pos") - (1 << 39) + (level << 32)).cast("long").alias("ord"), "id", "text", F.lit("summary").alias("granularity"), "salience",
                F.lit("stated").alias("confidence"), now.alias("created_at"), now.alias("last_confirmed_at"), "source_refs", F.array().cast("array<string>").alias("tags"),
            )
            heads = self._write(loose.limit(0).select(*NODES.fieldNames()).unionByName(heads, allowMissingColumns=True))
            children = self._write(children.select(*NODES.fieldNames()))
            done = children if done is None else done.unionByName(children)
            chunks = listed.count()
            if chunks < 2 or heads.limit(2).count() < 2 or heads.count() >= loose.count():
                return done.unionByName(heads)
            episodes, level = heads, level + 1

    def style(self, samples: DataFrame) -> str:
        """How the user writes, from all samples (``pos, sample``); empty if none has text.

        The model notes it for each sample, and sums up the notes of neighbours, ``STYLE_CHUNK`` at most at once, until one is left: a prompt never grows with the history.
        """
        rows, template = self._write(samples.where("sample != ''")), prompts.STYLE
        if rows.isEmpty():
            return ""
        while True:
            self._step += 1
            before, after = template.split("{messages}")
            asked = rows.select("pos", F.concat(F.lit(before), "sample", F.lit(after)).alias("prompt"))
            replies = complete_all(asked, self.adapter, f"{self.scratch}/{self._step:04d}", concurrency=self.concurrency, log=f"{self.scratch}/calls")
            notes = replies.select(F.lit(0).alias("all"), F.col("pos").alias("at"), strip("reply").alias("s")).where("s != ''")
            notes = self._write(M.placed(notes, ("all",), ("at",), M.WHOLE))
            n = notes.count()
            if n < 2:
                return notes.first()["s"] if n else ""
            chunks = -(-n // H.STYLE_CHUNK)
            rows = notes.groupBy(F.floor(F.col("pos") * chunks / n).cast("long").alias("pos")).agg(H.joined(F.col("s"), F.col("at"), H.BETWEEN).alias("sample"))
            template = prompts.STYLE_MERGE

    def run(self, turns: DataFrame, base: Pack | None = None, source_model: str | None = None, force: bool = False, run_ts: str | None = None) -> Pack:
        """Distil turns into memory, and merge it into ``base``.

        Conversations that the base has with the same content are skipped without a model call, unless ``force``.
        """
        base = base or Pack.empty(self.spark)
        now = F.lit(run_ts or datetime.now(UTC).isoformat()).cast("timestamp")
        keys = ("conv_id", "run_id")
        placed = self._write(H.runs(turns))
        convs = self._write(H.fresh(H.conversations(placed, keys), base.ledger, force))
        ledger = self._write(H.updated_ledger(base.ledger, convs))

        read = self._write(H.pieces(placed, convs, keys=keys))
        fresh = self.resolve(M.dedup_exact(candidates(self.proposals(read), now)))

        dead = base.nodes.where(~absent(F.col("superseded_by")))
        live = base.nodes.where(absent(F.col("superseded_by")))
        top = live.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        both = live.withColumn("__old", F.lit(True)).unionByName(fresh.withColumns({"ord": F.col("ord") + top, "__old": F.lit(False)}))
        combined = self._write(M.dedup_exact(both))
        merged = self.merge(combined.where("__old").select(*NODES.fieldNames()), combined.where("not __old").select(*NODES.fieldNames()))

        grouped = M.groupable()
        episodes = self.hierarchy(merged.where(grouped), now)
        ahead = dead.select(*NODES.fieldNames()).withColumn("ord", F.col("ord") - (1 << 40))
        nodes = ahead.unionByName(merged.where(~grouped)).unionByName(episodes)
        nodes = M.number(nodes).withColumn("ord", F.col("pos")).select(*NODES.fieldNames())

        sample = H.style_sample(placed, convs, keys=keys).withColumn("pos", F.lit(0).cast("long")) if self.style_head else H.style_samples(placed, convs, keys=keys)
        style = self.style(sample) or base.style
        models = list(dict.fromkeys([*base.source_models, source_model or self.adapter.model]))
        return Pack(self._write(nodes), style, ledger, models, base.created_at)


def _split_fields(template: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{[a-z_]+\})", template) if x]


def run_eval(nodes: DataFrame, styles: DataFrame, questions: DataFrame, adapter: Adapter, path: str, budget: int = 2000, scoped: bool = False, today: str | None = None) -> DataFrame:
    """Answer each question from the memory's block and judge it: ``q_ord, question, answer, passed, category``.

    ``scoped`` builds a block for each question, with the facts that are relevant to it first.
    """
    from ..operators.context import build_context, build_scoped
    from ..operators.recall import judge

    if scoped:
        asked = questions.join(build_scoped(nodes, styles, questions, budget, today).select("q_ord", "context"), "q_ord")
    else:
        block = build_context(nodes, styles, budget, today=today, keys=())
        asked = questions.crossJoin(F.broadcast(block.select("context")))
    asked = asked.select("q_ord", "question", "expected", "category", F.col("question").alias("prompt"), F.concat("context", F.lit(prompts.ANSWER_SUFFIX)).alias("system"))
    answers = complete_all(asked, adapter, path).withColumnRenamed("reply", "answer")
    return judge(answers).select("q_ord", "question", "answer", "passed", F.coalesce("category", F.lit("")).alias("category"))


def extract_history(spark: SparkSession, path: str, adapter: Adapter, scratch: str, base: Pack | None = None, read: Callable | None = None, **options) -> Pack:
    """Read a history and distil it."""
    from ..sources.history import read_history

    return Extraction(spark, adapter, scratch).run((read or read_history)(spark, path), base, **options)
