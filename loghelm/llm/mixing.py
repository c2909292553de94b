"""Mixing sources to target weights by drawing blocks of a fixed number of words.

Each source's documents make one stream of words, cut into blocks of
``block_words``. The draws of a source are numbered; draw k takes the block at
place k modulo the number of blocks of a pseudorandom permutation that
belongs to the source and to the epoch k div the number of blocks. All draws of
all sources are dealt to the slots of the output shards by one more
permutation, so a shard's counts by source are a multinomial draw, conditioned
on totals that meet every target: the last draw of a source is cut to the word.
Draws meet the blocks by (source, index), a key with at most four rows on the
draws' side, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghelm.llm.common import drop_scratch, numbered, text_keys, write_scratch
from loghelm.llm.sharding import grid_of, permuted, sides

WEIGHTS = [5, 2, 1]
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_no, source_size, target (words), want (whole words) for rows of (source, size).

    Sources by code point, null last, get the weights in turn and share all words by them. None goes above
    ``most`` times its size; what it leaves is shared by weight among the others, again until none is above.
    That is one water level: targets are the level times the weight, or the cap. The order that finds
    the level has one row for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    numbered_sources = total.withColumn("source_no", F.row_number().over(by_name).cast("long") - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    capped = numbered_sources.withColumn("_cap", F.col("source_size") * most).withColumn("_turn", F.col("_cap") / F.col("_w"))
    before = W.orderBy("_turn", "source_no").rowsBetween(W.unboundedPreceding, -1)
    level = capped.select(
        "*", F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_caps"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_ws"),
        F.sum("source_size").over(W.partitionBy()).alias("_all"), F.sum("_w").over(W.partitionBy()).alias("_allw"))
    here = (F.col("_all") - F.col("_caps")) / (F.col("_allw") - F.col("_ws"))
    reached = F.min(F.when(here <= F.col("_turn"), F.struct("_turn", "source_no", here.alias("level")))).over(W.partitionBy())
    levelled = level.withColumn("_level", reached["level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return levelled.select("source", "source_no", "source_size", target.alias("target"), F.round(target).cast("long").alias("want"))


def _plan(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """Per source with words: its blocks, epochs, and how many draws it makes, first draw number included."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    base = targets.where("source_size > 0 and want > 0").select(
        "source_no", "source_size", "want", n.alias("n_blocks"),
        F.floor(F.col("want") / F.col("source_size")).cast("long").alias("epochs")).withColumn("grid", sides(F.col("n_blocks")))
    rest = F.col("want") - F.col("epochs") * F.col("source_size")
    missing = F.col("n_blocks") * block - F.col("source_size")
    short_at = permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("grid"), _seed(seed, F.col("epochs")), inverse=True)
    with_rest = base.select("*", rest.alias("rest"), missing.alias("missing"), short_at.alias("short_at"))
    late = F.when(F.col("rest") > F.col("short_at") * block, F.col("missing")).otherwise(F.lit(0))
    drawn = F.col("epochs") * F.col("n_blocks") + F.ceil((F.col("rest") + late) / block).cast("long")
    return with_rest.withColumn("draws", F.when(F.col("rest") > 0, drawn).otherwise(F.col("epochs") * F.col("n_blocks"))).withColumn(
        "first_draw", F.coalesce(F.sum("draws").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def _seed(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("source_no"), epoch)


def draw_blocks(targets: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """One row a draw: source_no, index, epoch, take (words from the block's start), shard, slot."""
    spark = targets.sparkSession
    plan_path = write_scratch(_plan(targets, block, seed), "mixing-plan")
    plan = spark.read.parquet(plan_path)
    total = plan.agg(F.sum("draws")).first()[0] or 0
    step = 1 << 12
    ranges = plan.withColumn("_from", F.explode(F.expr(f"sequence(0L, draws - 1, {step}L)")))
    # a fixed number of draws a task, also of a hot source; sizes guessed before the explosion would join them into one
    dealt = ranges.repartition(max(1, -(-total // 100_000)), "source_no", "_from")
    each = dealt.withColumn("_k", F.explode(F.expr(f"sequence(_from, least(_from + {step - 1}, draws - 1))")))
    epoch = F.floor(F.col("_k") / F.col("n_blocks")).cast("long")
    each = each.withColumn("epoch", epoch).withColumn("_j", F.pmod("_k", "n_blocks"))
    each = each.withColumn("index", permuted(F.col("_j"), F.col("n_blocks"), F.col("grid"), _seed(seed, F.col("epoch"))))
    length = F.when(F.col("index") == F.col("n_blocks") - 1, F.lit(block) - F.col("missing")).otherwise(F.lit(block))
    ahead = F.col("_j") * block - F.when(F.col("_j") > F.col("short_at"), F.col("missing")).otherwise(F.lit(0))
    take = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - ahead))
    place = permuted(F.col("first_draw") + F.col("_k"), F.lit(max(total, 1)).cast("long"), grid_of(spark, total), F.lit(seed))
    return each.select(
        "source_no", "index", "epoch", take.cast("long").alias("take"), place.alias("_place")).select(
        "source_no", "index", "epoch", "take", F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"))


def _streams(docs: DataFrame) -> tuple[str, str]:
    """Paths of the sized rows, each at its place in its source's stream, and of the targets."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"), *text_keys())
    sized_path = write_scratch(sized, "mixing-sizes")
    sized = spark.read.parquet(sized_path)
    targets_path = write_scratch(source_targets(sized), "mixing-targets")
    targets = spark.read.parquet(targets_path).select(F.col("source").alias("_source"), "source_no")
    with_no = sized.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col(c) for c in ("doc_id", "size", "crc", "hash")]
    streams_path = write_scratch(numbered(with_no, ["source_no"], order, F.col("size")), "mixing-streams")
    drop_scratch(spark, sized_path)
    return streams_path, targets_path


def _taken(streams: DataFrame, draws: DataFrame, block: int) -> DataFrame:
    """Per draw and document in its block: source_no, before, epoch, shard, and the words [lo, hi) of the document."""
    inside = streams.where("size > 0").select("source_no", "before", "size")
    pieces = inside.withColumn("index", F.explode(F.expr(f"sequence(before div {block}L, (before + size - 1) div {block}L)")))
    at = F.col("index") * block
    pieces = pieces.select(
        "source_no", "index", "before", F.greatest(F.col("before") - at, F.lit(0)).alias("a"),
        F.least(F.col("before") + F.col("size") - at, F.lit(block)).alias("b"))
    # draws grow with the corpus, whatever the planner makes of the exploded plan: never broadcast them
    met = pieces.join(draws.hint("merge"), ["source_no", "index"]).where("take > a")
    start = F.col("index") * block - F.col("before")
    return met.select(
        "source_no", "before", "epoch", "shard", (start + F.col("a")).alias("lo"), (start + F.least("b", "take")).alias("hi"))


def mix_sources(docs: DataFrame, block_words: int = 64, shards: int = 64, seed: int = 29) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source; other columns are not read): doc_id, size, source_size,
    target, taken, first_shard.

    Words taken from a source are its target, rounded to a word. Nothing of a document is drawn more than
    three times. ``first_shard`` is the least output shard with words of the row (null: none taken). Null and
    empty texts have no words; a null source is a source of its own, the last. Reruns agree; rows equal in
    doc_id, source and text are alike and may swap what is taken of them. No rows give no rows.
    """
    spark = docs.sparkSession
    streams_path, targets_path = _streams(docs)
    streams, targets = spark.read.parquet(streams_path), spark.read.parquet(targets_path)
    draws = draw_blocks(targets, block_words, shards, seed)
    taken = _taken(streams, draws, block_words).groupBy("source_no", "before").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("shard").alias("first_shard")).withColumn("_has", F.lit(True))
    rows = streams.withColumn("_has", F.col("size") > 0).join(taken.hint("merge"), ["source_no", "before", "_has"], "left")
    return rows.join(targets.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, block_words: int = 64, shards: int = 64, seed: int = 29) -> DataFrame:
    """The mix as documents, all columns of ``docs``: a row for every epoch that takes words of a document.

    Where an epoch takes all words, the text is unchanged; where it takes some, the text is these words,
    joined by one space, and n_chars is counted anew. Documents without words are not in the mix.
    """
    spark = docs.sparkSession
    streams_path, targets_path = _streams(docs)
    streams = spark.read.parquet(streams_path)
    draws = draw_blocks(spark.read.parquet(targets_path), block_words, shards, seed)
    spans = _taken(streams, draws, block_words).groupBy("source_no", "before", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    keys = ["doc_id", "source", "crc", "hash"]
    by_row = streams.where("size > 0").join(spans.hint("merge"), ["source_no", "before"]).groupBy(*keys, "size", "before").agg(
        F.collect_list("spans").alias("epochs"))
    same = W.partitionBy(*keys)
    side = by_row.withColumn("_copy", F.row_number().over(same.orderBy("before"))).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_copy").alias("_r_copy"), F.col("size").alias("_size"), F.col("epochs").alias("_epochs"))
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"),
        F.col("source").cast("string").alias("_source"), *text_keys()).withColumnsRenamed({"crc": "_crc", "hash": "_hash"})
    left = left.withColumn("_copy", F.row_number().over(W.partitionBy("_doc_id", "_source", "_crc", "_hash").orderBy("_doc_id")))
    met = left.join(side.hint("merge"), [*[F.col(f"_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.col("_copy") == F.col("_r_copy")])
    each = met.withColumn("_spans", F.explode("_epochs"))
    many = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice("_words", (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")
    whole = many == F.col("_size")
    each = each.select("_row", "_spans", whole.alias("_whole"), F.when(~whole, words).alias("_words"))
    new = each.select("_row", F.when(F.col("_whole"), F.col("_row.text")).otherwise(part).alias("_text"))
    swap = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return new.select(*[swap.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
